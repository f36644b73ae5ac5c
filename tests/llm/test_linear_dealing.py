"""What is dealt to buckets grows with the shingles, not with the buckets; the counted search equals brute force."""

import numpy as np
import pyarrow as pa
import pytest

from bookglass.llm import jaccard

NONE = np.empty(0, np.uint64)


def batches(n):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(n)]
    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], names=["doc", "text"])


def dealt(buckets):
    """Bytes of counts, tokens and digests, and rows, of 300 documents."""
    rows = bytes_ = 0
    for b in jaccard._deal(batches(300), 3, buckets, NONE, 4):
        rows += b.num_rows
        bytes_ += sum(len(x) for c in (2, 3, 4) for x in b.column(c).to_pylist())
    return bytes_, rows


def test_dealt_bytes_are_bounded_by_the_shingles():
    shingles = 300 * 198
    few, many, most = dealt(100)[0], dealt(10_000)[0], dealt(100_000)[0]
    assert few < many < 45 * shingles and most < 45 * shingles  # 4 bytes of hash, 8 of digest, what tells one from another
    assert dealt(1_000_000)[0] < 1.15 * most and dealt(1_000_000)[1] <= shingles + 1


def test_a_bucket_holds_only_what_falls_in_it():
    for b in jaccard._deal(batches(50), 3, 5000, NONE, 4):
        for bucket, counts, tokens, marks in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
            if bucket >= 0:
                who, many = jaccard._pairs(counts)
                assert len(marks) == 8 * len(who) and len(tokens) == 4 * many.sum() and (many > 0).all()


def test_many_buckets_give_the_same_result(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):
        own = list(base)
        own[int(rng.integers(60))] = f"x{i % 7}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, f"lone text number {i} with words of its own {i * i}") for i in range(20)] + [(0, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda: sorted(tuple(r) for r in jaccard.jaccard_components(df, width=3, percent=80, count_links=True).collect())
    few = result()
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 200)
    assert result() == few


@pytest.mark.parametrize("probes", [1, 50, 1 << 20])
def test_counted_search_equals_brute_force(monkeypatch, probes):
    monkeypatch.setattr(jaccard, "PROBES", probes)
    rng = np.random.default_rng(probes)
    for trial in range(30):
        base = [rng.choice(200, size=rng.integers(5, 60), replace=False) for _ in range(3)]
        sets = []
        for i in range(int(rng.integers(2, 40))):
            t = set(base[rng.integers(3)].tolist())
            for _ in range(int(rng.integers(0, 4))):
                t.discard(next(iter(t)))
                t.add(int(rng.integers(200, 260)))
            sets.append((i, int(rng.integers(0, 3)) if trial % 2 else 0, np.array(sorted(t), np.uint64), int(rng.integers(1, 4))))
        percent = int(rng.choice([60, 80, 90]))
        want = {}
        for i, si, x, ci in sets:
            for j, sj, y, cj in sets[:i]:
                if not (si and si == sj) and jaccard.linked(len(np.intersect1d(x, y)), len(x), len(y), percent):
                    want[i], want[j] = want.get(i, 0) + cj, want.get(j, 0) + ci
        assert dict(jaccard.every_link(sets, percent)[1]) == want
