"""The pipeline's rows against its stages done plainly, and columns of clashing names."""

import random
import re

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402

WORDS = [f"word{i}" for i in range(400)]
LINE = "this licence line of more than forty characters repeats"


def rows_of():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    item = text(30)
    rows, toxic = [], []
    for d in range(120):
        t = text(60)
        if d % 6 == 0:
            t, _ = f"{t} abominable", toxic.append(d)
        if d % 10 == 1:
            t += f"\n{LINE}\nend {d}"
        rows.append((d, t))
    rows += [(200, rows[5][1]), (201, rows[5][1] + " more"), (202, text(20) + " " + item + " " + text(20)), (203, None), (204, ""), (205, ""), (None, rows[7][1])]
    return rows, toxic, item


@pytest.mark.parametrize("names", [("lang", "source"), ("score", "predicted"), ("kept", "n_dropped"), ("n_lines", "component_id"), ("a.b", "__in1")])
def test_stages_keep_clashing_columns(spark, names):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 99, 11), (2, None, "y", 98, 0), (None, "z", "z", 97, 1)], "doc_id long, text string, p string, q int, n_chars long").toDF("doc_id", "text", *names, "n_chars")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect())), name


def test_run_equals_the_plain_way(spark, tmp_path):
    rows, toxic, item = rows_of()
    spark.createDataFrame([(*r, "en", "web", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(d, t) for d, t in rows if "abominable" not in (t or "")]
    holders = [d for d, t in left if t and LINE in t.split("\n")]
    assert len(holders) >= 5
    left = [(d, "\n".join(x for x in t.split("\n") if x != LINE or d == max(holders)) if t else t) for d, t in left]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\S+", (t or "").lower())] for i in range(len(w) - 4)}
    gone = {b for a, s in left for b, t in left if a is not None and b is not None and a < b and (x := grams(s)) and (y := grams(t)) and len(x & y) >= 0.8 * len(x | y)}
    left = sorted((d or -1, t or "") for d, t in left if d not in gone and item not in (t or ""))
    got = cp.run(spark, str(tmp_path)).collect()
    import hashlib

    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in got) == [(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in left]
    assert {200, 201, 202} & {r.doc_id for r in got} == set() and len(got) < len(rows) - 20


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
