import hashlib
import random
import zlib
from collections import defaultdict

from oracle import connect, differences

from bookglass.llm import manifest, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """The manifest of (doc_id, text, lang, source, n_chars) by whole levels in memory."""
    known = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = held = h(*map(known, (i, source, lang, n, text)))
        if zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 0:
            held = h(*map(known, (i, source, lang, n, text and text.translate(LOWER))))
        trees[lang].append((i is not None, i or 0, leaf, held, i))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def path(all_levels, i):
        for level in all_levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            yield "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
            i //= 8

    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels([x[2] for x in sorted(trees[k])]) for k in names}
    top = levels([built[k][-1][0] for k in names]) if names else []
    out = []
    for t, k in enumerate(names):
        for i, (_, _, leaf, held, doc) in enumerate(sorted(trees[k])):
            way = [*path(built[k], i), *path(top, t)]
            for left, right in way:
                held = h(left, held, right)
            out.append((doc, leaf, built[k][-1][0], top[-1][0], h(*(x for level in way for x in level)), held, held == top[-1][0]))
    return out


def agrees(spark, rows, extra=""):
    got = manifest.document_manifest(spark.createDataFrame(rows, SCHEMA + extra)).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return sorted(map(tuple, got), key=order) == sorted(plain([r[:5] for r in rows]), key=order)


def test_query_agrees_with_sql(spark):
    assert not differences(queries.op13_merkle_manifest(spark, SF), queries.oracle_sql()["op13_merkle_manifest"], connect(SF))


def test_trees_of_every_height_and_more_than_eight_of_them(spark):
    rng = random.Random(3)
    sizes = [1, 2, 8, 9, 64, 65, 513, 1200, 1, 7, 10]
    rows = [(n, f"Text {n % 40}", f"l{t}", "s", n) for t, size in enumerate(sizes) for n in rng.sample(range(10**6), size)]
    assert agrees(spark, rows)


def test_nulls_repeated_rows_empty_texts_and_other_columns(spark):
    rows = [(1, "A", None, None, 1, "x"), (None, None, "en", "s", None, "y"), (None, "B", "en", "s", 1, None), (2, "", "é", "s", 0, "x"), (2, "", "é", "s", 0, "x"), (3, "Ü x" * 40_000, "en", "", 1, "x"), (-4, None, "", "s", 3, None)]
    assert agrees(spark, rows, ", tree string")
    assert agrees(spark, [(7, "Alone", "en", "s", 5)])
    none = manifest.document_manifest(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_a_queue_that_spills_keeps_the_order():
    rng = random.Random(1)
    labels = [rng.randrange(200) for _ in range(3000)]
    small = manifest.ExternalQueue(held=50)
    for i, label in enumerate(labels):
        small.push(label, i)
    assert small.runs
    out = [small.pop() for _ in labels]
    assert out == sorted(((label, i) for i, label in enumerate(labels)), key=lambda x: (x[0], x[1]))
    assert small.top() is None
    digests = [h(str(i)) for i in range(300)]
    assert manifest.lift(digests, 3, lambda: manifest.ExternalQueue(held=10)) == manifest.lift(digests, 3)


def test_proofs_lead_to_the_root_and_to_no_other(spark):
    digests = [h(str(i)) for i in range(70)]
    kept = []
    root = manifest.lift(digests, manifest.height(70), keep=kept)
    for no, suffix in manifest.sweep(kept, (), manifest.height(70)):
        assert manifest.fold(digests[no], suffix) == root != manifest.fold(h("other"), suffix)
