import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from bookglass.llm import queries, rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text, by plain counting."""
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def plain(rows, share=0.75, steps=4, cutoff=0.9999):
    """(base statistics, base_failed, squared distance or None) per row, by numpy per group."""
    stats = [base(r[1]) for r in rows]
    failed = [s[0] < 20 or 100 * s[4] > 30 * s[0] for s in stats]
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        if not failed[k]:
            groups[r[2], r[3]].append(k)
    out = [(s[:5], f, None) for s, f in zip(stats, failed, strict=True)]
    for members in groups.values():
        s = np.array([stats[k] for k in members], float)
        n = s[:, 0]
        x = np.column_stack([np.log(n), np.log((s[:, 1] / n) / (s[:, 1].sum() / n.sum())) * np.sqrt(n / (1 + n / 400)), np.sqrt(s[:, 2] / n), np.sqrt(s[:, 4] / n), np.sqrt(s[:, 3] / np.maximum(s[:, 5], 1))])
        x = np.floor(x * 1024 + 0.5)

        def distance(m, c, count, x=x):
            k = count / (count + 20)
            a = c * k + np.diag(((1 - k) * np.array(rules.PRIOR) ** 2 + np.array(rules.LEAST) ** 2) * 1024**2)
            return ((x - m) @ np.linalg.inv(a) * (x - m)).sum(1)

        q = [np.sort(x, axis=0)[math.ceil(p * len(x)) - 1] for p in (0.25, 0.5, 0.75)]
        d2 = distance(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2), len(x))
        for step in range(steps + 1):
            if step < steps:
                part = np.floor(np.log2(d2 + 1e-9) * 64)
                near = part <= np.sort(part)[math.ceil(share * len(x)) - 1]
                factor = rules.consistency(share)
            else:
                near, factor = d2 <= rules.chi2_quantile(0.975, 5), rules.consistency(0.975)
            d2 = distance(x[near].mean(0), factor * np.cov(x[near].T, bias=True), near.sum())
        for k, d in zip(members, d2, strict=True):
            out[k] = (out[k][0], False, d)
    return out


def agrees(spark, rows, extra=(), more=""):
    df = spark.createDataFrame([(k, *r[1:], *extra) for k, r in enumerate(rows)], SCHEMA + more)
    got = {r["doc_id"]: r for r in rules.quality_rules(df).collect()}
    limit = rules.chi2_quantile(0.9999, 5)
    assert len(got) == len(rows)
    for k, (stats, failed, d2) in enumerate(plain(rows)):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*stats, failed)
        if failed:
            assert not r["kept"] and r["distance"] is None
        else:
            assert math.isclose(r["distance"] ** 2, d2, rel_tol=1e-6, abs_tol=1e-6) and r["kept"] == (d2 <= limit)
    return got


def prose(rng, n, words=("of", "the", "quality", "reading", "a", "window", "and", "some", "plain", "text")):
    return " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(n))


def test_query_agrees_with_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs])
    got = {r["doc_id"]: r for r in queries.op11_quality_rules(spark, SF).collect()}
    limit = rules.chi2_quantile(0.9999, 5)
    for r, (stats, failed, d2) in zip(docs, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == (*stats, failed)
        assert g["kept"] == (not failed and d2 <= limit)


def test_outliers_of_a_hot_source_go_and_others_stay(spark):
    rng = random.Random(2)
    rows = [(0, prose(rng, rng.randrange(20, 400)), "en", "hot") for _ in range(150)]
    rows += [(0, " ".join(w + "$$$" for w in prose(rng, 200).split()), "en", "hot") for _ in range(30)]
    rows += [(0, prose(rng, 100), rng.choice(["de", "en"]), rng.choice(["s1", None])) for _ in range(30)]
    got = agrees(spark, rows)
    assert not any(got[k]["kept"] for k in range(150, 180)) and all(got[k]["kept"] for k in [*range(150), *range(180, 210)])


def test_edges(spark):
    rng = random.Random(4)
    same = prose(rng, 60)
    rows = [(0, None, "en", "s"), (0, "", "en", "s"), (0, " \n\t\x0b\x0c\r ", None, None), (0, "one", "en", "s"), (0, same, "xx", "y"), (0, same, "xx", "y"), (0, same, None, None)]
    rows += [(0, "a b c d e f g h " * 9 + "\n" + "x y\n" * 5, "en", "s"), (0, "w" * 300_000 + " " + prose(rng, 30), "en", "s"), (0, prose(rng, 40) + "  é" * 20, "en", "s"), (0, "\n".join(["a line | of # text"] * 7) + "\n \n", "en", "s")]
    agrees(spark, rows, (1, "z", 2.0), ", x0 long, n int, kept double".replace("n int", "n string"))
    none = rules.quality_rules(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and "kept" in none.columns
    lost = rules.quality_rules(spark.createDataFrame([(None, same, "en", "s"), (None, same, "en", "s")], SCHEMA)).collect()
    assert len(lost) == 2 and {r["kept"] for r in lost} == {True}


def test_repeated_windows_of_every_kind(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(7, 60)]
    texts += [" ".join([*itertools.chain(*[["u%d" % i for i in range(8)]] * k), *["v%d" % i for i in range(5)]]) for k in range(1, 4)]
    agrees(spark, [(0, t, "en", "s") for t in texts])


def test_chi_squared_values():
    assert abs(rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-4 and abs(rules.chi2_quantile(0.975, 7) - 16.0128) < 1e-4
    assert abs(rules.chi2_quantile(0.9999, 5) - 25.7448) < 1e-3 and rules.chi2_cdf(0, 5) == 0
