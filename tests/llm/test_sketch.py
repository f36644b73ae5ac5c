"""Fingerprints against exact shingle sets: likeness, containment, counts, merges, edited texts."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from bookglass.llm import sketch

SCHEMA = "doc_id long, text string, sketch string, next_text string"


def shingles(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


def texts():
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one two"), (4, "  \t\n ")]
    base = [f"w{i}" for i in range(900)]
    for d in range(5, 45):
        own = base[: rng.choice([40, 300, 900])]
        rows.append((d, " ".join(rng.choice(base) if rng.random() < d / 400 else w for w in own)))
    return rows + [(50, "long " * 60_000)]


def test_likeness_is_near_the_exact_one(spark):
    rows = texts()
    got = {r.doc_id: r for r in sketch.edit_likeness(frame(spark, rows)).collect()}
    ids = sorted(got)
    text = {d: t or "" for d, t in rows}
    for i, d in enumerate(ids):
        t, follow = text[d], text[ids[i - 1]]  # descending order: the next smaller id, after the last the largest
        third = len(t) // 3
        edited = t[: len(t) - third] + follow[:third]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r.near_edited, edited), (r.near_next, follow)):
            exact = jaccard(shingles(t), shingles(other))
            assert abs(value - exact) <= 4 * math.sqrt(max(exact * (1 - exact), 0.01) / sketch.K) + 1e-9
        n = len(shingles(t))
        assert r.distinct_shingles == n if n < sketch.K else abs(r.distinct_shingles - n) < 0.5 * n
    assert got[2].fingerprint == got[3].fingerprint and got[0].fingerprint == got[1].fingerprint == got[4].fingerprint == ""


def test_merge_containment_and_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(700)), " ".join(f"a{i}" for i in range(350))
    f = sketch.fingerprints(frame(spark, [(1, a), (2, b), (3, f"{a} {b}")]))
    s = {r.doc_id: r.sketch for r in f.collect()}
    one = spark.createDataFrame([(s[1], s[2])], "a array<long>, b array<long>")
    r = one.select(sketch.merge(F.col("a"), F.col("b")).alias("m"), sketch.containment(F.col("b"), F.col("a")).alias("c"), sketch.resemblance(F.col("a"), F.col("b")).alias("r")).first()
    assert r.m == sorted(set(s[1]) | set(s[2]))[: sketch.K]
    assert r.c > 0.8 and abs(r.r - 346 / 696) < 4 * math.sqrt(0.25 / sketch.K)
    groups = sketch.corpus_sketch(f.withColumn("g", F.col("doc_id") % 2), ["g"]).collect()
    want = {0: s[2], 1: sorted(set(s[1]) | set(s[3]))[: sketch.K]}
    assert {g.g: g.sketch for g in groups} == want


def test_edge_rows(spark):
    assert sketch.edit_likeness(frame(spark, [])).count() == 0
    one = sketch.edit_likeness(frame(spark, [(7, "a b c")])).first()
    assert one.near_next == 1.0
    rows = [(None, "x y"), (None, "x y"), (3, "abc"), (3, "abd"), (3, "abc")]
    got = sketch.edit_likeness(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 3), (0, 3), (3, 3), (3, 3), (3, 3)]
