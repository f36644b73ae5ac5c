"""What misspelled and quoted terms count, stems in the trie, and edge rows of the two classifiers."""

import copy
import random

import pytest

from bookglass.llm import quality, toxicity
from bookglass.llm.toxicity import ANY, Automaton, Lexicon, Scorer

BASE = [f"wort{i}" for i in range(300)]
SCHEMA = "doc_id long, text string, lang string, y string"


def corpus():
    rng = random.Random(4)
    rows, tags = [], []
    for d in range(600):
        w = [rng.choice(BASE) for _ in range(30)]
        toxic = d % 5 == 0
        if toxic:
            w[3] = rng.choice(["abominable"] * 4 + ["abomnable", "abominabel"]) if d % 3 else "abominable"
        if d % 20 == 1:
            w[7:10] = ["“he", "said", "abominable”"]
        rows.append((d, " ".join(w)))
        tags.append((d, int(not toxic), int(toxic)))
    return rows, tags


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def learned(spark):
    rows, tags = corpus()
    return toxicity.learn(frame(spark, rows), spark.createDataFrame(tags, "doc_id long, quality int, toxic int"))


def test_misspelling_and_context_change_the_score(learned):
    s = Scorer(learned)
    plain, misspelled, quoted, clean = (s.score(f"wort1 wort2 {x} wort3 wort4") for x in ("abominable", "abominabble", "“an abominable thing”", "wort9"))
    assert clean < quoted < plain and clean < misspelled <= plain and misspelled >= 0.3 > clean
    deaf = copy.copy(learned)
    deaf.ways = (1.0, 0.0, 0.0, 0.0, 0.0)
    assert Scorer(deaf).score("wort1 abominabble wort3") == Scorer(deaf).score("wort1 wort2 wort3") < misspelled
    blunt = copy.copy(learned)
    blunt.quoted = 1.0
    assert Scorer(blunt).score("wort1 “an abominable thing” wort4") > quoted


def test_stems_take_any_tail():
    a = Automaton(["grimmig" + ANY, "grim", "trashy"])
    assert a.find("grimmigkeiten" * 50) == ("grimmig" + ANY, 0) and a.find("grim") == ("grim", 0)
    assert a.find("grimigkeit") == ("grimmig" + ANY, 1) and a.find("trashi") == ("trashy", 1)
    assert a.find("grimm") is None and a.find("") is None
    s = Scorer(Lexicon({"grimmig" + ANY: 4.0}, frozenset({"grimigkeit"})))
    assert s["grimmige,"] == (4.0, toxicity.EXACT) and s["grimigkeit"] == (0.0, toxicity.EXACT) and s["grimige"] == (4.0, toxicity.STEM)


def test_edge_rows(spark, learned):
    long = "wort1 " * 200_000
    rows = [(1, None), (2, ""), (3, "abominable"), (3, "abominable"), (None, "x"), (5, long), (6, long + "abominable"), (7, "a" * 1_000_000)]
    got = toxicity.score_documents(frame(spark, rows), learned).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and score[1] == score[2] == score[5] == score[7] < score[6] == score[3]
    assert toxicity.score_documents(frame(spark, []), learned).count() == 0
    with pytest.raises(ValueError):
        toxicity.score_documents(frame(spark, rows).toDF("doc_id", "text", "score", "y"), learned, keep=("doc_id", "score"))
    none = spark.createDataFrame([(3, None, None), (None, 1, 1), (99, 1, 1), (5, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for m, f in ((toxicity, toxicity.Scorer), (quality, None)):
        model = m.learn(frame(spark, rows), none)
        assert len({r.score for r in m.score_documents(frame(spark, rows), model).collect()}) == 1


def test_quality_on_edge_rows_and_held_out(spark):
    rng = random.Random(5)
    rows, tags = [], []
    for d in range(400):
        good = d % 2
        w = [rng.choice(BASE) for _ in range(40)]
        rows.append((d, " ".join(w) if good else " ".join(f"{x}$$${x[0]}" for x in w)))
        tags.append((d, good, 0))
    model = quality.learn(frame(spark, rows), spark.createDataFrame(tags, "doc_id long, quality int, toxic int"))
    extra = [(1000, None), (1001, ""), (1002, "wort " * 100_000), (None, "x"), (3, rows[3][1])]
    got = quality.score_documents(frame(spark, rows + extra), model).collect()
    assert len(got) == len(rows) + len(extra)
    score = {r.doc_id: r for r in got}
    assert all(score[d].predicted == y for d, y, _ in tags) and score[1000].score == score[1001].score
    assert quality.score_documents(frame(spark, []), model).count() == 0
