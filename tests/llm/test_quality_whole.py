"""Every part of a long word reaches the indicators."""

import random

import numpy as np
import pytest

from bookglass.llm import quality

BASE = "甲乙丙丁" * 100


@pytest.mark.parametrize("tail", ["戊己庚辛", "abc", "a1" * 20, "。"])
def test_what_follows_a_long_start_counts(tail):
    one, two = quality.features(BASE + "丑" * 8), quality.features(BASE + tail + "丑" * 8)
    assert not np.array_equal(one, two)


def test_late_runs_of_a_word_count():
    word = "a1" * 4 + "b" * 40
    one, two = (set(quality.features(w).tolist()) for w in (word + "-" * 3, word + "-" * 3 + "B2"))
    grams = {quality.xxhash.xxh3_64_intdigest(g) & quality.MASK for g in ("--B", "-B2", "B2>", "-->")}
    assert two - one - grams  # a shape, not trigrams alone


def test_long_words_equal_the_plain_way():
    random.seed(2)
    for n in (1, 3, 65, 700):
        word = "".join(random.choice("aB1é漢😀.-_ß") for _ in range(n))
        marked = f"<{word}>"
        forms, grams = quality._long(word)
        assert forms == quality.shapes_of(word)
        assert sorted(grams) == sorted({marked[i : i + 3] for i in range(n)})
