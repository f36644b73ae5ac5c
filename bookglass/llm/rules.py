"""Quality rules: base statistics of texts, and robust multivariate outliers per language and source, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookglass.llm.common import written

#: White space between words, and characters that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Words in a window of the repeat statistic; base rules: fewest words, most words in repeated windows per 100.
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
#: The transformed statistics; for each, the least spread that counts, and the spread assumed of a group without rows.
NAMES = ("length", "word_length", "symbols", "repeats", "dup_lines")
LEAST = (0.25, 1.0, 0.1, 0.15, 0.15)
PRIOR = (1.0, 2.0, 0.2, 0.2, 0.3)
#: Rows that the assumed spread weighs as much as; words at which a mean word length is as sure as it gets.
PRIOR_ROWS, SURE_WORDS = 20, 400
#: Statistics and estimates are in steps of 1 / STEP, so their sums are whole numbers; parts of a doubling of a squared distance.
STEP, PARTS = 1024, 64
#: Groups up to which a table of estimates (some 500 bytes each) is broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _covered(hashes: Column, width: int) -> Column:
    """Places that windows of equal hashes cover: windows sorted by hash show which have an equal neighbour; these, sorted by place,
    each add what the next one doesn't cover."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    twice = lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
    places = F.sort_array(F.transform(_bound(pairs, twice), lambda e: e["p"]))
    own = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b)
    return _bound(places, own)


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words in windows of `width` words that the text holds twice or more, the first included; 64-bit hashes stand for windows."""
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(width))))
    count = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(_covered(x, width))
    many = lambda h: F.when(F.size(h) > width, _bound(windows(h), count)).otherwise(F.lit(0))
    return _bound(F.transform(w, lambda x: F.xxhash64(x)), many)


def base_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed) per row, without a shuffle.

    A null text has no words; n_lines are the lines with a word.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    by_line = _bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_word = _bound(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeat")))
    symbols = F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), by_word.alias("w"), by_line.alias("l"), F.length(bare).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"))
    d = d.select("doc_id", "lang", "source", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.repeat").cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def chi2_cdf(x: float, k: int) -> float:
    """The share of a chi-squared distribution of k degrees below x, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
    n = a
    while term > total * 1e-17:
        n += 1
        term *= half / n
        total += term
    return min(total, 1.0)


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal rows is multiplied by to estimate that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _grouped(rows: DataFrame, known: DataFrame, groups: int) -> DataFrame:
    """rows with what is known of their language and source, if anything is."""
    named = known.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    met = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    return rows.join(F.broadcast(named) if groups <= BROADCAST_GROUPS else named, met, "left").drop("__lang", "__source")


def transformed(base: DataFrame) -> tuple[DataFrame, int]:
    """(base with x0..x4, the number of groups): statistics of comparable spread, in whole steps.

    The logarithm of the number of words; that of the mean word length against its group's, times the root of the words
    it rests on (as n / (1 + n / SURE_WORDS)), as a short text's mean varies more; the roots of symbols per word, of the share
    of words in repeated windows and of lines that repeat.
    """
    means = written(base.where("not base_failed").groupBy("lang", "source").agg(F.sum("word_chars").alias("__chars"), F.sum("n_words").alias("__words")), "means")
    groups = means.count()
    d = _grouped(base, means, groups)
    n = F.col("n_words").cast("double")
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(b, F.lit(1.0)))
    length = F.log((F.col("word_chars") / n) / (F.col("__chars") / F.col("__words"))) * F.sqrt(n / (1 + n / SURE_WORDS))
    x = [F.log(n), length, share("n_symbols", n), share("n_repeat_words", n), share("n_dup_lines", F.col("n_lines").cast("double"))]
    whole = {f"x{i}": F.when(~F.col("base_failed"), F.floor(c * STEP + 0.5).cast("long")) for i, c in enumerate(x)}
    return written(d.withColumns(whole).drop("__chars", "__words"), "points"), groups


def quartiles(points: DataFrame) -> DataFrame:
    """(lang, source, n, m0.., c00..): the start of the estimates: medians, and the squares of normal spreads by the quartiles' distance.

    Values are counted before they are ordered, so a group's task orders distinct values alone.
    """
    each = points.where("not base_failed").select("lang", "source", F.posexplode(F.array(*(f"x{i}" for i in range(P)))).alias("at", "x"))
    counts = each.groupBy("lang", "source", "at", "x").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang", "source", "at")
    ranked = counts.withColumns({"upto": F.sum("n").over(by.orderBy("x")), "all": F.sum("n").over(by)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("x"))).cast("double")
    q = ranked.groupBy("lang", "source", "at").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.max("all").alias("n"))
    of = lambda c, i: F.max(F.when(F.col("at") == i, c))
    spread = (F.col("high") - F.col("low")) / 1.349
    columns = [of(F.col("mid"), i).alias(f"m{i}") for i in range(P)]
    columns += [(of(spread * spread, i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return q.groupBy("lang", "source").agg(F.max("n").alias("n"), *columns)


def whitened(estimates: DataFrame) -> DataFrame:
    """estimates (n, m, c) with w: the inverse of the Cholesky root of each covariance, so z = w (x - m) has the squared length of
    the Mahalanobis distance. A covariance is first weighed against the prior spread and never less than the least spread."""
    k = F.col("n") / (F.col("n") + PRIOR_ROWS)
    d = estimates
    full = {f"a{i}{j}": F.col(f"c{i}{j}") * k + (((1 - k) * PRIOR[i] ** 2 + LEAST[i] ** 2) * STEP**2 if i == j else 0.0) for i, j in PAIRS}
    d = d.withColumns(full)
    for i, j in PAIRS:
        rest = F.col(f"a{i}{j}")
        for t in range(j):
            rest = rest - F.col(f"l{i}{t}") * F.col(f"l{j}{t}")
        d = d.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(P):
        d = d.withColumn(f"w{i}{i}", 1 / F.col(f"l{i}{i}"))
        for j in range(i - 1, -1, -1):
            rest = F.lit(0.0)
            for t in range(j, i):
                rest = rest - F.col(f"l{i}{t}") * F.col(f"w{t}{j}")
            d = d.withColumn(f"w{i}{j}", rest * F.col(f"w{i}{i}"))
    return d.select("lang", "source", *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in PAIRS))


def squared_distance() -> Column:
    """The squared Mahalanobis distance of a row that has m and w."""
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + F.pow(z, F.lit(2.0))
    return total


def _estimated(points: DataFrame, weights: DataFrame, groups: int, share: float | None, within: float | None) -> DataFrame:
    """(lang, source, n, m, c) over each group's nearest share of rows, or over rows within a squared distance.

    Rows are summed by distance, in PARTS steps to a doubling, before a group's steps are ordered: an order over a bounded
    number of sums instead of rows. The step that the share ends in is taken whole, so equal rows fare alike.
    """
    rows = _grouped(points.where("not base_failed").select("lang", "source", *(f"x{i}" for i in range(P))), weights, groups).withColumn("d2", squared_distance())
    rows = rows.where(F.col("d2") <= within) if within else rows.withColumn("step", F.floor(F.log2(F.col("d2") + 1e-9) * PARTS).cast("int"))
    exact = lambda c: F.sum(c.cast("decimal(28,0)"))
    sums = [F.count("*").alias("n"), *(exact(F.col(f"x{i}")).alias(f"s{i}") for i in range(P)), *(exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS)]
    if not within:
        parts = rows.groupBy("lang", "source", "step").agg(*sums)
        by = Window.partitionBy("lang", "source")
        parts = parts.withColumns({"upto": F.sum("n").over(by.orderBy("step")), "all": F.sum("n").over(by)})
        parts = parts.where(F.col("upto") - F.col("n") < F.ceil(F.col("all") * share))
        sums = [F.sum(c).alias(c) for c in ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]]
        rows = parts
    d = rows.groupBy("lang", "source").agg(*sums)
    number = lambda c: F.col(c).cast("double")
    factor = consistency(share or chi2_cdf(within, P))
    d = d.withColumns({f"m{i}": number(f"s{i}") / number("n") for i in range(P)})
    return d.select("lang", "source", "n", *(f"m{i}" for i in range(P)), *((factor * (number(f"q{i}{j}") / number("n") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"c{i}{j}") for i, j in PAIRS))


def estimates(points: DataFrame, groups: int, *, share: float = 0.75, steps: int = 4, reweight: float = 0.975) -> DataFrame:
    """(lang, source, m, w): a minimum-covariance-determinant estimate per group.

    From medians and quartiles, `steps` times the mean and covariance of the nearest share of rows take the place of the
    estimate (concentration steps: each lowers the covariance's determinant), then once those of all rows that the result
    keeps within the chi-squared quantile `reweight`.
    """
    weights = written(whitened(quartiles(points)), "mcd")
    for _ in range(steps):
        weights = written(whitened(_estimated(points, weights, groups, share, None)), "mcd")
    return written(whitened(_estimated(points, weights, groups, None, chi2_quantile(reweight, P))), "mcd")


def quality_rules(docs: DataFrame, *, cutoff: float = 0.9999, share: float = 0.75, steps: int = 4, **columns) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) per row.

    A row is kept if it passes the base rules and its vector of transformed statistics is within the chi-squared quantile
    `cutoff` of the robust estimate of its language and source, learned from all rows that pass the base rules. distance is the
    Mahalanobis distance, null for rows that fail the base rules.

    Texts are read once, without a shuffle; estimates are sums per group, added up in each task first, so one source may
    hold any share of the rows, and they never pass through the driver. Null texts have no words and fail; a null language
    or source is a value like others; a group with few rows is judged mostly by the prior spread about its own mean; equal rows of
    a group fare alike; repeated and null ids are rows like others. No rows give none. Other columns are not read.
    """
    points, groups = transformed(written(base_statistics(docs, **columns), "statistics"))
    fit = estimates(points, groups, share=share, steps=steps)
    d = _grouped(points, fit, groups).withColumn("d2", squared_distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(cutoff, P), F.lit(False))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.sqrt("d2")).alias("distance"))
