"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookglass.llm.common import partitions

#: Hashes kept in a sketch, words in a shingle, bits of a hash.
K, WIDTH, BITS = 128, 5, 40


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """40-bit hashes of the word shingles of a text (words lie between white space); fewer words than width: one
    shingle of all; none: an empty array."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    hashed = F.shiftrightunsigned
    many = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: hashed(F.xxhash64(F.slice(w, i, F.lit(width))), 64 - BITS))
    of = lambda w: F.when(F.size(w) >= width, many(w)).when(F.size(w) > 0, F.array(hashed(F.xxhash64(w), 64 - BITS))).otherwise(F.expr("cast(array() as array<bigint>)"))
    # A one-element transform binds the words, so they are split once.
    return F.element_at(F.transform(F.array(words), of), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union, from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets; 1 if both are empty, 0 if one is."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1))).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float((k - 1) * 2**BITS)) / F.greatest(F.element_at(a, -1), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    r = resemblance(a, b, k)
    shared = r * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_count(a, k), F.lit(1.0))))


def as_text(a: Column) -> Column:
    """A sketch as text: its hashes in order, ten lower-case hex digits each."""
    return F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(id, sketch, fingerprint, distinct_shingles) per row, without a shuffle. Null texts count as empty; equal texts
    have equal fingerprints; an empty text has an empty one."""
    d = docs.select(id_col, bottom_k(shingle_hashes(F.coalesce(F.col(text_col), F.lit("")), width), k).alias("sketch"))
    return d.withColumns({"fingerprint": as_text(F.col("sketch")), "distinct_shingles": distinct_count(F.col("sketch"), k)})


def corpus_sketch(sketches: DataFrame, by: list[str], *, k: int = K, sketch_col: str = "sketch", salts: int = 64) -> DataFrame:
    """One sketch per group from the sketches of its parts. Parts are merged under a salt first, as the k smallest
    distinct hashes of each (group, salt), so a group of a third of all rows is shared out."""
    h = sketches.select(*by, F.explode(sketch_col).alias("h")).distinct().withColumn("__salt", F.pmod(F.col("h"), F.lit(salts)))
    part = h.groupBy(*by, "__salt").agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias("s"))
    return part.groupBy(*by).agg(bottom_k(F.flatten(F.collect_list("s")), k).alias(sketch_col))


def with_next(docs: DataFrame, columns: dict[str, Column], *, id_col: str = "doc_id", rows_per_chunk: int = 1000) -> DataFrame:
    """docs with, for each name, the value of an expression in the row of the next smaller id; the smallest id's next is the largest.

    The ids are cut into chunks at quantiles. A chunk is ordered by itself, and the largest row of the chunk below
    visits it as a ghost, so no task needs the whole order and each text is shuffled once. Null ids count as the smallest;
    rows that repeat an id come in the order of their text. A single row is its own next; no rows give none.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("id"))
    wanted = max(1, min(10_000, max(4 * partitions(docs.sparkSession), -(-ids.count() // rows_per_chunk))))
    cuts = ids.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted).alias("q")).first()["q"] or []
    tops = sorted(r["m"] for r in ids.withColumn("__chunk", _below(F.col("id"), sorted(set(cuts)))).groupBy("__chunk").agg(F.max("id").alias("m")).collect())
    last = len(tops)
    rows = docs.withColumn("__id", key).withColumn("__chunk", _below(F.col("__id"), tops))
    is_top = F.element_at(F.lit(np.array(tops or [0], np.int64)), (F.col("__chunk") + 1).cast("int")) == F.col("__id")
    stay = F.struct(F.col("__chunk").alias("chunk"), F.lit(False).alias("ghost"))
    visit = F.struct(((F.col("__chunk") + 1) % max(1, last)).cast("int").alias("chunk"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("__at", F.explode(F.when(is_top, F.array(stay, visit)).otherwise(F.array(stay))))
    order = Window.partitionBy("__at.chunk").orderBy(F.col("__at.ghost"), F.col("__id").desc(), "text")
    rows = rows.withColumns({n: F.lead(c).over(order) for n, c in columns.items()})
    return rows.where(~F.col("__at.ghost")).drop("__id", "__chunk", "__at")


def _below(c: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below c, by two short look-ups."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    lit = lambda x: F.lit(np.array(x, np.int64))
    g = F.greatest(F.size(F.filter(lit([g[0] for g in groups]), lambda x: x < c)), F.lit(1))
    return ((g - 1) * step + F.size(F.filter(F.element_at(F.array(*map(lit, groups)), g), lambda x: x < c))).cast("int")


def edited(text: Column, following: Column) -> Column:
    """text with its last third of code points replaced by the first as many, or all, of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - third), F.left(following, third))


def edit_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Per row: fingerprints of the whole text and of its edited text, their likeness, and that to the next document.

    Columns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles. The
    text is shuffled once, by chunks of the id order (with_next). Null texts count as empty; two empty texts have
    likeness 1, an empty and another 0; equal texts have equal fingerprints. Null ids count as the smallest; rows that
    repeat an id follow each other in the order of their text. Other columns are not read. No rows give none.
    """
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("sketch", bottom_k(shingle_hashes(F.col("text"), width), k))
    d = with_next(d, {"next_text": F.col("text"), "next_sketch": F.col("sketch")}, id_col=id_col)
    d = d.withColumn("edited", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    d = d.select(id_col, "sketch", "next_sketch", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), bottom_k(shingle_hashes(F.col("edited"), width), k).alias("edited_sketch"))
    return d.select(id_col, "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), distinct_count(F.col("sketch"), k).alias("distinct_shingles"))
