"""A training corpus from raw documents, in five stages: each takes (spark, docs, sf_dir), and its result is written and
read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookglass.llm import bpe, decontam, jaccard, linededup, toxicity
from bookglass.llm.common import written
from bookglass.llm.queries import VOCABULARY, table


def _apart(docs: DataFrame) -> DataFrame:
    """docs with doc_id, text and n_chars under these names and its other columns under names that no operator uses."""
    return docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"__in{i}" for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic (score of 0.3 and more) go.

    Null and empty texts hold no term and stay; equal texts fare alike; null and repeated ids stay row by row. Columns of
    any names pass through. No documents give none; without toxic labels all have the labels' share as their score.
    """
    own = _apart(docs)
    lexicon = toxicity.learn(own, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(own, lexicon, threshold=0.3, keep=tuple(own.columns))
    return scored.where("predicted = 0").select(*own.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points that 5 documents share stay in the largest doc_id alone; n_chars, if there is one, follows the text.

    A null text stays null. Rows with a null id keep all lines; rows that repeat an id count as one document. A document
    that loses all its lines keeps an empty text. Columns of any names pass through. No documents give none.
    """
    own = _apart(docs)
    kept = linededup.apply_bitmaps(own, linededup.keep_bitmaps(own, min_chars=40, min_docs=5))
    changed = F.col("n_dropped") > 0
    columns = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in own.columns)).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a Jaccard likeness of 0.8, the smallest doc_id stays.

    Texts that are null, empty or without words, and rows with a null id, link with nothing and stay. Rows that repeat an
    id are one document and stay or go together. Columns of any names pass through. No documents give none.
    """
    groups = jaccard.jaccard_components(_apart(docs), width=5, percent=80)
    gone = groups.where("component_id <> doc").select(F.col("doc").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go.

    Null and empty texts hold nothing and stay, as do rows with a null id; rows that repeat an id go together. Columns of
    any names pass through. No documents give none; an empty benchmark lets all stay.
    """
    found = decontam.contaminated_regions(_apart(docs), table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, and the digest of the text decoded from them."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, columns=("n_tokens", "token_ids", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokens),
]

#: Not expressible in SQL: the toxicity scores and the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
