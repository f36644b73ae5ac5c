"""Line deduplication over a corpus: range-partitioned line hashes, streamed, to keep bitmaps per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookglass.llm.common import partitions, prepare, written

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lower-cased; None below min_chars code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2, ids, lines = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if doc is None or not text:
                continue
            for k, line in enumerate(text.split(b"\n")):
                if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
                    h = xxhash.xxh3_128_intdigest(key)
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & ((1 << 64) - 1)) - (1 << 63))
                    ids.append(doc)
                    lines.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64()), pa.array(lines, pa.int32())], names=["h1", "h2", "doc", "line"])


#: What the stream tells: lines to drop; lines of a key that another partition holds too; that key's documents here.
DROP, OPEN, COUNT = 0, 1, 2
STREAM = "kind int, h1 long, h2 long, doc long, line int, n_docs long"


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (h1, h2, doc descending, line). A key's first document is its largest; its later lines wait
    until min_docs documents are seen, at most those of min_docs - 1 documents, then flow. The first and the last key
    of a partition may go on in a neighbour: their lines leave as OPEN, with a COUNT row each."""
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 6
        out.clear()
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "h1", "h2", "doc", "line", "n_docs"])

    key: tuple | None = None
    first = True  # the key in hand is the partition's first
    top = last = None  # its largest and its current document
    n, held = 0, []  # its documents; lines not yet decided
    for batch in batches:
        for h1, h2, doc, line in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (h1, h2) != key:
                if key is not None:
                    if first:
                        out.append((COUNT, *key, top, 0, n))
                    first = False
                if key is None:
                    first = True
                key, top, last, n, held = (h1, h2), doc, doc, 1, []
            elif doc != last:
                last, n = doc, n + 1
            if first:
                out.append((OPEN, h1, h2, doc, line, 0))
            elif doc != top and n >= min_docs:
                out.extend((DROP, h1, h2, d, k, 0) for d, k in held)
                held = []
                out.append((DROP, h1, h2, doc, line, 0))
            elif doc != top:
                held.append((doc, line))
            if len(out) >= 20_000:
                yield flush()
    if key is not None:
        if not first:  # the last key: what was dropped already holds whatever a neighbour adds, but for its largest document
            out.extend((OPEN, *key, d, k, 0) for d, k in held)
        out.append((COUNT, *key, top, 0, n))
    yield flush()


def dropped_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line): lines whose key has min_chars code points and occurs in min_docs documents, but not in its largest.

    Rows (key hash, document, line) are range-partitioned by all of (hash, document descending), so a line that a
    third of all documents share spreads over many partitions; each is sorted and streamed in bounded memory. Keys that
    cross a partition's border are settled by a summary of at most two rows per partition.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(lambda it: _hashes(it, min_chars), "h1 long, h2 long, doc long, line int")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "line")
    told = written(dealt.mapInArrow(lambda it: _stream(it, min_docs), STREAM), "lines")
    border = told.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("doc").alias("top"))
    waiting = told.where(F.col("kind") == OPEN).select("h1", "h2", "doc", "line")
    late = waiting.join(F.broadcast(border), ["h1", "h2"]).where((F.col("n") >= min_docs) & (F.col("doc") != F.col("top")))
    return told.where(F.col("kind") == DROP).select("doc", "line").unionByName(late.select("doc", "line")).distinct()


def keep_bitmaps(docs: DataFrame, **options: object) -> DataFrame:
    """(doc, n_dropped, keep_bitmap) of each document that loses lines; others have no row and keep all lines.

    keep_bitmap: zlib of whole bytes of bits, most significant first, one per line up to the last dropped one; 1 keeps,
    as do bits and lines after it.
    """
    lines = dropped_lines(docs, **options)
    grouped = lines.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("lines"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for drop in batch.column(1).to_pylist():
                keep = np.ones((drop[-1] // 8 + 1) * 8, np.uint8)
                keep[drop] = 0
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
                counts.append(len(drop))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "n_dropped", "keep_bitmap"])

    return grouped.mapInArrow(pack, "doc long, n_dropped long, keep_bitmap binary")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int]:
    """The kept lines joined by newlines, and the number of lines before."""
    if bitmap is None:
        return text, text.count(b"\n") + 1
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    keep = [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]
    return b"\n".join(keep), len(lines)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with (n_lines, n_dropped, kept) beside their columns; kept is the text of the lines that stay.

    Null or empty text: one empty line, kept as an empty text. Null ids take no part and keep all lines. Rows that
    repeat an id must repeat its text. Documents that lose every line keep an empty text. Columns of docs that bear
    one of the three names are replaced. Empty tables give no rows.
    """
    names = ["n_lines", "n_dropped", "kept"]
    own = [c for c in docs.columns if c not in names]
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("n_dropped").alias("__n"), F.col("keep_bitmap").alias("__bits"))
    joined = docs.select(*own).join(marks, F.col(id_col).cast("long") == F.col("__doc"), "left").drop("__doc")
    schema = T.StructType([joined.schema[c] for c in own] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    at = own.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, drops, texts = [], [], []
            n, bits = batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()
            for text, d, b in zip(batch.column(at).cast(pa.binary()).to_pylist(), n, bits, strict=True):
                new, lines = kept_text(text or b"", b)
                counts.append(lines)
                drops.append(d or 0)
                texts.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(own))] + [pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=[*own, *names])

    return joined.mapInArrow(task, schema)
