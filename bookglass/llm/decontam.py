"""Benchmark decontamination: passages of a benchmark found in documents within an edit budget."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookglass.llm.common import prepare, written

#: Length of a q-gram, edits allowed per code point of an item, and code points of benchmark text held by a worker at once.
Q, EDIT_RATE, BLOCK_CHARS = 8, 0.1, 4_000_000
#: Code points of a document looked at in one step; steps overlap by the longest item and its budget.
STEP = 1 << 20
#: Places of q-grams, and cells of aligned bands, that are in hand at once.
ENTRIES, CELLS = 2_000_000, 1_000_000
#: A code point that no text has, and a distance that none reaches.
NONE, FAR = 0xFFFFFFFF, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased and each white space one space; positions stay those of the text."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    a[(a >= 65) & (a <= 90)] += 32
    a[((a >= 9) & (a <= 13)) | (a == 0xA0)] = 32
    return a


def qgrams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q code points; equal grams have equal hashes, and a collision only adds a candidate."""
    if len(a) < q:
        return np.empty(0, np.uint64)
    wide = a.astype(np.uint64)
    h = np.zeros(len(a) - q + 1, np.uint64)
    for j in range(q):
        h = h * BASE + wide[j : len(a) - q + 1 + j]
    return h ^ (h >> np.uint64(31))


def budget(m: int, rate: float = EDIT_RATE, q: int = Q) -> int:
    """Edits allowed for an item of m code points: rate * m, but few enough for the q-gram lemma to demand a shared q-gram."""
    return max(0, min(int(rate * m), m // q - 1))


def align(pattern: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of text nearest to the whole pattern, within k edits; None if there is none."""
    found = align_all(pattern, text[None, :], k)
    return next(iter(zip(*(x.tolist() for x in found[1:]), strict=True)), None)


def align_all(pattern: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which, edits, start, end) of those of some texts of one length that hold the pattern within k edits.

    Of equal distances the earliest end counts, and for it the latest start.
    """
    which, edits, end = _last_row(pattern, texts, k)
    reach = len(pattern) + k
    padded = np.concatenate([np.full((len(which), reach), NONE, np.uint32), texts[which]], axis=1)
    back = padded[np.arange(len(which))[:, None], end[:, None] + np.arange(reach)[None, ::-1]]  # the text before each end, reversed
    again, _, length = _last_row(pattern[::-1], back, k, anchored=True)
    start = end.copy()
    start[again] -= length
    return which, edits, np.maximum(start, 0), end


def _last_row(pattern: np.ndarray, texts: np.ndarray, k: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, edits, end) of the best match in each text that has one, over a band of diagonals -k to n - m + k; cell x of row i is text position i + x - k.

    Rows of the edit matrix go along the pattern; a row of all texts is computed at once, gaps in it by a running minimum.
    """
    m, n, which = len(pattern), texts.shape[1], np.arange(len(texts))
    wide = n - m + 2 * k + 1
    if wide <= 0 or not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    pad = np.full((len(texts), k + n + m + k + 2), NONE, np.uint32)
    pad[:, k : k + n] = texts
    ramp = np.arange(wide, dtype=np.int32)
    at = ramp - k
    row = np.tile(np.where((at < 0) | (at > n), FAR, at if anchored else 0).astype(np.int32), (len(texts), 1))
    for i, c in enumerate(pattern):
        new = row + (pad[:, i : i + wide] != c)
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        if i % 8 == 7:
            alive = row.min(axis=1) <= k
            if not alive.all():
                row, pad, which = row[alive], pad[alive], which[alive]
                if not len(which):
                    break
    row = np.where(at + m > n, FAR, row)
    best = row.argmin(axis=1) if len(which) else np.empty(0, np.int64)
    edits = row[np.arange(len(which)), best]
    ok = edits <= k
    return which[ok], edits[ok].astype(np.int64), at[best[ok]].astype(np.int64) + m


class Index:
    """q-grams of a block of items: sorted distinct hashes, each with the items and positions it has there. Positions of a
    q-gram in one item with gaps of the item's band width at most are one run: their diagonals fill a range of bands."""

    def __init__(self, items: list[tuple[object, str]], rate: float = EDIT_RATE, q: int = Q) -> None:
        kept = [(i, a) for i, t in items if t and len(a := normal(t.strip())) >= q]
        self.ids, self.texts = [i for i, _ in kept], [a for _, a in kept]
        lengths = np.array([len(a) for a in self.texts], np.int64)
        self.k = np.array([budget(len(a), rate, q) for a in self.texts], np.int64)
        self.need = lengths - q + 1 - self.k * q
        self.width = np.maximum(self.k, q)
        grams = [qgrams(a, q) for a in self.texts]
        every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.empty(0, np.int64)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.lexsort((at, item, every))
        every, item, at = every[order], item[order], at[order]
        begins = np.ones(len(every), bool)
        if len(every):
            begins[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > self.width[item[1:]])
        starts = np.flatnonzero(begins)
        self.item, self.low = item[starts], at[starts]
        self.high = at[np.r_[starts[1:], len(at)] - 1] if len(starts) else at
        self.grams, self.first, self.count = np.unique(every[starts], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        self.overlap = int((lengths + 4 * self.width).max(initial=0)) + 1

    def search(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, start, end, edits) of each region of text that is an item within its budget."""
        a = normal(text)
        found: dict[tuple, tuple] = {}
        for lo in range(0, max(1, len(a)), STEP):
            part = a[lo : lo + STEP + self.overlap]
            for i, start, end, edits in self._part(part):
                found.setdefault((i, start + lo), (self.ids[i], start + lo, end + lo, edits))
        return _disjoint(list(found.values()))

    def _part(self, a: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = qgrams(a)
        pos = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
        if not len(pos):
            return
        gram = np.searchsorted(self.grams, h[pos])
        gram[gram == len(self.grams)] = 0
        real = self.grams[gram] == h[pos]
        pos, gram = pos[real], gram[real]
        if not len(pos):
            return
        for i, bands in self._bands(pos, gram):
            k, w, pattern = int(self.k[i]), int(self.width[i]), self.texts[i]
            reach = 2 * w + len(pattern) + 2 * k
            padded = np.concatenate([np.full(reach, NONE, np.uint32), a, np.full(reach, NONE, np.uint32)])
            for x in np.array_split(bands, -(-len(bands) * reach // CELLS)):
                lo = x * w - k
                seen = (lo < len(a)) & (lo + reach > 0)
                lo = lo[seen]
                which, edits, start, end = align_all(pattern, padded[(lo + reach)[:, None] + np.arange(reach)], k)
                start, end = np.maximum(start + lo[which], 0), np.minimum(end + lo[which], len(a))
                yield from ((i, *r) for r in zip(start.tolist(), end.tolist(), edits.tolist(), strict=True))

    def _bands(self, pos: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, bands) that may hold a region. A text position counts once in each band that one of its q-gram's
        diagonals is in, however often the item repeats the q-gram: each q-gram that a region keeps has a position of its own.

        A region's diagonals differ by its budget at most, so the band of two widths that starts at or one before holds them all.
        """
        n = self.count[gram]
        ends = np.cumsum(n)
        keys, sums = [], []
        for lo, hi in _pieces(ends, ENTRIES):
            c = n[lo:hi]
            entry = np.repeat(self.first[gram[lo:hi]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            item, p = self.item[entry], np.repeat(pos[lo:hi], c)
            base = item * (1 << 40) + (1 << 39)
            edges = np.concatenate([base + (p - self.high[entry]) // self.width[item], base + (p - self.low[entry]) // self.width[item] + 1])
            key, at = np.unique(edges, return_inverse=True)
            keys.append(key)
            sums.append(np.bincount(at, weights=np.repeat([1.0, -1.0], len(entry)), minlength=len(key)))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        level = np.cumsum(np.bincount(at, weights=np.concatenate(sums))).astype(np.int64)  # from each key to the next
        item = key >> 40
        high = np.flatnonzero(2 * level >= np.maximum(1, self.need[item]))
        if not len(high):
            return
        size = np.minimum(key[high + 1], (item[high] + 1) << 40) - key[high]
        some = np.repeat(key[high] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        some = np.unique(np.concatenate([some, some - 1]))
        shared = self._level(key, level, some) + self._level(key, level, some + 1)
        some = some[shared >= self.need[some >> 40]]
        for i in np.unique(some >> 40).tolist():
            yield i, (some[some >> 40 == i] & ((1 << 40) - 1)) - (1 << 39)

    @staticmethod
    def _level(key: np.ndarray, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        i = np.searchsorted(key, at, side="right") - 1
        return np.where(i >= 0, level[np.maximum(i, 0)], 0)


def _pieces(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of what has the running totals ``ends``, of about ``most`` each."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _disjoint(regions: list[tuple]) -> list[tuple]:
    """Of regions of one item that overlap, the one with fewest edits, then the first."""
    kept: dict[object, tuple[list[int], list[int]]] = {}
    out: list[tuple] = []
    for r in sorted(regions, key=lambda r: (r[3], r[1])):
        starts, ends = kept.setdefault(r[0], ([], []))  # of regions that don't overlap, so both in order
        at = bisect_right(starts, r[1])
        if (at == 0 or ends[at - 1] <= r[1]) and (at == len(starts) or starts[at] >= r[2]):
            starts.insert(at, r[1])
            ends.insert(at, r[2])
            out.append(r)
    return sorted(out, key=lambda r: (r[1], str(r[0])))


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, *, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, end, edits, item_chars): each stretch of a document that is a benchmark item within its edit budget.

    Character q-grams of each document are looked up in the items' q-grams and counted in overlapping diagonal bands;
    bands that reach the q-gram lemma's bound are aligned. The benchmark is split by size into blocks of BLOCK_CHARS;
    each block is broadcast and the documents are scanned once per block, so its size is no limit and no document is
    shuffled. Upper and lower case of A-Z and the kinds of white space count as equal; start and end are code points.

    Null or empty texts hold nothing; null, blank or shorter items than q code points are never sought; an item of
    under 5 q-grams tolerates fewer edits. Repeated rows are reported each; an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    sized = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS) * 2 if total > BLOCK_CHARS else 1)
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("item_id", item_kind), *(T.StructField(c, T.LongType()) for c in ("start", "end", "edits", "item_chars"))])
    arrow_item = pa.int64() if isinstance(item_kind, T.LongType) else pa.int32() if isinstance(item_kind, T.IntegerType) else pa.string()
    parts = []
    for b in range(blocks):
        items = [(r.i, r.t) for r in sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toLocalIterator()]
        index = spark.sparkContext.broadcast(Index(items, rate))

        def task(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            x = index.value
            chars = dict(zip(x.ids, map(len, x.texts), strict=True))
            for batch in batches:
                rows, take = [], []
                for n, text in enumerate(batch.column(1).to_pylist()):
                    for hit in x.search(text) if text else ():
                        rows.append((*hit, chars[hit[0]]))
                        take.append(n)
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int32())), pa.array(cols[0], arrow_item), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.int64())], names=[f.name for f in schema])

        found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(task, schema)
        if blocks > 1:  # one block's index at a time stays with the executors
            found = written(found, "regions")
            index.unpersist()
        parts.append(found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
