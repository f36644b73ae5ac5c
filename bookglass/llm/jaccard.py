"""Jaccard join of documents by word n-grams: prefix blocks, then T-occurrence search with DivideSkip inside each block."""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookglass.llm.common import partitions, prepare, runs, written
from bookglass.llm.graph import connected_components

#: Word hashes remembered by a worker; shingles looked at together when frequent ones are counted; how many of those keep a place in the order.
CACHE_WORDS, COUNT_SHINGLES, FREQUENT = 1_000_000, 2_000_000, 100_000
#: Shingles that one counting task holds; documents whose ids may be broadcast to find their texts again.
BUCKET_SHINGLES, BROADCAST_IDS = 4_000_000, 500_000
#: Shingles that one search task holds; larger blocks are cut into chunks of this size that meet pair by pair.
BLOCK_SHINGLES = 3_000_000
#: Sets in one piece of a shingle's list, and the most pieces.
PIECE, PIECES = 256, 1024
#: DivideSkip's weight of a probe against a step of the merge; probes made together.
MU, PROBES = 0.02, 1 << 20


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. Words lie between ASCII white space, with A-Z lower-cased.
    Fewer words than width: all of them as one shingle; no words: none."""
    words = text.lower().split()
    n = len(words)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    h = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        h = (h ^ w[j : n - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _mark(s: np.ndarray) -> bytes:
    """A set's digest."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Iterator[tuple[int, bytes]]]]:
    for batch in batches:
        yield batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()


def prefix_length(n: int, percent: int) -> int:
    """Two sets that link share one of their first prefix_length shingles in any common order."""
    return n - (percent * n + 99) // 100 + 1


#: Rows of the first pass: a document with the size and digest of its set; a shingle with how many documents of a chunk have it.
DOCUMENT, SHINGLE = 0, 1


def _first_pass(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A DOCUMENT row each, and SHINGLE rows for what 8 documents of those looked at together share."""
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        some = n >= 8
        k = int(some.sum())
        return pa.RecordBatch.from_arrays([pa.array([SHINGLE] * k, pa.int32()), pa.array(values[some].view(np.int64)), pa.array(n[some].astype(np.int64)), pa.nulls(k, pa.binary())], names=["kind", "key", "n", "mark"])

    for ids, texts in _texts(batches):
        sizes, marks = [], []
        for text in texts:
            s = shingles(text or b"", width)
            sizes.append(len(s))
            marks.append(_mark(s))
            held.append(s)
            size += len(s)
            if size >= COUNT_SHINGLES:
                yield frequent()
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([DOCUMENT] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], names=["kind", "key", "n", "mark"])
    yield frequent()


def _pack(a: np.ndarray, size: int = 5) -> bytes:
    """The lower ``size`` bytes of each hash; its bucket tells the upper ones apart."""
    return a.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(b: bytes, size: int = 5) -> np.ndarray:
    out = np.zeros((len(b) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def _squeeze(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _find(frequent: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are frequent, and where in the sorted list."""
    if not len(frequent):
        return np.zeros(len(t), bool), np.zeros(len(t), np.int64)
    t = t & ~np.uint64(0xFFFF)
    at = np.searchsorted(frequent, t)
    at[at == len(frequent)] = 0
    return frequent[at] == t, at


def _by_bucket(t: np.ndarray, owner: np.ndarray, buckets: int, size: int = 5) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    """(bucket, owners with how many hashes they have in it, those hashes by owner, the owners). Only owners with a hash in the bucket are
    told, so what is dealt grows with the hashes alone, however many buckets there are. owner must be sorted."""
    bucket = ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, packed = bucket[order], owner[order], _pack(t[order], size)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        who, many = _counted(owner[lo:hi])
        yield int(bucket[lo]), _squeeze(np.stack([who, many])), packed[size * lo : size * hi], who


def _counted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and how often each stands in it."""
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    return a[first].astype(np.int32), np.diff(np.r_[first, len(a)]).astype(np.int32)


def _pairs(b: bytes) -> np.ndarray:
    """What _squeeze made of two rows of 32-bit numbers."""
    return np.frombuffer(zlib.decompress(b), np.int32).reshape(2, -1)


def _deal(batches: Iterator[pa.RecordBatch], width: int, buckets: int, frequent: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """A row per batch of documents and bucket of hashes: the documents with shingles in it, how many, those shingles, and the documents'
    digests. And a row of a negative bucket with all documents, their sizes and how many frequent shingles they have."""
    for ids, texts in _texts(batches):
        sets = [(d, shingles(t or b"", width)) for d, t in zip(ids, texts, strict=True) if d is not None]
        sets = [(d, s) for d, s in sets if len(s)]
        if not sets:
            continue
        docs, sizes = np.array([d for d, _ in sets], np.int64), np.array([len(s) for _, s in sets], np.int64)
        marks = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=8).digest() for _, s in sets), np.int64)
        batch = xxhash.xxh3_64_intdigest(docs.tobytes() + marks.tobytes()) >> 1
        t = np.concatenate([s for _, s in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        often, _ = _find(frequent, t)
        many = np.bincount(owner[often], minlength=len(sets)).astype(np.int64)
        rows = [*_by_bucket(t[~often], owner[~often], buckets, size), (-1 - batch % buckets, _squeeze(np.stack([docs, sizes, many])), b"", np.empty(0, np.int64))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([batch] * len(rows), pa.int64()),
                pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.binary()),
                pa.array([marks[r[3]].tobytes() for r in rows], pa.binary()),
            ],
            names=["bucket", "batch", "counts", "tokens", "marks"],
        )


def _shared(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(batch, about, shared): for each batch in a bucket, its documents there with how many of these shingles other sets have too."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        known = [_pairs(c) for _, c, _, _ in rows]
        counts = [k[1] for k in known]
        t = _unpack(b"".join(r[2] for r in rows), size)
        mark = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
        owner = np.repeat(np.arange(len(mark), dtype=np.int64), np.concatenate(counts))
        order = np.argsort(t)
        same = t[order][1:] == t[order][:-1]
        twice = order[np.r_[same, False] | np.r_[False, same]]  # shingles that stand here more than once; copies of one set still count as one
        tt, mm = t[twice], mark[owner[twice]]
        order = np.lexsort((mm, tt))
        tt, mm = tt[order], mm[order]
        new = np.r_[True, tt[1:] != tt[:-1]] if len(tt) else np.empty(0, bool)
        other = np.r_[False, (tt[1:] == tt[:-1]) & (mm[1:] != mm[:-1])] if len(tt) else new
        group = np.cumsum(new) - 1
        wide = np.bincount(group, weights=other)[group] > 0 if len(tt) else new
        shared = np.bincount(owner[twice[order][wide]], minlength=len(mark)).astype(np.int32)
        ends = np.cumsum([len(c) for c in counts])[:-1]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array([_squeeze(np.stack([k[0], x])) for k, x in zip(known, np.split(shared, ends), strict=True)], pa.binary())], names=["batch", "about", "shared"])

    current, rows = None, []
    for batch in batches:
        passed = []
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if bucket < 0:
                passed.append(row)
                continue
            if bucket != current and rows:
                yield settle(rows)
                rows = []
            current = bucket
            rows.append(tuple(row))
        if passed:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in passed], pa.int64()), pa.array([r[1] for r in passed], pa.binary()), pa.nulls(len(passed), pa.binary())], names=["batch", "about", "shared"])
    if rows:
        yield settle(rows)


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Documents with fewer shingles of their own than prefix_length: all others share none of any prefix, and link with nothing."""

    def settle(about: bytes | None, shared: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if about is not None:
            doc, n, often = np.frombuffer(about, np.int64).reshape(3, -1)
            own = n - often
            for who, many in shared:
                own[who] -= many
            yield pa.RecordBatch.from_arrays([pa.array(doc[own < n - (percent * n + 99) // 100 + 1])], names=["doc"])

    current, about, shared = None, None, []
    for batch in batches:
        for key, a, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != current:
                yield from settle(about, shared)
                current, about, shared = key, None, []
            if a is not None:
                about = zlib.decompress(a)
            else:
                shared.append(_pairs(x))
    yield from settle(about, shared)


def _postings(batches: Iterator[pa.RecordBatch], buckets: int, frequent: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """As _deal, for sets of candidates: a row per batch and bucket, and one of a negative bucket with the candidates,
    their sizes and, in place of the hashes, their frequent shingles as (candidate, rank)."""
    for batch in batches:
        docs = batch.column(0).to_numpy().astype(np.int64)
        if not len(docs):
            continue
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        t, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        key = xxhash.xxh3_64_intdigest(docs.tobytes() + t.tobytes()) >> 1
        often, at = _find(frequent, t)
        about = (-1 - key % buckets, _squeeze(np.stack([docs, sizes])), _squeeze(np.stack([owner[often], rank[at[often]]])) if often.any() else b"")
        rows = [*(r[:3] for r in _by_bucket(t[~often], owner[~often], buckets)), about]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([key] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "batch", "counts", "tokens"])


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _postings by bucket, less the hashes that stand in one set alone, with how many sets have each."""
    names = ["bucket", "batch", "counts", "tokens", "times"]

    def settle(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        known = [_pairs(c) for _, c, _ in rows]
        counts = [k[1] for k in known]
        t = _unpack(b"".join(r[2] for r in rows))
        owner = np.repeat(np.arange(sum(len(c) for c in counts), dtype=np.int64), np.concatenate(counts))
        _, at, n = np.unique(t, return_inverse=True, return_counts=True)
        n = n[at]
        some = n > 1
        left = np.bincount(owner[some], minlength=sum(len(c) for c in counts)).astype(np.int32)
        per_row = np.split(left, np.cumsum([len(c) for c in counts])[:-1])
        ends = np.cumsum([0, *(int(c.sum()) for c in per_row)]).tolist()
        t, n = t[some], n[some].astype(np.uint32)
        pieces = list(zip(ends, ends[1:]))
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([_squeeze(np.stack([k[0], c])) for k, c in zip(known, per_row, strict=True)], pa.binary()), pa.array([_pack(t[a:b]) for a, b in pieces], pa.binary()), pa.array([_squeeze(n[a:b]) for a, b in pieces], pa.binary())], names=names)

    current, rows = None, []
    for batch in batches:
        passed = []
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if bucket < 0:
                passed.append((bucket, *row))
                continue
            if bucket != current and rows:
                yield settle(current, rows)
                rows = []
            current = bucket
            rows.append(tuple(row))
        if passed:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in passed], pa.int32()), pa.array([r[1] for r in passed], pa.int64()), pa.array([r[2] for r in passed], pa.binary()), pa.array([r[3] for r in passed], pa.binary()), pa.nulls(len(passed), pa.binary())], names=names)
    if rows:
        yield settle(current, rows)


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From the rows of _times by batch, (doc, n, shingle, pieces, piece): of a candidate's shingles that others may have,
    those among its first prefix_length, with the pieces that the shingle's list is dealt in. Its own come first, then by the number of sets, and frequent ones last, by rank: an order
    that all sets have in common."""

    def settle(rows: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        about = next((r for b, r in rows.items() if b < 0), None)
        if about is None:
            return
        docs, sizes = np.frombuffer(zlib.decompress(about[0]), np.int64).reshape(2, -1)
        owners, keys, times = [], [], []
        if about[1]:
            owner, rank = np.frombuffer(zlib.decompress(about[1]), np.int32).reshape(2, -1)
            owners, keys, times = [owner], [rank.astype(np.int64) | (1 << 62)], [np.full(len(rank), 1 << 40, np.int64)]
        for bucket, (counts, tokens, n) in rows.items():
            if bucket >= 0 and tokens:
                owners.append(np.repeat(*_pairs(counts)))
                keys.append(_unpack(tokens).view(np.int64) + (bucket << 40))
                times.append(np.frombuffer(zlib.decompress(n), np.uint32).astype(np.int64))
        if not owners:
            return
        owner, key, time = np.concatenate(owners), np.concatenate(keys), np.concatenate(times)
        order = np.lexsort((key, time, owner))
        owner, key, time = owner[order], key[order], time[order]
        k = np.bincount(owner, minlength=len(docs))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
        kept = place < (prefix_length(sizes, percent) - (sizes - k))[owner]
        doc, pieces = docs[owner[kept]], np.clip(-(-time[kept] // PIECE), 1, PIECES).astype(np.int32)
        piece = ((doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % pieces.astype(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sizes[owner[kept]]), pa.array(key[kept]), pa.array(pieces), pa.array(piece)], names=["doc", "n", "shingle", "pieces", "piece"])

    current, rows = None, {}
    for batch in batches:
        for bucket, key, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != current:
                yield from settle(rows)
                current, rows = key, {}
            rows[bucket] = tuple(row)  # equal batches have equal rows
    yield from settle(rows)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, a, b) of rows (shingle, piece, pieces, doc) in that order: each set with the first of its piece, and the
    first of each piece of a list of several with b null."""
    current = head = None
    for batch in batches:
        out: list[tuple] = []
        for shingle, piece, pieces, doc in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (shingle, piece) != current:
                current, head = (shingle, piece), doc
                if pieces > 1:
                    out.append((shingle, doc, None))
            elif doc != head:
                out.append((shingle, doc, head))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["shingle", "a", "b"])


def _met(postings: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets of each shingle's list. Lists are dealt in pieces, whose first sets meet in a second step."""
    n = partitions(postings.sparkSession)
    order = ["shingle", "piece", "pieces", "doc"]
    star = lambda df: df.repartition(n, "shingle", "piece").sortWithinPartitions(*order).mapInArrow(_stars, "shingle long, a long, b long")
    pieces = written(star(postings.select(*order)), "stars")
    heads = star(pieces.where("b is null").select("shingle", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.col("a").alias("doc")))
    return pieces.where("b is not null").unionByName(heads).select("a", "b").distinct()


def linked(a: int, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles with a in common have 100 * intersection >= percent * union."""
    return a * (100 + percent) >= percent * (n + m)


class Search:
    """Inverted lists over sets added in the order of size, and a T-occurrence search of each new set before it is added."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def overlaps(self, tokens: list[int], n: int, skip) -> Iterator[tuple[int, int]]:
        """(set, overlap) of the sets before that link with a set of n shingles, save those that skip(set) names when
        they come up. tokens: those of its shingles that any other set may have."""
        p = self.percent
        low = bisect_left(self.sizes, -(-p * n // 100))  # smaller sets can't link
        if low == len(self.sizes):
            return
        need = -(-p * (n + self.sizes[low]) // (100 + p))
        found = [x for t in tokens if (x := self.lists.get(t)) and x[-1] >= low]
        if len(found) < need:
            return
        found.sort(key=len)
        longest = len(found[-1])
        long = min(need - 1, int(need / (MU * math.log2(longest + 1) + 1)))
        short, rest = found[: len(found) - long], found[len(found) - long :]
        merged = heapq.merge(*(x[bisect_left(x, low) :] if x[0] < low else x for x in short)) if len(short) > 1 else iter(short[0])
        current, seen = -1, 0
        for i in merged:
            if i == current:
                seen += 1
                continue
            if seen >= need - long and (a := self._probe(current, seen, n, rest, skip)):
                yield current, a
            current, seen = i, 1
        if seen >= need - long and (a := self._probe(current, seen, n, rest, skip)):
            yield current, a

    def _probe(self, i: int, seen: int, n: int, lists: list[list[int]], skip) -> int:
        if skip(i):
            return 0
        need = -(-self.percent * (n + self.sizes[i]) // (100 + self.percent))
        spare = seen + len(lists) - need
        for x in lists:
            if spare < 0:
                return 0
            at = bisect_left(x, i)
            if at < len(x) and x[at] == i:
                seen += 1
            else:
                spare -= 1
        return seen if seen >= need else 0

    def add(self, tokens: list[int], n: int) -> None:
        i = len(self.sizes)
        self.sizes.append(n)
        for t in tokens:
            self.lists.setdefault(t, []).append(i)


def spanning_links(sets: list[tuple[int, int, list[int]]], percent: int) -> list[tuple[int, int]]:
    """Links (id, id) that span the link graph of (id, side, tokens); with two sides in it, links within a side may be left out.

    A set is not held against sets that it is connected with already, so a group of near copies costs a few probes per
    member and yields one link per member, not all its pairs.
    """
    sides = {s for _, s, _ in sets}
    sets = sorted(sets, key=lambda x: (len(x[2]), x[0]))
    # Tokens of one set alone have no list worth keeping.
    many: dict[int, int] = {}
    for _, _, tokens in sets:
        for t in tokens:
            many[t] = many.get(t, 0) + 1
    search, root, out = Search(percent), list(range(len(sets))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for j, (doc, side, tokens) in enumerate(sets):
        skip = lambda i, j=j, side=side: top(i) == top(j) or (len(sides) > 1 and sets[i][1] == side)
        own = [t for t in tokens if many[t] > 1]
        for i, _ in search.overlaps(own, len(tokens), skip):
            out.append((sets[i][0], doc))
            root[top(i)] = top(j)
        search.add(own, len(tokens))
    return out


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets that stand in any of some ascending lists, in order, and in how many. The lists are runs of one array, which a stable
    sort merges run by run."""
    return np.unique(np.concatenate(lists), return_counts=True) if len(lists) > 1 else (lists[0], np.ones(len(lists[0]), np.int64))


def every_link(sets: list[tuple[int, int, np.ndarray, int]], percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of (id, side, tokens, copies): links that span the link graph, and for each set the copies of all sets it links
    with. Sets of one side other than 0 aren't held against each other.

    DivideSkip over the lists of the sets that come before. Of a set's lists, the longest are kept apart, fewer than the occurrences
    that a link needs; the short ones are merged and their occurrences counted; the sets with enough of these are
    probed in the long lists by binary search, and leave as soon as the lists left can't make up what they lack. A list that most
    sets are in is told by its gaps, the sets that are not in it: these are what is merged, so near copies cost what they differ in.
    """
    m = len(sets)
    order = sorted(range(m), key=lambda i: (len(sets[i][2]), sets[i][0]))
    ids = [sets[i][0] for i in order]
    side, copies = (np.array([sets[i][k] for i in order], np.int64) for k in (1, 3))
    sizes = np.array([len(sets[i][2]) for i in order], np.int64)
    _, token, times = np.unique(np.concatenate([sets[i][2] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    # Tokens of one set alone can't be shared.
    some = times[token] > 1
    owner, token = owner[some], token[some]
    inner = np.lexsort((times[token], owner))
    owner, token = owner[inner], token[inner]
    start = np.searchsorted(owner, np.arange(m + 1))
    by_token = np.argsort(token, kind="stable")
    lists, first = owner[by_token], np.searchsorted(token[by_token], np.arange(len(times) + 1))
    entries = token[by_token] * m + lists  # all lists one after another, each ascending

    most = np.flatnonzero(times > m // 2) if m > 2 else np.empty(0, np.int64)
    place = np.full(len(times), -1)
    place[most] = np.arange(len(most))
    gaps = [np.setdiff1d(np.arange(m), lists[first[t] : first[t + 1]], assume_unique=True) for t in most]
    lacking = np.bincount(np.concatenate([np.empty(0, np.int64), *gaps]), minlength=m)

    def part(x: np.ndarray, low: int, high: int) -> np.ndarray:
        return x[np.searchsorted(x, low) : np.searchsorted(x, high)]

    root, degree, out = np.arange(m), np.zeros(m, np.int64), []
    for j in range(m):
        n = int(sizes[j])
        low = int(np.searchsorted(sizes[:j], -(-percent * n // 100)))  # smaller sets can't link
        if low == j:
            continue
        need = -(-percent * (n + int(sizes[low])) // (100 + percent))
        own = token[start[j] : start[j + 1]]
        common = place[own]
        rare, common = own[common < 0], common[common >= 0]
        need -= len(common)
        if need > len(rare):
            continue
        long = min(need - 1, int(need / (MU * math.log2(times[rare[-1]] + 1) + 1))) if need > 1 else 0
        short = [x for t in rare[: len(rare) - long].tolist() if len(x := part(lists[first[t] : first[t + 1]], low, j))]
        near, seen = _merged(short) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        if need > 0:
            enough = seen >= need - long
            near, seen = near[enough], seen[enough]
        else:  # what most sets have is enough by itself
            count = np.zeros(j - low, np.int64)
            count[near - low] = seen
            near, seen = np.arange(low, j), count
        if side[j]:
            other = side[near] != side[j]
            near, seen = near[other], seen[other]
        if not len(near):
            continue
        if len(most):
            lacks = np.ones(len(most), bool)
            lacks[common] = False
            both = [x for t in np.flatnonzero(lacks).tolist() if len(x := part(gaps[t], low, j))]
            seen = seen + len(common) - lacking[near]
            if both:
                count = np.bincount(np.concatenate(both) - low, minlength=j - low)
                seen = seen + count[near - low]
        wanted = -(-percent * (n + sizes[near]) // (100 + percent))
        left = rare[len(rare) - long :]
        while len(left):  # as many long lists at a time as a million probes are
            some = left[: max(1, PROBES // len(near))]
            keys = (some[:, None] * m + near).ravel()
            at = np.searchsorted(entries, keys)
            at[at == len(entries)] = 0
            seen = seen + (entries[at] == keys).reshape(len(some), -1).sum(0)
            left = left[len(some) :]
            alive = seen + len(left) >= wanted
            near, seen, wanted = near[alive], seen[alive], wanted[alive]
            if not len(near):
                break
        near = near[seen >= wanted]
        if not len(near):
            continue
        degree[near] += copies[j]
        degree[j] += copies[near].sum()
        top = root[near]
        while (root[top] != top).any():
            top = root[top]
        tops, which = np.unique(top, return_index=True)
        out += [(ids[i], ids[j]) for i in near[which].tolist()]
        root[tops] = root[near] = root[j] = tops[0]
    return out, [(d, int(x)) for d, x in zip(ids, degree.tolist(), strict=True) if x]


def _distinct(rows: list[dict]) -> list[dict]:
    return list({(r["doc"], r["tokens"]): r for r in reversed(rows)}.values())


def _search_all(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that span the link graph of each block, as (a, b), and (mark, how many documents its own links lead to)."""
    for _, rows in runs(batches, "block"):
        if len(rows) > 1:
            rows = _distinct(rows)
            links, degrees = every_link([(i, r["side"], np.frombuffer(r["tokens"], np.uint64), r["copies"]) for i, r in enumerate(rows)], percent)
            columns = [[rows[i]["doc"] for i, _ in links] + [None] * len(degrees), [rows[j]["doc"] for _, j in links] + [None] * len(degrees), [None] * len(links) + [rows[i]["mark"] for i, _ in degrees], [None] * len(links) + [x for _, x in degrees]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["a", "b", "mark", "n_links"])


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for _, rows in runs(batches, "block"):
        if len(rows) > 1:
            links = spanning_links([(r["doc"], r["side"], np.frombuffer(r["tokens"], np.uint64).tolist()) for r in _distinct(rows)], percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80, count_links: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id) per row, and n_links if count_links: documents link when 100 * intersection >= percent * union of their word
    shingle sets; component_id is the smallest id reachable by links, itself included; n_links is the number of other documents
    a document links with.

    1. One pass gives each set's size and digest; equal sets collapse to one representative (pre-aggregated: a third of
       all rows may be copies of one text). Shingles that many documents of one task share are noted as frequent.
    2. The other shingles are dealt by hash, five bytes each, packed by batches of documents, and each document gets back
       how many of its own other sets have too. Frequent ones needn't be dealt, so no bucket holds one that very many
       documents share. A document with n - ceil(t n) + 1 shingles that no other set has links with nothing.
    3. Shingles of candidates are dealt and counted in the same way. Candidates that share one of their rarest n - ceil(t n) + 1 shingles meet in a block, by connected components. A
       block above BLOCK_SHINGLES is cut by size class and salt into chunks, and chunks whose sizes can link meet pair
       by pair, so no task's memory grows with the block.
    4. In each block, T-occurrence search by DivideSkip: short lists are merged (by a heap where sets connected already are
       skipped, so a group of near copies yields a spanning forest, not its pairs), long ones probed. With count_links, every link is
       verified, once over all blocks, and counted with the copies at its other end; pairs aren't written.
    5. Components of the links, spread to the copies.

    Links and their numbers are exact (64-bit shingle hashes). Counting takes time for all pairs of a group. Null or empty texts, and texts without words, have 0 shingles and link with nothing. Null ids link with
    nothing and have a null component. Rows that repeat an id get a row each and are one document: with different texts,
    it links through each of them, its rows have one component, and n_links is that of the row's text. Other columns are
    not read, so their names may be any. No rows give no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    sc, n = spark.sparkContext, partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    seen = written(base.mapInArrow(lambda it: _first_pass(it, width), "kind int, key long, n long, mark binary"), "signatures")
    signed = seen.where(F.col("kind") == DOCUMENT).select(F.col("key").alias("doc"), "n", "mark")
    often = seen.where(F.col("kind") == SHINGLE).groupBy(F.shiftleft(F.shiftright("key", 16), 16).alias("shingle")).agg(F.sum("n").alias("n"))
    top = often.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    sent = sc.broadcast((np.sort(top), (len(top) - np.argsort(top)).astype(np.int32)))
    total = signed.agg(F.sum("n")).first()[0] or 0
    tasks = max(n, -(-total // BUCKET_SHINGLES))
    buckets = 2 * tasks

    # Hashes that agree by chance only add candidates: four bytes keep them below one in 500, five where buckets are larger.
    size = 4 if total <= buckets << 23 else 5
    dealt = base.mapInArrow(lambda it: _deal(it, width, buckets, sent.value[0], size), "bucket int, batch long, counts binary, tokens binary, marks binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(lambda it: _shared(it, size), "batch long, about binary, shared binary")
    few = shared.repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(lambda it: _candidates(it, percent), "doc long")
    named = signed.where("n > 0 and doc is not null")
    first = written(named.groupBy("mark").agg(F.min("doc").alias("doc"), *([F.count_distinct("doc").alias("copies")] if count_links else [])), "first")
    several = named.groupBy("doc").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("doc")
    tied = named.join(several, "doc").select(F.col("doc").alias("a"), "mark").join(first.select(F.col("doc").alias("b"), "mark"), "mark").where("a <> b").select("a", "b")
    candidates = written(few.distinct().join(first.select("doc").distinct(), "doc"), "candidates")
    if candidates.count() <= BROADCAST_IDS:
        candidates = F.broadcast(candidates)
    tokens = written(base.join(candidates, "doc").mapInArrow(lambda it: _tokens(it, width), "doc long, n long, mark binary, tokens binary"), "tokens")

    total = tokens.agg(F.sum(F.length("tokens"))).first()[0] or 0
    tasks = max(n, -(-total // (8 * BUCKET_SHINGLES)))
    lists = 2 * tasks
    every = tokens.select("doc", "tokens").mapInArrow(lambda it: _postings(it, lists, *sent.value), "bucket int, batch long, counts binary, tokens binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    timed = every.mapInArrow(_times, "bucket int, batch long, counts binary, tokens binary, times binary")
    postings = written(timed.repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(lambda it: _prefixes(it, percent), "doc long, n long, shingle long, pieces int, piece int"), "prefixes")
    sizes = postings.select("doc", "n").distinct()
    blocks = connected_components(_met(postings)).withColumnRenamed("node", "doc").join(sizes, "doc")
    blocks = written(blocks.withColumn("class", F.floor(F.log("n") / (math.log(100 / percent) * 1.0001)).cast("int")), "blocks")
    deal = lambda df: df.repartition(n, "block").sortWithinPartitions("block", "doc")
    if not count_links:
        links = written(deal(tokens.select("doc", "n", "tokens").join(_assigned(blocks), ["doc", "n"])).mapInArrow(lambda it: _search(it, percent), "a long, b long"), "links")
    else:
        met = tokens.join(first, ["doc", "mark"]).join(_assigned(blocks), ["doc", "n"])
        found = written(deal(met).mapInArrow(lambda it: _search_all(it, percent), "a long, b long, mark binary, n_links long"), "links")
        links = found.where("b is not null").select("a", "b")
    links = links.unionByName(tied)
    parts = connected_components(links).withColumnRenamed("node", "doc")
    marked = first.join(parts, "doc", "left")
    if count_links:
        degrees = found.where("mark is not null").groupBy("mark").agg(F.sum("n_links").alias("n_links"))
        marked = marked.join(degrees, "mark", "left")
    extra = [(F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")] if count_links else []

    marked = marked.select(F.col("mark").alias("m"), F.coalesce("component", "doc").alias("component"), *extra)
    out = signed.join(marked, (F.col("mark") == F.col("m")) & (F.col("n") > 0) & F.col("doc").isNotNull(), "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []))


def _tokens(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for ids, texts in _texts(batches):
        sets = [shingles(t or b"", width) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([_mark(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc", "n", "mark", "tokens"])


def _assigned(blocks: DataFrame) -> DataFrame:
    """(doc, n, block, side): the search blocks each document takes part in; one, unless its block is too large for a task."""
    total = blocks.groupBy("component").agg(F.sum("n").alias("total"))
    sized = blocks.join(total, "component")
    small = sized.where(F.col("total") <= BLOCK_SHINGLES).select("doc", "n", F.xxhash64("component").alias("block"), F.lit(0).alias("side"))
    large = sized.where(F.col("total") > BLOCK_SHINGLES)
    chunks = large.groupBy("component", "class").agg(F.ceil(F.sum("n") / (BLOCK_SHINGLES // 2)).cast("int").alias("k"))
    salted = large.join(chunks, ["component", "class"]).withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
    key = lambda c1, s1, c2, s2: F.xxhash64("component", c1, s1, c2, s2)
    every = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    within = every.select("doc", "n", key("class", F.least("salt", "other"), "class", F.greatest("salt", "other")).alias("block"), F.when(F.col("salt") == F.col("other"), 0).otherwise(F.when(F.col("salt") < F.col("other"), 1).otherwise(2)).alias("side"))
    parts = [small, within]
    for step in (1, -1):
        near = chunks.select("component", (F.col("class") - step).alias("class"), F.col("k").alias("k2"))
        across = salted.join(near, ["component", "class"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
        there = F.col("class") + step
        pair = key("class", "salt", there, "other") if step == 1 else key(there, "other", "class", "salt")
        parts.append(across.select("doc", "n", pair.alias("block"), F.lit(1 if step == 1 else 2).alias("side")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
