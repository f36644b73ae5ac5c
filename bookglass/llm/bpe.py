"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bookglass.llm.common import prepare

#: Pieces remembered by a worker, and the longest piece (bytes) worth remembering.
CACHE_PIECES, CACHE_BYTES = 400_000, 64

COLUMNS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>", "decoded": "string"}


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with one "base64 rank" per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. A segment tree over the byte positions holds rank * n + position of the pair that starts
    there, so its root is the leftmost pair of the lowest rank; a merge updates three leaves."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    live = [True] * n
    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        k = after[j]
        after[i], live[j] = k, False
        if k < n:
            before[k] = i
        h = before[i]
        r = get(piece[i : after[k]]) if k < n else None
        changes = [(i, none if r is None else r * n + i), (j, none)]
        if h >= 0:
            r = get(piece[h:k])
            changes.append((h, none if r is None else r * n + h))
        for leaf, value in changes:
            p = size + leaf
            if tree[p] == value:
                continue
            tree[p] = value
            p >>= 1
            while p:
                a, b = tree[2 * p], tree[2 * p + 1]
                least = a if a <= b else b
                if tree[p] == least:
                    break
                tree[p] = least
                p >>= 1
    return [ranks[piece[i : after[i]]] for i in range(n) if live[i]]


class Codec(dict):
    """Ids of pieces (str to tuple), made on first use and kept within a bound."""

    def __init__(self, data: bytes, pattern: str) -> None:
        super().__init__()
        self.ranks = parse_ranks(data)
        size = max(self.ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, r in self.ranks.items():
            self.bytes_of[r] = token
        self.text_of = [str(i) for i in range(size)]
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(raw)
        ids = (rank,) if rank is not None else tuple(merge(raw, self.ranks))
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def id_text(self, ids: list[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec per vocabulary and worker process, kept from task to task."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """Encode every whole text, each match of pattern by itself, without special tokens, then decode the ids again.

    vocabulary: path of a rank file, read by the driver and broadcast (about 1 MB, fixed). columns: of COLUMNS;
    ``decoded`` and its digest come from the ids, not from the text. One row per input row, without a shuffle.
    Null or empty text: no ids, digests of nothing. Null or repeated ids: one row each. Only the two named columns
    are read, so others may have any name. No rows give no rows. A piece of n bytes takes O(n log n) time, so one
    very long run of letters is no trap; a text is encoded within one row's memory.
    """
    prepare(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType
    wanted = tuple(columns)
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(c, T._parse_datatype_string(COLUMNS[c])) for c in wanted])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value, pattern)
        for batch in batches:
            out: dict[str, list] = {x: [] for x in wanted}
            for text in batch.column(1).to_pylist():
                ids = c.encode(text or "")
                raw = c.decode(ids)
                for x in wanted:
                    if x == "n_tokens":
                        value: object = len(ids)
                    elif x == "ids_sha256":
                        value = hashlib.sha256(c.id_text(ids).encode()).hexdigest()
                    elif x == "decoded_sha256":
                        value = hashlib.sha256(raw).hexdigest()
                    elif x == "token_ids":
                        value = ids
                    else:
                        value = raw.decode("utf-8", "replace")
                    out[x].append(value)
            arrays = [batch.column(0)] + [pa.array(out[x], pa.list_(pa.int32()) if x == "token_ids" else pa.int64() if x == "n_tokens" else pa.string()) for x in wanted]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *wanted])

    return docs.select(id_col, text_col).mapInArrow(task, schema)
