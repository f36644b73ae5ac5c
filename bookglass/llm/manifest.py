"""A Merkle manifest of a dataset: digests up to one root by time-forward processing, and proofs down again by a reversed sweep."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookglass.llm.common import crc32_mod, partitions, prepare, runs, written

#: Children of a node; levels that one task lifts a block of consecutive nodes by, so a block has FAN ** LEVELS nodes at most.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
#: Messages that a queue holds in memory before it writes a sorted run to the task's own temporary file.
HELD = 4096

NODES = "tree string, no long, digest string"
#: A level of a proof: the digests left and right of a node among its siblings, each concatenated.
SUFFIX = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class ExternalQueue:
    """A priority queue of (label, message) that spills: what exceeds `held` entries goes to a sorted run in a file that
    has no name and ends with the task; entries come out in the order of their labels, equal labels in that of arrival."""

    def __init__(self, held: int = HELD) -> None:
        self.held, self.heap, self.arrived = held, [], 0
        self.runs: list[Iterator] = []
        self.heads: list[tuple] = []

    def push(self, label, message) -> None:
        heapq.heappush(self.heap, (label, self.arrived, message))
        self.arrived += 1
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        out = pickle.Pickler(file, protocol=5)
        for entry in sorted(self.heap):
            out.dump(entry)
            out.clear_memo()
        file.seek(0)
        self.heap = []
        self.runs.append(self._read(file))
        self._advance(len(self.runs) - 1)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return

    def _advance(self, run: int) -> None:
        entry = next(self.runs[run], None)
        if entry is not None:
            heapq.heappush(self.heads, (*entry[:2], run, entry[2]))

    def top(self):
        """The least label, or None."""
        labels = [x[0][0] for x in (self.heap, self.heads) if x]
        return min(labels) if labels else None

    def pop(self):
        if self.heads and (not self.heap or self.heads[0][:2] < self.heap[0][:2]):
            label, _, run, message = heapq.heappop(self.heads)
            self._advance(run)
        else:
            label, _, message = heapq.heappop(self.heap)
        return label, message

    def take(self, label) -> list:
        """All messages of the label, which is the least."""
        out = []
        while self.top() == label:
            out.append(self.pop()[1])
        return out


def lift(digests: Iterable[str], levels: int, queue: Callable[[], ExternalQueue] = ExternalQueue, keep: list | None = None) -> str:
    """The digest that consecutive nodes have `levels` above, by time-forward processing: nodes are visited by label (level, number),
    and each sends its digest to its parent's label. keep: gets (label, digests of its children) of each inner node."""
    q = queue()
    for i, d in enumerate(digests):
        q.push((0, i), d)
    while True:
        label = q.top()
        children = q.take(label)
        level, no = label
        if level and keep is not None:
            keep.append((label, children))
        own = digest(*children) if level else children[0]
        if level == levels:
            return own
        q.push((level + 1, no // FAN), own)


def sweep(nodes: list, suffix: tuple, levels: int, queue: Callable[[], ExternalQueue] = ExternalQueue) -> Iterator[tuple[int, tuple]]:
    """(number, suffix) of each node at the bottom, in descending order, from what lift() kept and the suffix of its result: nodes are
    visited by falling label, and each sends to its children their siblings put before its own suffix."""
    q = queue()
    q.push((-levels, 0), suffix)
    at = len(nodes)
    while (label := q.top()) is not None:
        (above,) = q.take(label)
        level, no = -label[0], -label[1]
        if not level:
            yield no, above
            continue
        at -= 1
        children = nodes[at][1]
        for i in range(len(children)):
            q.push((1 - level, -(no * FAN + i)), (("".join(children[:i]), "".join(children[i + 1 :])), *above))


def fold(own: str, suffix: Iterable[tuple[str, str]]) -> str:
    """The root that a node's digest leads to, given the siblings on its way."""
    for left, right in suffix:
        own = digest(left, own, right)
    return own


def height(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:`, and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The leaf of a row, from its fields in their order."""
    return F.sha2(F.concat(*(field(c) for c in columns.values())).cast("binary"), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with no, their place from 0 in their tree, by the order; the counts of a range partition's trees alone are gathered.

    Rows are dealt out by ranges of (tree, order) and written, so places don't change when a task is run again.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = written(rows.repartitionByRange(4 * partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    sizes = dealt.groupBy("part", F.col(tree).alias("__tree")).agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = Window.partitionBy("__tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).select(F.col("part").alias("__part"), "__tree", "start"), "starts")
    met = (F.col("part") == F.col("__part")) & F.col(tree).eqNullSafe(F.col("__tree"))
    return dealt.join(starts, met).withColumn("no", F.col("at") + F.col("start")).drop("at", "part", "__part", "__tree", "start")


def _blocks(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """rows (tree, no, ...) dealt by block of consecutive nodes, in order; a row of `more` with the block's number comes before its nodes."""
    block = rows.withColumns({"block": F.floor(F.col("no") / BLOCK).cast("long"), "kind": F.lit(1)})
    if more is not None:
        block = block.unionByName(more.withColumnRenamed("no", "block").withColumn("kind", F.lit(0)), allowMissingColumns=True)
    block = block.withColumn("key", F.struct("tree", "block"))
    return block.repartition(2 * partitions(rows.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "kind", "no").drop("tree", "block")


def _lifted(height_of: Column, nodes: DataFrame) -> DataFrame:
    """A row per block: the digest that its nodes have LEVELS above, or fewer where the tree ends below that."""
    rows = _blocks(nodes.select("tree", "no", "digest", F.least(height_of, F.lit(LEVELS)).alias("levels")))

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, run in runs(batches, "key"):
            own = lift((r["digest"] for r in run), run[0]["levels"])
            yield pa.RecordBatch.from_pylist([{"tree": key["tree"], "no": key["block"], "digest": own}], schema=pa.schema([("tree", pa.string()), ("no", pa.int64()), ("digest", pa.string())]))

    return rows.mapInArrow(step, NODES)


def _delivered(nodes: DataFrame, suffixes: DataFrame, height_of: Column, extra: str | None, make: Callable[[dict, tuple], dict], schema: str) -> DataFrame:
    """A row per node: make(row, suffix), the suffix being that of its block's result with the block's own levels before it."""
    rows = _blocks(nodes.withColumn("levels", F.least(height_of, F.lit(LEVELS))).select("tree", "no", "digest", "levels", *([extra] if extra else [])), suffixes.select("tree", "no", "suffix"))

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (head, *run) in runs(batches, "key"):
            if not run:
                continue  # the suffix of an empty table's root
            above = tuple((s["left"], s["right"]) for s in head["suffix"])
            kept: list = []
            lift((r["digest"] for r in run), run[0]["levels"], keep=kept)
            for no, suffix in sweep(kept, above, run[0]["levels"]):
                yield make(run[no], suffix)

    def batched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema(_arrow(schema))
        rows = []
        for row in step(batches):
            rows.append(row)
            if len(rows) == 500:
                yield pa.RecordBatch.from_pylist(rows, schema=fields)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return rows.mapInArrow(batched, schema)


def _structs(suffix: tuple) -> list[dict]:
    return [{"left": a, "right": b} for a, b in suffix]


def _arrow(schema: str) -> list:
    level = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    kinds = {"string": pa.string(), "long": pa.int64(), SUFFIX: level}
    return [(name, kinds[kind]) for name, kind in (c.split(" ", 1) for c in schema.split(", "))]


def _climb(nodes: DataFrame, heights: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at every LEVELS-th level, from the given ones up, and the single node of each tree."""
    stages, done = [nodes], 0
    top = heights.agg(F.max("height")).first()[0] or 0
    while done < top:
        left = F.greatest(F.col("height") - done, F.lit(0))
        joined = stages[-1].join(heights.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree")))
        stages.append(written(_lifted(left, joined), label))
        done += LEVELS
    return stages, stages[-1]


def _descend(stages: list[DataFrame], heights: DataFrame, suffixes: DataFrame, label: str) -> DataFrame:
    """(tree, no, suffix) of the blocks above the bottom nodes, from the suffixes of the trees' single nodes."""
    for i in range(len(stages) - 2, 0, -1):
        nodes = stages[i].join(heights.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree")))
        make = lambda row, suffix: {"tree": row["key"]["tree"], "no": row["no"], "suffix": _structs(suffix)}
        left = F.greatest(F.col("height") - i * LEVELS, F.lit(0))
        suffixes = written(_delivered(nodes, suffixes, left, None, make, f"tree string, no long, suffix {SUFFIX}"), label)
    return suffixes


class Manifest:
    """Leaves, numbered in their trees, the inner nodes of every LEVELS-th level, the trees' subroots and the one root."""

    def __init__(self, spark: SparkSession, leaves: DataFrame) -> None:
        """leaves: tree, no, digest and what make() of proofs() needs."""
        self.leaves = leaves
        count = leaves.groupBy("tree").agg(F.max("no").alias("last"))
        grow = F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.struct(F.col("last").alias("n"), F.lit(0).alias("h")), lambda a, _: F.when(a["n"] > 0, F.struct(F.shiftright(a["n"], FAN.bit_length() - 1).alias("n"), (a["h"] + 1).alias("h"))).otherwise(a))["h"]
        self.heights = written(count.select("tree", grow.alias("height")), "heights")
        self.stages, subroots = _climb(leaves.select("tree", "no", "digest"), self.heights, "nodes")
        one = subroots.select(F.lit("root").alias("tree"), F.col("tree").alias("name"), "digest")
        self.subroots = written(numbered(one, "tree", ["name"]), "subroots")
        self.above = spark.createDataFrame([("root", height(self.subroots.count()))], "tree string, height int")
        self.crown, root = _climb(self.subroots.select("tree", "no", "digest"), self.above, "crown")
        self.root = (root.first() or {"digest": None})["digest"]

    def proofs(self, extra: str, make: Callable[[dict, tuple], dict], schema: str) -> DataFrame:
        """A row per leaf: make(row, proof), the proof as (left, right) siblings of each level up to the root."""
        spark = self.leaves.sparkSession
        start = spark.createDataFrame([("root", 0, [])], f"tree string, no long, suffix {SUFFIX}")
        start = _descend(self.crown, self.above, start, "down")
        nodes = self.subroots.join(self.above.withColumnRenamed("tree", "__tree"), F.col("tree") == F.col("__tree"))
        named = lambda row, suffix: {"tree": row["name"], "no": 0, "suffix": _structs(suffix)}
        start = written(_delivered(nodes, start, F.col("height"), "name", named, f"tree string, no long, suffix {SUFFIX}"), "down")
        tops = _descend(self.stages, self.heights, start, "down")
        nodes = self.leaves.join(self.heights.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree")))
        return _delivered(nodes, tops, F.col("height"), extra, make, schema)


def document_manifest(docs: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", id_col: str = "doc_id", text_col: str = "text", checked: int = 3) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    A leaf is the digest of a row's fields. Leaves of a tree (a language) ascend by id; runs of FAN become their parents
    until one is left, its subroot; subroots, by language, likewise become the root. Where `checked` divides the id's crc32 the
    text is tampered with (A-Z lower-cased), and what its leaf folds to, with the original siblings, is held against the root.

    Only ids and digests are shuffled. Leaves are numbered by range partitions; blocks of FAN ** LEVELS consecutive ones are lifted by a
    task, then blocks of their results, so one language may hold any share of the rows and no task has more than a block
    in hand; the same blocks are visited in reverse to deliver the proofs. Each stage is written to the shared folder.

    Null fields are `-`; a null language is a tree of its own, the first; null ids are first in their tree and count as an empty text
    for the crc32; rows that repeat an id are leaves of their own, in the order of their digests. Empty tables give no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    plain = {c: F.col(c) for c in fields}
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = leaf_digest(plain)
    tampered = F.when(crc32_mod(id_col, checked) == 0, leaf_digest(plain | {text_col: lower}))
    leaves = docs.select(F.col(tree).cast("string").alias("tree"), F.col(id_col).cast("long").alias("id"), own.alias("digest"), tampered.alias("tampered"))
    whole = Manifest(spark, written(numbered(leaves, "tree", ["id", "digest"]).select("tree", "no", "digest", F.struct("id", F.coalesce("tampered", "digest").alias("held")).alias("row")), "leaves"))
    root = whole.root

    def make(r: dict, suffix: tuple) -> dict:
        return {"doc_id": r["row"]["id"], "tree": r["key"]["tree"], "leaf": r["digest"], "proof_sha256": digest(*(x for level in suffix for x in level)), "folded_root": fold(r["row"]["held"], suffix)}

    out = whole.proofs("row", make, "doc_id long, tree string, leaf string, proof_sha256 string, folded_root string")
    subroots = whole.subroots.select(F.col("name").alias("__tree"), F.col("digest").alias("subroot"))
    out = out.join(subroots, F.col("tree").eqNullSafe(F.col("__tree"))).withColumn("root", F.lit(whole.root).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
