"""Quality classifier: n-gram indicators scaled by Naive Bayes log-count ratios, under a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookglass.llm.common import crc32_mod, prepare
from bookglass.llm.labelled import labelled_sample, logistic

#: Labelled documents of each class in the fit, at most; hashed features; words a worker remembers, and the longest of them.
SAMPLE, DIMENSIONS, CACHE, LONG = 4000, 1 << 18, 300_000, 64
#: Runs of a shape that make one feature; longer shapes are several in a row.
RUNS = 8
#: Penalty of the hinge loss, smoothing of the counts, passes of coordinate descent, and how far weights lean on their mean.
PENALTY, SMOOTHING, PASSES, LEAN = 0.1, 1.0, 20, 0.25
MASK = DIMENSIONS - 1


def kind(c: str) -> str:
    return "x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c


def shapes_of(word: str) -> list[str]:
    """The whole word's form, RUNS runs a piece: its kinds of characters, runs as one; X for capitals, x for other letters, 9 for digits, others as they are."""
    out: list[str] = []
    for c in word:
        k = kind(c)
        if not out or out[-1] != k:
            out.append(k)
    return ["".join(out[i : i + RUNS]) for i in range(0, len(out), RUNS)]


def _long(word: str) -> tuple[list[str], list[str]]:
    """shapes_of the word, and its distinct trigrams, over arrays of code points."""
    marked = np.frombuffer(f"<{word}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = np.unique(marked[:-2] << np.uint64(42) | marked[1:-1] << np.uint64(21) | marked[2:])
    chars, at = np.unique(marked[1:-1], return_inverse=True)
    kinds = np.array([ord(kind(chr(c))) for c in chars.tolist()], np.uint32)[at]
    runs = kinds[np.r_[True, kinds[1:] != kinds[:-1]]]
    form = runs.astype("<u4").tobytes().decode("utf-32-le")
    low = (1 << 21) - 1
    return [form[i : i + RUNS] for i in range(0, len(form), RUNS)], [chr(g >> 42) + chr(g >> 21 & low) + chr(g & low) for g in grams.tolist()]


class _Words(dict):
    """(hash, hash of the first shape, hashed character trigrams, hashes of further shapes) of whole words; long words aren't kept."""

    def __missing__(self, word: str) -> tuple[int, int, np.ndarray, list[int]]:
        h = xxhash.xxh3_64_intdigest
        if len(word) > LONG:
            forms, trigrams = _long(word)
        else:
            marked = f"<{word}>"
            forms, trigrams = shapes_of(word), [marked[i : i + 3] for i in range(len(marked) - 2)]
        grams = np.array([h(g) & MASK for g in trigrams], np.int32)
        first, *more = [h("s" + x) & 0xFFFFFFFF for x in forms]
        value = (h(word) >> 1, first, grams, more)
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def features(text: str) -> np.ndarray:
    """Sorted distinct hashed indicators of the whole text: character trigrams within words; n-grams, n to 3, of word
    shapes (those of a word of many runs in a row), each with whether the word repeats the one before."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32)
    found = [_words[w] for w in words]
    ids = np.fromiter((x[0] for x in found), np.int64, len(words))
    shapes = np.fromiter((x[1] for x in found), np.uint64, len(words)) * np.uint64(2)
    shapes[1:] += (ids[1:] == ids[:-1]).astype(np.uint64)
    if any(x[3] for x in found):
        shapes = np.array([s for own, x in zip(shapes.tolist(), found, strict=True) for s in (own, *(2 * m for m in x[3]))], np.uint64)
    parts = [x[2] for x in {w: x for w, x in zip(words, found, strict=True)}.values()]
    h = np.zeros(len(shapes), np.uint64)
    for n in range(1, 4):
        if len(shapes) < n:
            break
        h = (h[: len(shapes) - n + 1] ^ (shapes[n - 1 :] + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
        parts.append(((h >> np.uint64(40)) & np.uint64(MASK)).astype(np.int32))
    return np.unique(np.concatenate(parts))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum()) / (len(x) ** 0.5 or 1.0) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30))))


def fit(xs: list[np.ndarray], y: np.ndarray) -> Model:
    """Weights by dual coordinate descent on the squared hinge loss, then a logistic curve on a fifth kept aside.

    Indicators have the value of their log-count ratio over the root of the text's indicators, so a long text weighs as
    a short one. One class only: a constant score.
    """
    held = np.arange(len(y)) % 5 == 4
    if len(set(y.tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    train = np.flatnonzero(~held)
    count = [np.full(DIMENSIONS, SMOOTHING), np.full(DIMENSIONS, SMOOTHING)]
    for i in train:
        count[int(y[i])][xs[i]] += 1
    ratio = np.log((count[1] / count[1].sum()) / (count[0] / count[0].sum()))
    seen = count[0] + count[1] > 2 * SMOOTHING + 1  # in two documents at least
    ratio[~seen] = 0
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, 1.0, (y[train] > 0).sum() / max(1, (y[train] == 0).sum()))
    values = {i: ratio[xs[i]] / max(1.0, len(xs[i]) ** 0.5) for i in train}
    norm = {i: float(v @ v) + 1.0 for i, v in values.items()}
    w, bias = np.zeros(DIMENSIONS), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(train):
            x, v = xs[i], values[i]
            soft = 0.5 / (PENALTY * cost[i])
            g = sign[i] * (w[x] @ v + bias) - 1 + alpha[i] * soft
            new = max(alpha[i] - g / (norm[i] + soft), 0.0)
            if (d := (new - alpha[i]) * sign[i]) != 0:
                w[x] += d * v
                bias += d
                moved = max(moved, abs(d))
                alpha[i] = new
        if moved < 1e-4:
            break
    w = (1 - LEAN) * w + LEAN * np.abs(w[seen]).mean() * np.sign(w)
    weights = (w * ratio).astype(np.float32)
    model = Model(weights, float(bias), 1.0, 0.0)
    aside = np.flatnonzero(held) if len(set(y[held].tolist())) > 1 else train
    slope, offset = logistic(np.array([[model.margin(xs[i])] for i in aside]), y[aside].astype(float), ridge=0.05)
    model.slope, model.offset = float(max(0.0, slope)), float(offset)
    return model


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    """A model from labelled rows whose crc32(id) mod 3 is not 1, at most about ``sample`` documents of each class.

    Executors make the features; the fit is one task over that bounded sample; DIMENSIONS weights come to the driver.
    """
    prepare(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, crc32_mod(id_col, 3) != 1, sample, id_col=id_col, text_col=text_col)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(made, pa.binary())], names=["id", "y", "x"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sorted((r["id"] or "", r["y"], r["x"]) for b in batches for r in b.to_pylist())
        m = fit([np.frombuffer(x, np.int32) for _, _, x in every], np.array([y for _, y, _ in every], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([v], pa.float64()) for v in (m.bias, m.slope, m.offset))], names=["weights", "bias", "slope", "offset"])

    r = rows.mapInArrow(extract, "id string, y int, x binary").repartition(1).mapInArrow(solve, "weights binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"], r["offset"])


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, score, predicted) of every row, over its whole text, without a shuffle. The model (1 MB) is broadcast.

    Null or empty texts have no indicators and the score of the constant. Null and repeated ids get a row each. Other
    columns are not read. No rows give none.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = [m.score(features(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(task, schema)
