"""Toxicity: a learned lexicon whose terms are found through Levenshtein automata over a trie, weighed by their context."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookglass.llm.common import crc32_mod, prepare, written
from bookglass.llm.labelled import labelled_sample, logistic

#: Labelled documents of each class that a lexicon is learned from, at most.
SAMPLE = 6000
#: Lengths of stems; share of toxic documents a term must occur in; least log odds of a term; mark of a stem among the terms.
STEMS, SUPPORT, LOG_ODDS, ANY = range(4, 9), 0.004, 3.0, "*"
#: Tokens on each side of a term that tell quotation from abuse; tokens a worker remembers, and the longest of them.
WINDOW, CACHE, LONG = 8, 1_000_000, 64
#: Ways a token can be a term: as it is; with an edit, of a short or a long word or of a stem; with two edits.
EXACT, SHORT_WORD, LONG_WORD, STEM, TWO_EDITS = WAYS = range(5)
#: Quotation marks that open, close, or do either.
OPENING, CLOSING, EITHER = "“„«‹‘‚", "”»›’", "\""


def allowed_edits(term: str) -> int:
    """Edits of a word, or of a stem (with ANY at its end), that are still taken for it."""
    if term.endswith(ANY):
        return int(len(term) > 6)
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def way_of(term: str, edits: int) -> int:
    if edits == 0:
        return EXACT
    return TWO_EDITS if edits == 2 else STEM if term.endswith(ANY) else SHORT_WORD if len(term) < 8 else LONG_WORD


def bare(token: str) -> str:
    """A token without what is not a letter or digit at its ends."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


class Automaton:
    """All strings within each term's edits of a lexicon: Levenshtein automata run along its trie, made deterministic as
    tokens ask for states. A stem's final state takes any tail."""

    def __init__(self, terms: list[str]) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.terms: list[list[str]] = [[]]  # those that end at a node: a word, a stem
        self.most = [0]  # edits that some term at or below a node allows
        for t in terms:
            at, k = 0, allowed_edits(t)
            self.most[0] = max(self.most[0], k)
            for c in t.removesuffix(ANY):
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.terms.append([])
                    self.most.append(0)
                at = self.kids[at][c]
                self.most[at] = max(self.most[at], k)
            self.terms[at].append(t)
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.sets: list[tuple[frozenset, tuple | None]] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[tuple[str, int] | None] = []
        self.dead = self._state({}, None)
        self.start = self._state({0: 0}, None)

    def _state(self, edits: dict[int, int], done: tuple[int, str] | None) -> int:
        """The number of a state: edits at each node of the trie, and (edits, stem) of the nearest stem passed already."""
        todo = list(edits)
        while todo:  # a letter of the term left out
            n = todo.pop()
            for c in self.kids[n].values():
                e = edits[n] + 1
                if e <= self.most[c] and e < edits.get(c, 99):
                    edits[c] = e
                    todo.append(c)
        hits = [(e, t) for n, e in edits.items() for t in self.terms[n] if e <= allowed_edits(t)]
        done = min([x for x in hits if x[1].endswith(ANY)] + [done] * (done is not None), default=None)
        key = frozenset(edits.items()), done
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            best = min(hits + [done] * (done is not None), default=None)
            self.accept.append(best and best[::-1])
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}
        before, done = self.sets[state]
        for n, e in before:
            if e + 1 <= self.most[n] and e + 1 < edits.get(n, 99):
                edits[n] = e + 1  # a letter too many
            for x, kid in self.kids[n].items():
                cost = e + (x != c)
                if cost <= self.most[kid] and cost < edits.get(kid, 99):
                    edits[kid] = cost
        to = self.next[state][c] = self._state(edits, done)
        return to

    def find(self, token: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its edits, the first in the alphabet of several."""
        if len(self.sets) > 100_000:
            self.reset()
        at = self.start
        for c in token:
            n = self.next[at].get(c)
            at = self._step(at, c) if n is None else n
            if not self.sets[at][0]:  # no way on but a stem's tail
                break
        return self.accept[at]


@dataclass
class Lexicon:
    """Terms (words, and stems with ANY at their end) and their weights; clean words that only look like a term; what a
    hit of each way counts, and one in quotation; the final fit."""

    terms: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    ways: tuple[float, ...] = (1.0,) * len(WAYS)
    quoted: float = 0.5
    fit: tuple[float, ...] = (0.0, 0.0)


class Scorer(dict):
    """(weight, way) of tokens (as they stand between white space, lower-cased): (0.0, EXACT) for those that are no term."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon, self.automaton = lexicon, Automaton(list(lexicon.terms))

    def match(self, word: str) -> tuple[str, int] | None:
        hit = self.automaton.find(word)
        return None if hit and hit[1] and word in self.lexicon.clean else hit

    def __missing__(self, token: str) -> tuple[float, int]:
        word = bare(token)
        hit = self.match(word) if word else None
        value = (self.lexicon.terms[hit[0]], way_of(*hit)) if hit else (0.0, EXACT)
        if len(token) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[token] = value
        return value

    def hits(self, text: str) -> list[tuple[float, int, bool]]:
        """(weight, way, quoted) of each term of a text."""
        tokens = text.lower().split()
        found = list(map(self.__getitem__, tokens))
        return [(w, way, in_quotation(tokens, i)) for i, (w, way) in enumerate(found) if w]

    def feature(self, hits: list[tuple[float, int, bool]]) -> float:
        x = self.lexicon
        return math.log1p(sum(w * x.ways[way] * (x.quoted if q else 1.0) for w, way, q in hits))

    def score(self, text: str) -> float:
        a, b = self.lexicon.fit
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self.feature(self.hits(text)) + b))))


def in_quotation(tokens: list[str], i: int) -> bool:
    """Whether a mark opens within WINDOW tokens before token i and is still open there, and one closes within as many after."""
    before = " ".join(tokens[max(0, i - WINDOW) : i]) + " " + tokens[i][: len(tokens[i]) - len(tokens[i].lstrip("".join((OPENING, EITHER))))]
    word = bare(tokens[i])
    after = tokens[i].partition(word)[2] + " " + " ".join(tokens[i + 1 : i + 1 + WINDOW])
    opened = sum(before.count(c) for c in OPENING) - sum(before.count(c) for c in CLOSING) > 0 and any(c in after for c in CLOSING)
    return opened or any(before.count(c) % 2 == 1 and c in after for c in EITHER)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and toxic ones, that hold each word and each stem, of all and of fold 0."""
    counts: dict[str, list[int]] = {}
    names = ["term", "n", "toxic", "n0", "toxic0"]

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4))], names=names)
        counts.clear()
        return out

    size = 0
    for batch in batches:
        for text, y, fold in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            words = set(map(bare, set(text.lower().split())))
            words.discard("")
            for t in words | {w[:n] + ANY for w in words for n in STEMS if len(w) >= n}:
                c = counts.get(t)
                if c is None:
                    c = counts[t] = [0, 0, 0, 0]
                    size += 100 + len(t)
                c[0] += 1
                c[1] += y
                c[2] += fold == 0
                c[3] += y * (fold == 0)
            if size > 1 << 26:
                yield flush()
                size = 0
    yield flush()


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms with their log odds, from (term, documents, toxic documents).

    A stem stands for its words where they are many; where one word has nearly all of its support, the word stands.
    """
    good: dict[str, tuple[int, float]] = {}
    for term, n, x in rows:
        odds = math.log(((x + 0.5) / (toxic + 1)) / ((n - x + 0.5) / (clean + 1)))
        if odds >= LOG_ODDS and x >= 0.9 * n and x >= max(4, SUPPORT * toxic):
            good[term] = (x, odds)
    words = {t: v for t, v in good.items() if not t.endswith(ANY)}
    stems = {t[:-1]: v for t, v in good.items() if t.endswith(ANY)}
    chosen: dict[str, float] = {}
    for s in sorted(stems, key=lambda s: (len(s), s)):
        if any(s.startswith(c) for c in chosen):
            continue
        near = 0.97 * stems[s][0]
        longest = max((q for q, v in stems.items() if q.startswith(s) and v[0] >= near), key=len)
        if not any(w.startswith(longest) and v[0] >= near for w, v in words.items()):
            chosen[longest] = stems[longest][1]
    return {w: v[1] for w, v in words.items() if not any(w.startswith(c) for c in chosen)} | {s + ANY: v for s, v in chosen.items()}


def _share(y: np.ndarray) -> float:
    """The share of toxic documents among some, leaning to a half where they are few."""
    return float((y.sum() + 1) / (len(y) + 2))


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from labelled rows whose crc32(id) mod 4 is not 2, at most about ``sample`` documents of each class.

    Words and stems are counted by Spark over the sample, and those that pass choose_terms come to the driver, with clean
    words that look like one of them and ten sums per sampled document: the sample bounds them all. What a misspelled
    hit counts, by its way, is the share of toxic documents among those with such hits alone, measured on one fold of the
    sample with the clean words of the other, as unseen texts have lookalikes of their own. What a quoted hit counts is
    that share among documents whose hits are all quoted; with none of either it is a half.
    Null and contradictory labels, null ids and labels without a document take no part; repeated rows of a document count
    each; null texts are empty. Without toxic labels, or without others, every score is the share of toxic rows.
    """
    prepare(docs.sparkSession)
    few = labelled_sample(docs, labels, label, crc32_mod(id_col, 4) != 2, sample, id_col=id_col, text_col=text_col)
    rows = written(few.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int")), "toxic-sample")
    toxic, total = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not toxic or toxic == total:
        p = (toxic + 0.5) / (total + 1) if total else 0.1
        return Lexicon(fit=(0.0, math.log(p / (1 - p))))
    counted = written(rows.mapInArrow(_count, "term string, n long, toxic long, n0 long, toxic0 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "toxic", "n0", "toxic0"))), "terms")
    found = counted.where((F.col("toxic") >= max(4, SUPPORT * toxic)) & (F.col("toxic") >= 0.9 * F.col("n"))).select("term", "n", "toxic").collect()
    lexicon = Lexicon(choose_terms(sorted(map(tuple, found)), toxic, total - toxic))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in batches:
            yield batch.take(pa.array([i for i, t in enumerate(batch.column(0).to_pylist()) if (hit := s.match(t)) and hit[1]], pa.int32()))

    words = counted.where(~F.col("term").endswith(ANY)).mapInArrow(lookalikes, counted.schema).collect()
    clean = frozenset(r["term"] for r in words if r["toxic"] < 0.5 * r["n"])
    lexicon.clean = frozenset(r["term"] for r in words if r["n0"] and r["toxic0"] < 0.5 * r["n0"])
    y, fold, sums = _sums(rows, lexicon)
    alone = lambda w: (fold == 1) & (sums[:, w].sum(axis=1) > 0) & (np.delete(sums, w, axis=1).sum(axis=(1, 2)) == 0)
    lexicon.ways = tuple(1.0 if w == EXACT else _share(y[alone(w)]) for w in WAYS)
    lexicon.clean = clean
    y, _, sums = _sums(rows, lexicon)
    lexicon.quoted = _share(y[(sums[:, :, 1].sum(axis=1) > 0) & (sums[:, :, 0].sum(axis=1) == 0)])
    each = (sums * np.array(lexicon.ways)[:, None]).sum(axis=1)
    w = logistic(np.log1p(each[:, 0] + lexicon.quoted * each[:, 1])[:, None], y, ridge=1.0)
    lexicon.fit = (float(max(0.0, w[0])), float(w[1]))
    return lexicon


def _sums(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, fold, weights by way and quotation) of each sampled document."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in batches:
            out = np.zeros((batch.num_rows, len(WAYS), 2))
            for i, text in enumerate(batch.column(1).to_pylist()):
                for w, way, q in s.hits(text):
                    out[i, way, int(q)] += w
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array([x.tobytes() for x in out], pa.binary())], names=["y", "fold", "sums"])

    t = rows.mapInArrow(task, "y int, fold int, sums binary").toArrow()
    sums = np.frombuffer(b"".join(t["sums"].to_pylist()), np.float64).reshape(-1, len(WAYS), 2)
    order = np.lexsort((*sums.reshape(len(sums), -1).T, t["y"].to_numpy()))  # so the fit does not depend on how rows come
    return t["y"].to_numpy().astype(float)[order], t["fold"].to_numpy()[order], sums[order]


def score_documents(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, predicted) of every row, over its whole text, without a shuffle; with keep, those columns before them.

    The lexicon, bounded by the sample it is learned from, is broadcast. Null or empty texts have no terms and the score of
    such texts; equal texts have equal scores. Null and repeated ids get a row each. Columns to keep may bear any names
    but "score" and "predicted", which the result's own columns have. No rows give none.
    """
    prepare(docs.sparkSession)
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"Rename {sorted(clash)} before scoring: the result has columns of these names")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    own = list(keep) or [id_col]
    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in batches:
            scores = [s.score(t or "") for t in batch.column(len(own)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())], names=[*own, "score", "predicted"])

    return docs.select(*own, F.col(text_col).alias("__text")).mapInArrow(task, schema)
