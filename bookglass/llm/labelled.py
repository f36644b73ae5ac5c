"""Bounded samples of labelled documents, and small fits over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): labelled documents, about per_class of each class at most, chosen by a hash of the id.

    The bound makes the sample broadcastable: 2 * per_class ids. Labels that contradict each other or are null, and null
    ids, are left out.
    """
    l = labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select(F.col(id_col).alias("__id"), F.col("y").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in l.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(int(10**9 * min(1.0, per_class / n)))).otherwise(share)
    few = l.where(F.pmod(F.xxhash64("__id", F.lit(label)), F.lit(10**9)) < share)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(few), F.col("id") == F.col("__id")).select("id", "text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a ridge logistic regression (last: the constant), by Newton's steps; the constant is not shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + shrink * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(shrink + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
