"""Folds, bounded training samples and logistic calibration for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str = "doc_id") -> Column:
    """True for rows that no classifier learns from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most_rows: tuple[int, int]) -> DataFrame:
    """(doc_id, text, y): the whole texts of at most most_rows rows of labels 0 and 1 outside the held-out fold, those with the least hash of doc_id.

    Ids that are labelled both ways count with each label; labels other than 0 and 1 are left out. A null text is empty.
    """
    usable = labels.where(~held_out()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    picked = None
    for y in (0, 1):
        own = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows[y])
        picked = own if picked is None else picked.union(own)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; x has a column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
