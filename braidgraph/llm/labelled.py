"""Bounded samples of labelled documents and small linear models on the driver."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.plans.lineage import materialize

BLOCK_ROWS = 1024


def id_remainder(key: str, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


def held_out(parts: int, remainder: int) -> Column:
    """Rows whose label may not be learned; rows without an id count as such."""
    return F.coalesce(id_remainder("doc_id", parts) == remainder, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int
) -> DataFrame:
    """Up to ``rows`` labelled documents of each class: doc_id, label, place, key, weight.

    Only ids and numbers, so at most twice ``rows`` small rows; ``texts_of`` joins them
    with the whole texts in tasks. The documents with the smallest hash of their id are
    taken, and ``place`` is that hash, so the sample is the same whatever
    the partitioning. Conflicting labels of one id count as the greater one. Of an id
    with several texts the one with the smallest hash, ``key``, is taken; rows that
    repeat it share a weight of one.
    """
    marked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(allowed & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = None
    for value in (0, 1):
        part = marked.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = part.limit(rows) if chosen is None else chosen.union(part.limit(rows))
    chosen = materialize(chosen.withColumn("place", F.xxhash64("doc_id")), "chosen")
    texts = docs.select("doc_id", "text").filter("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")
    keys = found.groupBy("doc_id", "label", "place", F.xxhash64("text").alias("key"))
    keys = keys.agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "label", "place")
    best = keys.agg(F.min(F.struct("key", "n")).alias("best"))
    weight = 1 / F.col("best.n").cast("double")
    return materialize(
        best.select("doc_id", "label", "place", "best.key", weight.alias("weight")), "sample"
    )


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample's rows with their whole texts, where the documents lie."""
    texts = docs.select("doc_id", "text").filter("text is not null")
    found = texts.join(F.broadcast(sample), "doc_id")
    return found.filter(F.xxhash64("text") == F.col("key"))


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(values, -30, 30)))


def fit_logistic(
    features: np.ndarray, targets: np.ndarray, ridge: float = 1e-3, rounds: int = 50
) -> np.ndarray:
    """Weights of a logistic regression, the last one for a constant; targets in 0..1.

    Rows are taken in blocks, so that no second copy of the features is made.
    """
    size = features.shape[1] + 1
    weights = np.zeros(size)
    keep = np.full(size, ridge)
    keep[-1] = 1e-9
    for _ in range(rounds):
        slope = keep * weights
        bend = np.diag(keep + 1e-9)
        for at in range(0, len(features), BLOCK_ROWS):
            x = np.ones((len(features[at : at + BLOCK_ROWS]), size))
            x[:, :-1] = features[at : at + BLOCK_ROWS]
            chance = sigmoid(x @ weights)
            slope += x.T @ (chance - targets[at : at + BLOCK_ROWS]) / len(features)
            bend += (x * (chance * (1 - chance))[:, None]).T @ x / len(features)
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit_sparse_logistic(
    rows: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    targets: np.ndarray,
    size: int,
    ridge: float,
    rounds: int = 30,
) -> np.ndarray:
    """``fit_logistic`` for features given as (row, column, value) entries.

    Each Newton step is solved by conjugate gradients, so that memory is that of the
    entries, whatever the number of features.
    """
    n = len(targets)
    rows = np.concatenate([rows, np.arange(n)])
    columns = np.concatenate([columns, np.full(n, size)])
    values = np.concatenate([values, np.ones(n)])
    keep = np.full(size + 1, ridge)
    keep[-1] = 1e-9

    def times(vector: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * vector[columns], n)

    def back(vector: np.ndarray) -> np.ndarray:
        return np.bincount(columns, values * vector[rows], size + 1) / n

    def loss(weights: np.ndarray) -> float:
        odds = times(weights)
        return (np.logaddexp(0, odds) - targets * odds).mean() + (keep * weights**2).sum() / 2

    weights = np.zeros(size + 1)
    for _ in range(rounds):
        chance = sigmoid(times(weights))
        spread = chance * (1 - chance)
        slope = back(chance - targets) + keep * weights
        step, left = np.zeros(size + 1), slope.copy()
        along, norm = left.copy(), left @ left
        least = norm * 1e-6
        for _ in range(200):
            if norm <= least:
                break
            bent = back(spread * times(along)) + (keep + 1e-9) * along
            part = norm / (along @ bent)
            step += part * along
            left -= part * bent
            norm, old = left @ left, norm
            along = left + norm / old * along
        now, length = loss(weights), 1.0
        while loss(weights - length * step) > now and length > 1e-4:
            length /= 2
        weights = weights - length * step
        if np.abs(step).max() < 1e-6:
            break
    return weights
