"""Array-of-double vectors in generated expressions; blocked products for all-pairs work."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(a: Column, floor: float = 1e-12) -> Column:
    """Unit vector; the norm is at least `floor`."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-300))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def weighted_distance(a: Column, query: Sequence[float], weights: Sequence[float]) -> Column:
    """sqrt(sum(w * (x - q)**2) / sum(w)) of an array column to a query."""
    if len(query) != len(weights):
        raise ValueError("query and weights differ in length")
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    total = None
    for k, (q, w) in enumerate(zip(query, weights, strict=True)):
        if w:
            part = F.lit(float(w)) * (a[k] - F.lit(float(q))) * (a[k] - F.lit(float(q)))
            total = part if total is None else total + part
    return F.sqrt(total / F.lit(float(sum(weights))))


def scaled_vectors(df: DataFrame, vector: str, *, fit_on: Column | None = None, robust: bool = False) -> DataFrame:
    """df with the array column scaled per position: mean and population deviation, or median and quartile distance.

    The statistics are one row per position, gathered to one row; a zero scale counts as 1.
    """
    fit = (df.where(fit_on) if fit_on is not None else df).select(F.posexplode(vector).alias("_i", "_x"))
    x = F.col("_x").cast("double")
    centre, spread = (F.percentile(x, 0.5), F.percentile(x, 0.75) - F.percentile(x, 0.25)) if robust else (F.avg(x), F.stddev_pop(x))
    per = fit.groupBy("_i").agg(centre.alias("c"), spread.alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    one = per.agg(F.array_sort(F.collect_list(F.struct("_i", "c", "s"))).alias("_stats"))
    joined = df.crossJoin(F.broadcast(one))  # one row
    return joined.withColumn(vector, F.zip_with(vector, "_stats", lambda v, s: (v.cast("double") - s["c"]) / s["s"])).drop("_stats")


def _top(sims: np.ndarray, asking: np.ndarray, others: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row of sims the k best other ids; others is sorted, so ties go to the smaller id."""
    sims = np.where(asking[:, None] == others[None, :], -np.inf, sims)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(sims, top, axis=1)
    r, c = np.nonzero(best > -np.inf)
    return [(asking[r], others[top[r, c]], best[r, c])]


def _nearest(k: int, metric: str, both: bool):
    """A task: rows of side 0 ask rows of side 1; with both, those ask back (a task of one block has side 0 only)."""

    def best(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        order = np.lexsort((ids, side))
        side, ids, x = side[order], ids[order], x[order]
        q, c = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if both and not len(c):
            c, both_ways = q, False
        else:
            both_ways = both
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if metric == "cosine":
                return a @ b.T
            return -np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))

        step = 512 if metric == "cosine" else 64
        for at in range(0, len(q), step):
            sims = product(x[q[at : at + step]], x[c])
            found += _top(sims, ids[q[at : at + step]], ids[c], k)
            if both_ways:
                found += _top(sims.T, ids[c], ids[q[at : at + step]], k)
        a, b, s = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return best


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dealt(df: DataFrame, key: str, vector: str, block: int) -> tuple[DataFrame, int]:
    """(id, v, c): rows dealt to blocks of about `block` rows by a hash of the key; and the number of blocks."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block))
    return rows.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def knn_join(asking: DataFrame, rows: DataFrame, key: str, vector: str, k: int, *, block: int = 4096, metric: str = "cosine") -> DataFrame:
    """(a, b, similarity, rank): for each asking row the k nearest rows with another key, exact; ties by key.

    Each block of asking rows meets each block of rows in a task: one matrix product, of which the k best of each asking
    row leave. No side is broadcast, and no task holds more than two blocks. metric: cosine, or euclidean, whose
    similarity is the distance below zero.
    """
    (ask, n_ask), (own, n_own) = _dealt(asking, key, vector, block), _dealt(rows, key, vector, block)
    left = ask.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_own - 1)))).select(F.col("c").alias("i"), "j", "id", "v", F.lit(0).alias("side"))
    right = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_ask - 1)))).select("i", F.col("c").alias("j"), "id", "v", F.lit(1).alias("side"))
    return _ranked(left.unionByName(right).groupBy("i", "j").applyInArrow(_nearest(k, metric, False), "a long, b long, similarity double"), k)


def knn_self_join(df: DataFrame, key: str, vector: str, k: int, *, block: int = 4096) -> DataFrame:
    """knn_join of a table with itself by cosine: each unordered pair of blocks is one task, whose product serves both."""
    rows, n = _dealt(df, key, vector, block)
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "id", "v", F.when(F.col("c") <= F.col("o"), 0).otherwise(1).alias("side"))
    return _ranked(met.groupBy("i", "j").applyInArrow(_nearest(k, "cosine", True), "a long, b long, similarity double"), k)
