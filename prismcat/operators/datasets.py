"""Datasets for classifiers: rows in order, features and labels as arrays, contracts, training matrices, serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prismcat.functions.features import impute_with_indicator, multi_hot
from prismcat.functions.vectors import scaled_vectors
from prismcat.operators.quality import ContractError

POLICIES = ("A", "B")


def multilabel_dataset(entities: DataFrame, links: DataFrame, features: Sequence[str], *, key: str = "id", label: str = "label") -> DataFrame:
    """(key, x, y): features as an array, and 0/1 for each label of links in the labels' order; unlabelled entities are left out.

    Written or read in order of the key: order is made where it is needed, with write_parquet(order_by=...).
    """
    catalog = links.where(F.col(label).isNotNull()).agg(F.array_sort(F.collect_set(label)).alias("_catalog"))  # one row of label names
    own = links.groupBy(key).agg(F.collect_set(label).alias("_own"))
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    return entities.join(own, key).crossJoin(F.broadcast(catalog)).select(key, x, multi_hot(F.col("_own"), F.col("_catalog")).alias("y"))


def multiclass_dataset(entities: DataFrame, links: DataFrame, features: Sequence[str], *, key: str = "id", label: str = "label") -> DataFrame:
    """(key, x, label): the entities with exactly one label."""
    single = links.groupBy(key).agg(F.count_distinct(label).alias("_n"), F.min(label).alias(label)).where("_n = 1").drop("_n")
    return entities.join(single, key).select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("x"), label)


def check_dataset(data: DataFrame, *, key: str = "id", arrays: Sequence[str] = ("x", "y")) -> None:
    """A key for every row and once only, and arrays of one length each without nulls; else ContractError. One aggregation."""
    parts = [F.count("*").alias("n"), F.count_distinct(key).alias("keys")]
    for a in arrays:
        parts += [F.min(F.size(a)).alias(f"{a}_least"), F.max(F.size(a)).alias(f"{a}_most"), F.count_if(F.col(a).isNull() | F.exists(a, lambda v: v.isNull())).alias(f"{a}_nulls")]
    found = data.agg(*parts).first()
    wrong = [] if found["n"] == found["keys"] else [f"{found['n']} rows, {found['keys']} keys"]
    wrong += [f"{a}: lengths {found[f'{a}_least']} to {found[f'{a}_most']}" for a in arrays if found[f"{a}_least"] != found[f"{a}_most"]]
    wrong += [f"{a}: {found[f'{a}_nulls']} rows with nulls" for a in arrays if found[f"{a}_nulls"]]
    if wrong:
        raise ContractError("; ".join(wrong))


def apply_policy(rows: DataFrame, policy: str, incomplete: Column, features: Sequence[str], train: Column) -> tuple[DataFrame, list[str]]:
    """The experiment's rows and its features: A leaves incomplete rows out, B keeps them with the training rows' medians and a 0/1 feature."""
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    if policy == "A":
        return rows.where(~incomplete), list(features)
    return impute_with_indicator(rows, features, incomplete, train), [*features, "imputed"]


def training_matrix(data: DataFrame, *, split: str = "split", use_test: bool = False) -> DataFrame:
    """data (x, split) with x scaled by the training rows' means and deviations; test rows are there on request only."""
    scaled = scaled_vectors(data, "x", fit_on=F.col(split) == "train")
    return scaled if use_test else scaled.where(F.col(split) != "test")


def score_matrix(parts: Sequence[Column]) -> Column:
    """One array of scores from a list of per-label outputs: a probability, or an array of both kinds' probabilities, of which the last counts; an empty array scores 0."""
    return F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts])


def last_of(probabilities: Column) -> Column:
    """The positive kind's probability of an array per kind; a model that saw one kind has one entry, which is 0 for the negative kind."""
    return F.when(F.size(probabilities) > 1, F.element_at(probabilities, -1)).otherwise(F.lit(0.0))


def serve(scores: DataFrame, key: str, value: int | str, labels: Sequence[str], *, k: int = 5, threshold: float | None = None) -> DataFrame:
    """(prediction_rank, label, score, passed_threshold) of one row's array of scores: the k best, ties by label order. Without the row, nothing."""
    one = scores.where(F.col(key) == F.lit(value)).limit(1)
    entries = F.transform("scores", lambda s, i: F.struct((-s).alias("o"), i.alias("i"), s.alias("score")))
    best = one.select(F.posexplode(F.slice(F.array_sort(entries), 1, k)).alias("p", "e"))
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("e.i") + 1)
    return best.select((F.col("p") + 1).alias("prediction_rank"), name.alias("label"), F.col("e.score").alias("score"), (F.col("e.score") >= F.lit(threshold) if threshold is not None else F.lit(True)).alias("passed_threshold"))
