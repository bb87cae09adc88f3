"""Trained models over catalogs: one-vs-rest and multinomial logistic regression, forests, chains, on pyspark.ml."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

MULTILABEL = ("frequency", "logistic_ovr", "chain_ensemble", "random_forest")
MULTICLASS = ("majority", "multinomial", "random_forest")


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(df)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with a weight n / (classes * n of the class)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_k"))
    totals = sizes.agg(F.sum("_k").alias("_n"), F.count("*").alias("_c"))
    weights = sizes.crossJoin(totals).select(F.col(label), (F.col("_n") / (F.col("_c") * F.col("_k"))).alias("_weight"))
    return df.join(weights, label)


def _scored(model: Transformer, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def logistic(df: DataFrame, label: str, *, c: float = 1.0) -> Transformer:
    n = max(1, df.count())
    return LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100).fit(balanced(df, label))


def forest(df: DataFrame, label: str, *, trees: int = 50, depth: int = 8, seed: int = 42) -> Transformer:
    return RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(balanced(df, label))


def one_vs_rest(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], fit: Callable[[DataFrame, str], Transformer] = logistic) -> DataFrame:
    """test with score_<label> for each 0/1 label column; a label with one kind in training scores its constant."""
    train, out = assembled(train, features).cache(), assembled(test, features)
    try:
        for label in labels:
            data = train.withColumn(label, F.col(label).cast("double"))
            kinds = [r[0] for r in data.select(label).distinct().orderBy(label).collect()]  # two at most
            out = out.withColumn(f"score_{label}", F.lit(kinds[0] if kinds else 0.0)) if len(kinds) < 2 else _scored(fit(data, label), out, f"score_{label}")
    finally:
        train.unpersist()
    return out.drop("_features")


def chain_ensemble(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], *, seeds: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """test with score_<label>: classifier chains in several label orders, each label seeing those before it, averaged."""
    import random

    out, names = test, {x: [] for x in labels}
    for seed in seeds:
        order = list(labels)
        random.Random(seed).shuffle(order)
        before: list[str] = []
        chained = out
        for label in order:
            inputs = [*features, *[f"_chain_{b}" for b in before]]
            data = train.withColumns({f"_chain_{b}": F.col(b).cast("double") for b in before}) if before else train
            scored = one_vs_rest(data, chained, inputs, [label])
            name = f"_s{seed}_{label}"
            chained = scored.withColumn(name, F.col(f"score_{label}")).withColumn(f"_chain_{label}", (F.col(f"score_{label}") >= 0.5).cast("double")).drop(f"score_{label}")
            names[label].append(name)
            before.append(label)
        out = chained.drop(*[f"_chain_{b}" for b in before])
    for label in labels:
        out = out.withColumn(f"score_{label}", reduce(lambda a, b: a + b, [F.col(n) for n in names[label]]) / len(names[label]))
    return out.drop(*[n for ns in names.values() for n in ns])


def multiclass(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str = "multinomial") -> DataFrame:
    """test with predicted and scores (array by label index); label is an index from 0."""
    if kind == "majority":
        top = train.groupBy(label).count().orderBy(F.desc("count"), label).limit(1).select(F.col(label).alias("predicted"))
        return test.crossJoin(F.broadcast(top))
    if kind not in MULTICLASS:
        raise ValueError(f"no such model: {kind}")
    data = balanced(assembled(train, features).withColumn(label, F.col(label).cast("double")), label)
    if kind == "multinomial":
        model = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", family="multinomial", maxIter=100, regParam=1e-3, standardization=False).fit(data)
    else:
        model = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="_weight", numTrees=50, maxDepth=10, seed=42).fit(data)
    out = model.transform(assembled(test, features)).withColumn("scores", vector_to_array("probability"))
    return out.withColumn("predicted", F.col("prediction").cast("int")).drop("_features", "rawPrediction", "probability", "prediction")


def multilabel(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], kind: str = "logistic_ovr") -> DataFrame:
    if kind == "frequency":
        shares = train.agg(*[F.avg(F.col(x).cast("double")).alias(f"score_{x}") for x in labels])
        return test.crossJoin(F.broadcast(shares))
    if kind == "chain_ensemble":
        return chain_ensemble(train, test, features, labels)
    if kind not in MULTILABEL:
        raise ValueError(f"no such model: {kind}")
    return one_vs_rest(train, test, features, labels, forest if kind == "random_forest" else logistic)


def timed(action: Callable[[], object], runs: int = 3) -> float:
    """Mean milliseconds of an action."""
    began = time.perf_counter()
    for _ in range(runs):
        action()
    return (time.perf_counter() - began) / runs * 1000


def final_test(use_test: bool, evaluate: Callable[[], DataFrame]) -> DataFrame:
    """The test split is looked at on request only."""
    if not use_test:
        raise PermissionError("the final test runs with use_test only")
    return evaluate()


def experiment_manifest(name: str, kind: str, features: Sequence[str], metrics: dict, rows: dict) -> dict:
    from datetime import datetime, timezone

    return {"id": f"{datetime.now(timezone.utc):%Y%m%d-%H%M}_{name}", "model": kind, "features": list(features), "metrics": metrics, "rows": rows}
