"""Feature columns: encodings, scaling, imputation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def minutes(ms: Column) -> Column:
    return ms / F.lit(60000.0)


def log_duration(ms: Column) -> Column:
    return F.log1p(ms)


def cyclic(value: Column, period: int = 12) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle."""
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def one_hot(value: Column, categories: Sequence) -> Column:
    """0/1 for each category in the order given; an unseen or null value gives zeros only."""
    return F.array(*[F.coalesce((value == F.lit(c)).cast("double"), F.lit(0.0)) for c in categories])


def multi_hot(labels: Column, catalog: Column) -> Column:
    """0/1 for each label of the catalog array; unknown labels are ignored."""
    return F.transform(catalog, lambda c: F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("tinyint"))


def decode_multi_hot(flags: Column, catalog: Column) -> Column:
    return F.filter(F.zip_with(flags, catalog, lambda f, c: F.when(f == 1, c)), lambda x: x.isNotNull())


def constant_pattern(df: DataFrame, pattern: dict[str, float]) -> Column:
    """True where every present column of the pattern has its value; vacuously true without any; null is no match."""
    parts = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in pattern.items() if c in df.columns]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that the frame has, in order."""
    return [c for c in columns if c in df.columns]


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature: mean and population deviation, median and quartile distance, in one pass."""
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        aggregates += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}__q")]
    wide = df.agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"), F.col(f"{c}__q")[1].alias("median"), (F.col(f"{c}__q")[2] - F.col(f"{c}__q")[0]).alias("iqr")) for c in columns])
    return wide.select(F.inline(rows))


def scaled(df: DataFrame, columns: Sequence[str], *, robust: bool = False, fit_on: Column | None = None) -> DataFrame:
    """df with each column scaled in place; a zero scale counts as 1. fit_on restricts the rows that give the statistics."""
    fit = df.where(fit_on) if fit_on is not None else df
    centre = (lambda x: F.percentile(x, 0.5)) if robust else F.avg
    spread = (lambda x: F.percentile(x, 0.75) - F.percentile(x, 0.25)) if robust else F.stddev_pop
    stats = fit.agg(*[f for c in columns for f in (centre(F.col(c).cast("double")).alias(f"_c_{c}"), spread(F.col(c).cast("double")).alias(f"_s_{c}"))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    out = joined.withColumns({c: (F.col(c) - F.col(f"_c_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "cs"])


def impute_with_indicator(df: DataFrame, columns: Sequence[str], flag: Column, train: Column) -> DataFrame:
    """Flagged rows take the training rows' medians (of rows not flagged), with a 0/1 indicator column."""
    medians = df.where(train & ~flag).agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(f"_m_{c}") for c in columns])
    out = df.withColumn("imputed", flag.cast("int")).crossJoin(F.broadcast(medians))  # one row
    return out.withColumns({c: F.when(F.col("imputed") == 1, F.col(f"_m_{c}")).otherwise(F.col(c)) for c in columns}).drop(*[f"_m_{c}" for c in columns])
