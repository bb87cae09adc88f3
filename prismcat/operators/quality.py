"""Contracts and audits: what a raw table holds and where it breaks its rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


class ContractError(ValueError):
    """A table lacks what its contract asks for."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")


@dataclass(frozen=True)
class Range:
    """Allowed values of a column: bounds (inclusive) or a set. A null breaks a set but not a bound."""

    low: float | None = None
    high: float | None = None
    allowed: tuple | None = None

    def violated(self, column: Column) -> Column:
        parts = []
        if self.low is not None:
            parts.append(F.coalesce(column < F.lit(self.low), F.lit(False)))
        if self.high is not None:
            parts.append(F.coalesce(column > F.lit(self.high), F.lit(False)))
        if self.allowed is not None:
            parts.append(~F.coalesce(column.isin(*self.allowed), F.lit(False)))
        return reduce(lambda a, b: a | b, parts, F.lit(False))


def range_violations(df: DataFrame, key: str, ranges: Mapping[str, Range], *, first: int = 10) -> DataFrame:
    """(column, key, value, position): the first violators of each column by key. One scan; a limit per column before the shuffle."""
    found = F.array(*[F.when(r.violated(F.col(c)), F.struct(F.lit(c).alias("column"), F.col(key).alias("key"), F.col(c).cast("string").alias("value"))) for c, r in ranges.items() if c in df.columns])
    rows = df.select(F.inline(F.filter(found, lambda x: x.isNotNull())))
    return rows.withColumn("position", F.row_number().over(W.partitionBy("column").orderBy("key"))).where(F.col("position") <= first)


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))


def quarantine(df: DataFrame, identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): rows with all identity columns, and the rest."""
    bad = any_null(identity)
    return df.where(~bad), df.where(bad)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) for each column that has any, and a row "*" with the total; one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in columns], F.struct(F.lit("*").alias("column"), total.alias("nulls")))
    return wide.select(F.inline(rows)).where((F.col("nulls") > 0) | (F.col("column") == "*"))


def duplicate_profile(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows, duplicate_rows, distinct_keys, duplicate_keys; a null counts as a value."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct(whole)).alias("duplicate_rows"),
        F.count_distinct(F.struct(*key)).alias("distinct_keys"),
        (F.count("*") - F.count_distinct(F.struct(*key))).alias("duplicate_keys"),
    )


def category_check(df: DataFrame, column: str, expected: int) -> DataFrame:
    """categories, smallest, largest, all_expected: whether each category has the expected number of rows."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().agg(
        F.count("*").alias("categories"), F.min("count").alias("smallest"), F.max("count").alias("largest"), F.coalesce(F.bool_and(F.col("count") == expected), F.lit(True)).alias("all_expected"))


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(condition, rows) for several conditions in one pass."""
    wide = df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(n).alias("rows")) for n in conditions])))


def column_extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, least, greatest); what is no number counts as null."""
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    wide = df.agg(*[f for c in columns for f in (F.min(number(c)).alias(f"{c}__lo"), F.max(number(c)).alias(f"{c}__hi"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__lo").alias("least"), F.col(f"{c}__hi").alias("greatest")) for c in columns])))


def multi_label_entities(df: DataFrame, entity: str, label: str) -> DataFrame:
    """entities, multi (with more than one label), most: distinct labels per entity."""
    per = df.groupBy(entity).agg(F.count_distinct(label).alias("n"))
    return per.agg(F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("multi"), F.max("n").alias("most"))


def constraint_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, violations); as for SQL checks, a null outcome passes."""
    return conditional_counts(df, {n: ~F.coalesce(c, F.lit(True)) for n, c in checks.items()}).select(F.col("condition").alias("check"), F.col("rows").alias("violations"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def audit(df: DataFrame, *, key: Sequence[str], category: str, expected: int, conditions: Mapping[str, Column]) -> dict:
    """The whole profile as a dictionary: every part is a few rows."""
    return {
        "nulls": {r["column"]: r["nulls"] for r in null_profile(df).collect()},
        "duplicates": duplicate_profile(df, key).first().asDict(),
        "categories": category_check(df, category, expected).first().asDict(),
        "conditions": {r["condition"]: r["rows"] for r in conditional_counts(df, conditions).collect()},
    }


def post_build_checks(df: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """(check, ok, found) of a built table: required columns, null keys, repeated keys, rows."""
    missing = len([c for c in required if c not in df.columns])
    sums = df.agg(F.count_if(F.col(key).isNull()).alias("null_keys"), (F.count(key) - F.count_distinct(key)).alias("repeated_keys"), F.count("*").alias("rows"))
    rows = [("missing_columns", F.lit(missing).cast("long"), F.lit(missing == 0))]
    rows += [(n, F.col(n), F.col(n) == 0) for n in ("null_keys", "repeated_keys")] + [("rows", F.col("rows"), F.col("rows") > 0)]
    return sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok"), found.alias("found")) for n, found, ok in rows])))
