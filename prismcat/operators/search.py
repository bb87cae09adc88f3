"""Catalog search: fuzzy token-set ranking with a boost for matching artists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismcat.functions.text import search_label, search_query, token_set_ratio_to

#: Scores below this are no hits.
CUTOFF = 45.0


def search(catalog: DataFrame, query: str, *, limit: int = 20, cutoff: float = CUTOFF) -> DataFrame:
    """(id, score, boosted): best matches of a query over id, name, artists, album; a blank query finds nothing.

    The list is cut to `limit` by score first; then rows whose artists hold the query go to the front.
    """
    wanted = search_query(query)
    labels = catalog.select("id", "artists", search_label(F.col("name"), F.col("artists"), F.col("album")).alias("label"))
    if not wanted:
        return labels.limit(0).select("id", F.lit(0).alias("score"), F.lit(False).alias("boosted"))
    scored = labels.withColumn("exact", token_set_ratio_to(wanted, F.col("label"))).where(F.col("exact") >= cutoff)
    best = scored.orderBy(F.desc("exact"), "id").limit(limit)
    boosted = F.coalesce(F.lower("artists").contains(wanted), F.lit(False))
    return best.select("id", F.floor("exact").cast("int").alias("score"), boosted.alias("boosted")).orderBy(F.desc("boosted"), F.desc("score"), "id")


def search_literal(catalog: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """(id, boosted): rows whose label holds the query, those whose artists hold it first; built-in expressions only."""
    wanted = search_query(query)
    rows = catalog.where(search_label(F.col("name"), F.col("artists"), F.col("album")).contains(wanted) if wanted else F.lit(False))
    return rows.select("id", F.coalesce(F.lower("artists").contains(wanted), F.lit(False)).alias("boosted")).orderBy(F.desc("boosted"), "id").limit(limit)


def find_seed(catalog: DataFrame, name: str, artist: str) -> DataFrame:
    """The most popular row (ties: smallest id) whose name and artists hold the given texts, whatever their case; a null popularity comes last."""
    holds = lambda c, text: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return catalog.where(holds("name", name) & holds("artists", artist)).orderBy(F.desc_nulls_last("popularity"), "id").limit(1)


def resolve(catalog: DataFrame, key: str, value: int | str) -> dict:
    """The row with a key as a dictionary; KeyError without one."""
    row = catalog.where(F.col(key) == F.lit(value)).limit(1).first()
    if row is None:
        raise KeyError(value)
    return row.asDict()
