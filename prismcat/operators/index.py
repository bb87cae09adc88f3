"""Built indexes: scaled vectors, their statistics and a manifest in a folder, checked before use.

A request to a built index reads one table of vectors and one row of statistics; nothing is fitted again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismcat.functions.vectors import cosine, norm, weighted_distance
from prismcat.operators.recommend import Filters, Profile, eligible, ood_status, same_work
from prismcat.sources.io import exists, write_parquet

#: Parts of a built index.
PARTS = ("items", "statistics", "manifest")


@dataclass(frozen=True)
class Index:
    items: DataFrame
    statistics: DataFrame
    manifest: dict


def build_index(catalog: DataFrame, path: str, *, version: str = "v1", reference: bool = False) -> None:
    """Writes the eligible rows with scaled features in order of id, means and deviations, and a manifest; with reference, p95 and p99 of the distances to the centroid."""
    rows = eligible(catalog)
    per = rows.select(F.posexplode("f").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    one = per.agg(F.array_sort(F.collect_list(F.struct("i", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("std")))).alias("s"))  # a row per feature
    one.select(F.col("s.mean").alias("means"), F.col("s.std").alias("stds")).coalesce(1).write.mode("overwrite").parquet(f"{path}/fitted")
    fitted = catalog.sparkSession.read.parquet(f"{path}/fitted")
    scaled = F.zip_with(F.zip_with("f", "means", lambda x, m: x - m), "stds", lambda x, s: x / s)
    items = rows.crossJoin(F.broadcast(fitted)).withColumn("z", scaled).drop("means", "stds")  # one row
    write_parquet(items.withColumn("unit_norm", norm(F.col("z"))), f"{path}/items", order_by=["id"])
    stored = catalog.sparkSession.read.parquet(f"{path}/items")
    p = F.percentile("unit_norm", F.array(F.lit(0.95), F.lit(0.99)))
    sums = stored.agg(F.count("*").alias("rows"), (p if reference else F.lit(None).cast("array<double>")).alias("p"))
    fitted.crossJoin(sums).select("means", "stds", "rows", F.col("p")[0].alias("p95"), F.col("p")[1].alias("p99")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    n = catalog.sparkSession.read.parquet(f"{path}/statistics").first()
    catalog.sparkSession.createDataFrame([(json.dumps({"version": version, "rows": n["rows"], "features": len(n["means"]), "reference": reference}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> Index:
    """A built index; FileNotFoundError names the parts that are missing, ValueError an index whose rows are not as many as its manifest says."""
    missing = [p for p in PARTS if not exists(spark, f"{path}/{p}/_SUCCESS")]
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(missing)}: build the index first")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    index = Index(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/statistics"), manifest)
    found = index.items.count()  # from the files' footers
    if found != manifest["rows"]:
        raise ValueError(f"{path} has {found} rows, its manifest says {manifest['rows']}")
    return index


def similar_in(index: Index, seed: int | str, n: int = 10, *, filters: Filters = Filters(), exclude_same_work: bool = True) -> DataFrame:
    """(id, similarity): the n most similar items of a built index; KeyError for a seed that it lacks. The seed is one lookup by a pushed-down filter."""
    one = index.items.where(F.col("id") == F.lit(seed)).select("name", "artists", "genres", "z", "unit_norm").first()
    if one is None:
        raise KeyError(seed)
    z = F.array(*[F.lit(float(x)) for x in one["z"]])
    known = {"seed_name": F.lit(one["name"]), "seed_artists": F.lit(one["artists"]), "seed_genres": F.array(*map(F.lit, one["genres"])) if one["genres"] else F.lit(None).cast("array<string>")}
    rows = index.items.where(F.col("id") != F.lit(seed)).withColumns(known)
    rows = rows.where(filters.predicate() & (~same_work() if exclude_same_work else F.lit(True)))
    return rows.select("id", F.round(cosine(F.col("z"), z), 12).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(n)


def preferred_in(index: Index, profile: Profile, n: int = 10) -> DataFrame:
    """(id, distance, similarity, status): the n items nearest to a profile in scaled units, with the profile's own distance to the centroid judged by the stored reference."""
    d = F.round(weighted_distance(F.col("z"), profile.values, profile.weights), 12)
    own = sum(v * v for v in profile.values) ** 0.5
    rows = index.items.where(profile.filters.predicate()).select("id", d.alias("distance"), (1 / (1 + d)).alias("similarity")).orderBy("distance", "id").limit(n)
    status = ood_status(F.lit(own), F.col("p95"), F.col("p99"))
    return rows.crossJoin(F.broadcast(index.statistics.select(status.alias("status"))))  # one row
