"""Studies of ranked lists: offline evaluation, stability under noise, coherence of genres under three rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismcat.functions.vectors import cosine, knn_join, scaled_vectors
from prismcat.operators.recommend import eligible, mean_jaccard
from prismcat.operators.splits import hash_number


def evaluate_lists(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row about lists (seed, id, similarity): queries, total_results, self_recommendations, duplicates, mean_similarity,
    coverage_pct, and over lists of two and more the means of unique_artists (share) and internal_diversity (sample
    deviation of the similarities)."""
    listed = results.join(catalog.select("id", "artists"), "id")
    lists = listed.groupBy("seed").agg(
        F.count("*").alias("n"), F.count_if(F.col("seed") == F.col("id")).alias("own"), F.count_distinct("id").alias("ids"), F.count_distinct("artists").alias("artists"), F.sum("similarity").alias("s"), F.stddev_samp("similarity").alias("deviation")
    )
    many = F.col("n") > 1
    sums = lists.agg(
        F.count("*").alias("queries"), F.sum("n").alias("total_results"), F.count_if(F.col("own") > 0).alias("self_recommendations"), F.sum(F.col("n") - F.col("ids")).alias("duplicates"),
        (F.sum("s") / F.sum("n")).alias("mean_similarity"), F.avg(F.when(many, F.col("artists") / F.col("n"))).alias("unique_artists"), F.avg(F.when(many, F.col("deviation"))).alias("internal_diversity"),
    )
    covered = results.agg(F.count_distinct("id").alias("_ids")).crossJoin(eligible(catalog).agg(F.count("*").alias("_all")))  # two single rows
    return sums.crossJoin(F.broadcast(covered)).withColumn("coverage_pct", 100 * F.col("_ids") / F.col("_all")).drop("_ids", "_all")


def normal(key: Column, seed: int) -> Column:
    """A number of the standard normal distribution from a key's hash: the cosine half of the polar method."""
    u = (hash_number(key, F.lit(seed)) + 1) / F.lit(float(2**52 + 1))
    v = hash_number(key, F.lit(seed + 1)) / F.lit(float(2**52))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def noisy_lists(catalog: DataFrame, seeds: DataFrame, n: int = 10, *, deviation: float = 0.01, samples: int = 20, seed: int = 42) -> DataFrame:
    """(sample, seed, id): the lists of seeds whose scaled features get normal noise, asked of the catalog as it is."""
    table = scaled_vectors(eligible(catalog), "f")
    asking = table.join(seeds.select("id"), "id", "left_semi").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    key = lambda i: F.concat_ws(":", F.col("sample").cast("string"), F.col("id").cast("string"), i.cast("string"))
    moved = asking.withColumn("f", F.transform("f", lambda x, i: x + deviation * normal(key(i), seed)))
    width = F.lit(samples).cast("long")
    keyed = moved.select((-1 - (F.col("id") * width + F.col("sample"))).alias("key"), "f")  # below zero: no row of the catalog has it
    near = knn_join(keyed, table.select(F.col("id").alias("key"), "f"), "key", "f", n + 1)
    lists = near.select((F.floor((-1 - F.col("a")) / width)).cast("long").alias("seed"), F.pmod(-1 - F.col("a"), width).alias("sample"), F.col("b").alias("id"), "similarity")
    others = lists.where("seed <> id").withColumn("r", F.row_number().over(W.partitionBy("seed", "sample").orderBy(F.desc("similarity"), "id")))
    return others.where(F.col("r") <= n).select("sample", "seed", "id")


def stability(results: DataFrame, noisy: DataFrame) -> DataFrame:
    """One row: mean over seeds and samples of the Jaccard similarity of the clean and the noisy list."""
    pair = lambda df: df.withColumn("seed", F.struct("seed", "sample"))
    clean = results.select("seed", "id").join(noisy.select("seed", "sample").distinct(), "seed")
    return mean_jaccard(pair(clean), pair(noisy)).withColumnRenamed("seeds", "lists")


def study_lists(catalog: DataFrame, seeds: DataFrame, weights: Sequence[float], n: int = 10, pool: int = 100) -> DataFrame:
    """(variant, seed, id, similarity, shares): the first n of each seed under three rankings, and its acoustic pool.

    baseline: by cosine; weighted: by weighted distance; affinity: the pool's rows that share a genre first, then by
    cosine; pool: the nearest `pool` by cosine. similarity is the cosine of scaled features in each.
    """
    table = scaled_vectors(eligible(catalog), "f").select("id", "genres", "f")
    asking = table.join(seeds.select("id"), "id", "left_semi")
    total = sum(weights)
    heavy = lambda df: df.withColumn("f", F.transform("f", lambda x, i: x * F.element_at(F.array(*[F.lit(math.sqrt(w / total)) for w in weights]), (i + 1).cast("int"))))
    near = knn_join(asking, table, "id", "f", pool).select(F.col("a").alias("seed"), F.col("b").alias("id"), "similarity", "rank")
    far = knn_join(heavy(asking), heavy(table), "id", "f", n, metric="euclidean").select(F.col("a").alias("seed"), F.col("b").alias("id"), F.col("similarity").alias("score"))
    own = table.select(F.col("id").alias("seed"), F.col("genres").alias("seed_genres"), F.col("f").alias("seed_f"))
    shares = F.coalesce(F.arrays_overlap("genres", "seed_genres"), F.lit(False))
    known = near.join(table.select("id", "genres"), "id").join(own.drop("seed_f"), "seed").withColumn("shares", shares).select("seed", "id", "similarity", "shares", "rank")
    weighted = far.join(table, "id").join(own, "seed").select(F.lit("weighted").alias("variant"), "seed", "id", cosine(F.col("f"), F.col("seed_f")).alias("similarity"), shares.alias("shares"))
    best = W.partitionBy("seed").orderBy(F.desc("shares"), F.desc("similarity"), F.desc("id"))
    affinity = known.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n)
    columns = ["variant", "seed", "id", "similarity", "shares"]
    parts = [("baseline", known.where(F.col("rank") <= n)), ("affinity", affinity), ("pool", known)]
    out = weighted.select(*columns)
    for name, df in parts:
        out = out.unionByName(df.withColumn("variant", F.lit(name)).select(*columns))
    return out


def study_summary(lists: DataFrame) -> DataFrame:
    """(variant, coherence, mean_cosine, seeds): means over seeds; the pool's coherence is the availability."""
    per = lists.groupBy("variant", "seed").agg(F.avg(F.col("shares").cast("double")).alias("c"), F.avg("similarity").alias("s"))
    return per.groupBy("variant").agg(F.avg("c").alias("coherence"), F.avg("s").alias("mean_cosine"), F.count("*").alias("seeds"))


def study_by_genre(lists: DataFrame, catalog: DataFrame, least: int = 5) -> DataFrame:
    """(genre, seeds, availability, baseline, weighted, affinity, gain, unrecoverable) over the seeds of each genre; unrecoverable: nothing available to `least` seeds and more."""
    per = lists.groupBy("seed").pivot("variant", ["baseline", "weighted", "affinity", "pool"]).agg(F.avg(F.col("shares").cast("double")))
    genres = catalog.select(F.col("id").alias("seed"), F.explode(F.array_distinct("genres")).alias("genre"))
    means = per.join(genres, "seed").groupBy("genre").agg(F.count("*").alias("seeds"), F.avg("pool").alias("availability"), *[F.avg(v).alias(v) for v in ("baseline", "weighted", "affinity")])
    return means.withColumn("gain", F.col("affinity") - F.col("baseline")).withColumn("unrecoverable", (F.col("availability") == 0) & (F.col("seeds") >= least))
