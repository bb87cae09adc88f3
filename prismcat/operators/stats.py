"""Descriptive statistics, correlation, label co-occurrence and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prismcat.functions.features import scaled

PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean, std, least, p5, p25, p50, p75, p95, greatest) in one pass; std is the sample's."""
    aggregates = []
    for c in columns:
        x = F.col(c).cast("double")
        aggregates.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.percentile(x, F.array(*map(F.lit, PERCENTILES))).alias("p"), F.max(x).alias("greatest")).alias(c))
    rows = df.agg(*aggregates).select(F.explode(F.array(*columns)).alias("r"))
    return rows.select("r.feature", "r.n", "r.mean", "r.std", "r.least", *[F.col("r.p")[k].alias(f"p{round(100 * p)}") for k, p in enumerate(PERCENTILES)], "r.greatest")


def shares(df: DataFrame, flags: dict[str, Column], rest: str) -> DataFrame:
    """(category, rows, share): flagged rows by flag, and all others as `rest`."""
    wide = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    left = F.col("_n")
    for n in flags:
        left = left - F.col(n)
    rows = [F.struct(F.lit(rest).alias("category"), left.alias("rows"))] + [F.struct(F.lit(n).alias("category"), F.col(n).alias("rows")) for n in flags]
    return wide.select("_n", F.inline(F.array(*rows))).select("category", "rows", (F.col("rows") / F.col("_n")).alias("share"))


def group_means(df: DataFrame, group: Column, columns: Sequence[str], name: str = "group") -> DataFrame:
    return df.groupBy(group.alias(name)).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("rows"))


def grain_comparison(fine: DataFrame, coarse: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean_fine, mean_coarse, std_fine, std_coarse, mean_delta): the same statistics at two grains."""
    both = []
    for df, tag in ((fine, "fine"), (coarse, "coarse")):
        wide = df.agg(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias(f"mean_{tag}"), F.stddev_samp(c).alias(f"std_{tag}")).alias(c) for c in columns])
        both.append(wide.select(F.inline(F.array(*columns))))
    return both[0].join(both[1], "feature").withColumn("mean_delta", F.col("mean_coarse") - F.col("mean_fine"))


def flag_share(df: DataFrame, category: str, flag: Column) -> DataFrame:
    """(category, rows, flagged, share) per category."""
    return df.groupBy(category).agg(F.count("*").alias("rows"), F.count_if(flag).alias("flagged")).withColumn("share", F.col("flagged") / F.col("rows"))


def multi_label_stats(links: DataFrame, entity: str, label: str) -> DataFrame:
    """(statistic, value): entities, those with one and with several labels, most and mean labels."""
    per = links.groupBy(entity).agg(F.count_distinct(label).alias("n"))
    wide = per.agg(F.count("*").cast("double").alias("total"), F.count_if(F.col("n") == 1).cast("double").alias("single"), F.count_if(F.col("n") > 1).cast("double").alias("multi"), F.max("n").cast("double").alias("most"), F.round(F.avg("n"), 3).alias("mean"))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).alias("value")) for c in ("total", "single", "multi", "most", "mean")])))


def category_share(links: DataFrame, entity: str, label: str) -> DataFrame:
    """(label, entities, share): entities of each label against all distinct entities."""
    all_entities = links.agg(F.count_distinct(entity).alias("_all"))
    return links.groupBy(label).agg(F.count_distinct(entity).alias("entities")).crossJoin(F.broadcast(all_entities)).select(label, "entities", (F.col("entities") / F.col("_all")).alias("share"))


def cooccurrence(links: DataFrame, entity: str, label: str) -> DataFrame:
    """(a, b, shared): entities that have both labels, each unordered pair once, a label with itself included.

    Pairs come from the label list of an entity, not from joining the bridge with itself: one shuffle by entity.
    """
    lists = links.groupBy(entity).agg(F.array_sort(F.collect_set(label)).alias("l"))
    pairs = lists.select(F.posexplode("l").alias("i", "a"), "l").select("a", F.explode(F.expr("slice(l, i + 1, size(l))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def overlap_pairs(links: DataFrame, entity: str, label: str) -> DataFrame:
    """(a, b, shared, n_a, n_b, full): pairs of different labels; full where one's entities all have the other."""
    co = cooccurrence(links, entity, label)
    own = co.where("a = b")
    n_a, n_b = own.select("a", F.col("shared").alias("n_a")), own.select("b", F.col("shared").alias("n_b"))
    return co.where("a <> b").join(n_a, "a").join(n_b, "b").withColumn("full", F.col("shared") == F.least("n_a", "n_b"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; the order should be total."""
    return df.orderBy(*order).limit(n)


def profiles(df: DataFrame, category: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(category).agg(*[F.avg(c).alias(c) for c in columns])


def similar_profiles(df: DataFrame, category: str, columns: Sequence[str], n: int = 20) -> DataFrame:
    """(a, b, similarity): most similar scaled mean profiles of categories, each pair once. One row per category is joined."""
    table = scaled(profiles(df, category, columns), columns).select(F.col(category).alias("c"), F.array(*columns).alias("v"))
    from prismcat.functions.vectors import dot, l2_normalized

    unit = table.withColumn("v", l2_normalized(F.col("v")))
    pairs = unit.toDF("a", "va").join(unit.toDF("b", "vb"), F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("similarity"))
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(n)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson's r of each pair, over the rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def high_correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.6) -> DataFrame:
    return correlations(df, columns).where((F.col("a") != F.col("b")) & (F.abs("r") >= threshold))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept and number of the rows that have both."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"), F.count("*").alias("rows"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, rows): bins of equal width over [low, high], the last one closed; others are left out."""
    x = F.col(column).cast("double")
    width = (high - low) / bins
    k = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return df.where((x >= low) & (x <= high)).groupBy(k.alias("bin")).agg(F.count("*").alias("rows"))


def cut(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """(bucket, rows) of right-closed intervals."""
    x, bucket = F.col(column), F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        bucket = F.when((x > low) & (x <= high), name).otherwise(bucket)
    return df.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("rows"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(size, groups): how many groups have each size."""
    return df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def label_lists(links: DataFrame, entity: str, label: str) -> DataFrame:
    """(entity, labels): each entity's labels, sorted."""
    return links.groupBy(entity).agg(F.array_sort(F.collect_list(label)).alias("labels"))
