"""Leakage-free splits of groups into train, validation and test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Shares of validation and test.
VALIDATION, TEST = 0.15, 0.15


def split_of(group: Column, seed: int, validation: float = VALIDATION, test: float = TEST) -> Column:
    """Split by a hash of the group id: every row of a group is in one split, whatever the other groups are."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52)
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


def hash_number(group: Column, seed: Column) -> Column:
    """52 bits of an md5 of the seed and the group, as a long."""
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), group.cast("string"))), 1, 13), 16, 10).cast("long")


def cuts(df: DataFrame, keys: Sequence[str], number: str, id_: str, share: Column) -> DataFrame:
    """(keys, cut): the greatest (number, id) among the ceil(share * rows) smallest of each key, numbers of 52 bits; a row per key.

    Counts by the number's first bits find the slot in which the cut falls; only that slot's rows are put in order.
    """
    slots = df.withColumn("_slot", F.shiftright(F.col(number), 52 - SLOT_BITS))
    counts = slots.groupBy(*keys, "_slot").agg(F.count("*").alias("_k"))
    before = W.partitionBy(*keys).orderBy(F.col("_slot").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)  # over 2**SLOT_BITS rows at most
    want = F.ceil(F.round(share * F.sum("_k").over(W.partitionBy(*keys)), 9)).cast("long")
    left = counts.withColumn("_left", want - F.coalesce(F.sum("_k").over(before), F.lit(0))).where("_left > 0 and _left <= _k")
    near = slots.join(F.broadcast(left.select(*keys, "_slot", "_left")), [*keys, "_slot"])  # a row per key
    order = W.partitionBy(*keys).orderBy(number, id_)
    return near.withColumn("_at", F.row_number().over(order)).where("_at = _left").select(*keys, F.struct(F.col(number).alias("number"), F.col(id_).alias("id")).alias("cut"))


def smallest(df: DataFrame, keys: Sequence[str], number: str, id_: str, share: Column) -> DataFrame:
    """df with `taken`: whether a row is among the ceil(share * rows) smallest of its keys by number (52 bits), then id."""
    placed = df.join(cuts(df, keys, number, id_, share), keys, "left")
    return placed.withColumn("taken", _up_to(F.col(number), id_, "cut")).drop("cut")


#: A cut is looked for in 2**SLOT_BITS slots.
SLOT_BITS = 12


def _up_to(number: Column, group: str, cut: str) -> Column:
    """Whether a group is among those of a cut; without a cut or a number it is not."""
    return F.coalesce(number.isNotNull() & (F.struct(number.alias("number"), F.col(group).alias("id")) <= F.col(cut)), F.lit(False))


def candidate_bounds(groups: DataFrame, group: str, *, candidates: int = 50, seed: int = 42, validation: float = VALIDATION, test: float = TEST) -> DataFrame:
    """(seed, test_cut, validation_cut): where each candidate's splits end. These few rows are all that a plan on the splits needs."""
    rows = groups.select(group, F.explode(F.sequence(F.lit(seed), F.lit(seed + candidates - 1))).alias("seed"))
    own, again = hash_number(F.col(group), F.col("seed")), hash_number(F.col(group), F.col("seed") + 1000)
    first = cuts(rows.withColumn("_h", own), ["seed"], "_h", group, F.lit(test)).withColumnRenamed("cut", "test_cut").cache()  # a row per candidate
    rest = rows.join(F.broadcast(first), "seed").where(~_up_to(own, group, "test_cut")).withColumn("_h", again)
    second = cuts(rest, ["seed"], "_h", group, F.lit(validation / (1 - test))).withColumnRenamed("cut", "validation_cut")
    return first.join(F.broadcast(second), "seed", "left").cache()


def splits_of(groups: DataFrame, group: str, bounds: DataFrame) -> DataFrame:
    """groups with seed and split, once for each row of candidate_bounds; no shuffle."""
    own, again = hash_number(F.col(group), F.col("seed")), hash_number(F.col(group), F.col("seed") + 1000)
    name = F.when(_up_to(own, group, "test_cut"), "test").when(_up_to(again, group, "validation_cut"), "validation").otherwise("train")
    return groups.crossJoin(F.broadcast(bounds)).withColumn("split", name).drop("test_cut", "validation_cut")  # a row per candidate


def split_candidates(groups: DataFrame, group: str, **parameters) -> DataFrame:
    """(seed, group, split) for every candidate seed: test is carved first, then validation from the rest with seed + 1000.

    Sizes are exact: ceil(test * n), then ceil(validation / (1 - test) * rest). `groups` has one row per group; parameters
    are those of candidate_bounds.
    """
    return splits_of(groups.select(group), group, candidate_bounds(groups, group, **parameters)).select("seed", group, "split")


def _with_labels(links: DataFrame, group: str, label: str) -> DataFrame:
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number, which keeps small rows, of much work each, apart
    return links.repartition(parts, group).groupBy(group).agg(F.collect_set(label).alias("_labels"))  # one group's labels


def _deviations(tagged: DataFrame, own: DataFrame, label: str) -> DataFrame:
    """tagged: the rows of own (group, _labels) with seed and split. One pass counts rows and labels."""
    kind = next(f.dataType.elementType for f in own.schema.fields if f.name == "_labels")
    marked = F.explode(F.concat(F.array(F.lit(None).cast(kind)), "_labels")).alias(label)  # a null stands for the row itself
    counted = tagged.select("seed", "split", marked).groupBy("seed", "split", label).agg(F.count("*").alias("_k"))
    sizes, counts = counted.where(F.col(label).isNull()).select("seed", "split", F.col("_k").alias("_n")), counted.where(F.col(label).isNotNull())
    overall = own.select(F.explode("_labels").alias(label)).groupBy(label).agg(F.count("*").alias("_all")).crossJoin(F.broadcast(own.agg(F.count("*").alias("_groups"))))  # one row
    grid = overall.crossJoin(F.broadcast(sizes)).join(counts, ["seed", "split", label], "left")  # three rows per candidate
    gap = F.abs(F.coalesce("_k", F.lit(0)) / F.col("_n") - F.col("_all") / F.col("_groups"))
    return grid.groupBy("seed").agg(F.avg(gap).alias("deviation"))


def candidate_deviations(links: DataFrame, assignment: DataFrame, group: str, label: str) -> DataFrame:
    """(seed, deviation): mean over splits and labels of |share of the label in the split - share overall|.

    links has a row per group and label. Labels travel with their group, so the counts are partial sums of one pass.
    """
    own = _with_labels(links, group, label)
    return _deviations(assignment.join(own, group), own, label)


def best_split(links: DataFrame, group: str, label: str, **parameters) -> DataFrame:
    """(group, split, seed) of the candidate whose labels deviate least, the smallest seed on ties.

    Groups are split by the cuts of each candidate where they lie; only the best candidate's split leaves.
    """
    own = _with_labels(links, group, label)
    bounds = candidate_bounds(own, group, **parameters)
    best = _deviations(splits_of(own, group, bounds), own, label).orderBy(F.round("deviation", 12), "seed").limit(1).select("seed")
    return splits_of(own.select(group), group, bounds.join(F.broadcast(best), "seed")).select(group, "split", "seed")  # one row


def sample_ids(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n keys without replacement, in order: those with the smallest hashes."""
    return df.select(key).orderBy(hash_number(F.col(key), F.lit(seed)), key).limit(n).orderBy(key)


def prevalence_deviation(links: DataFrame, entity: str, label: str, split: Column) -> DataFrame:
    """(split, deviation): mean over labels of |share in the split - share overall|."""
    tagged = links.withColumn("split", split)
    per_split = tagged.groupBy("split").agg(F.count_distinct(entity).alias("n_split"))
    overall = links.groupBy(label).agg(F.count_distinct(entity).alias("n_label")).crossJoin(F.broadcast(links.agg(F.count_distinct(entity).alias("n_all"))))
    counts = tagged.groupBy("split", label).agg(F.count_distinct(entity).alias("n"))
    grid = overall.crossJoin(F.broadcast(per_split)).join(counts, ["split", label], "left")  # a row per split
    gap = F.abs(F.coalesce("n", F.lit(0)) / F.col("n_split") - F.col("n_label") / F.col("n_all"))
    return grid.groupBy("split").agg(F.avg(gap).alias("deviation"))


def leaks(assignment: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that are in more than one split."""
    return assignment.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def assignment_hash(assignment: DataFrame, group: str, split: str = "split") -> DataFrame:
    """One row: an order-free digest of an assignment, summed over rows and so distributed."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("=", F.col(group).cast("string"), split), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return assignment.agg(F.sha2(F.concat_ws(":", F.sum(h).cast("string"), F.count("*").cast("string")), 256).alias("digest"))
