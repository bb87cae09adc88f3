"""Mixing sources to target weights with DataFrame operations only.

Sizes are summed per source, targets come from the weights, a source's repetition rate is target / size, and each
document is taken floor(rate) times plus once more with the fraction as probability, decided by a seeded hash.

Defined results: a null or empty text has size 0; a null source is a source of its own, ordered last; a source of
size 0 has target 0 and rate 0, and its documents (all of size 0) are taken 0 times; repeated rows are decided alike, since the
hash sees the id (or, for a null id, the text); an empty table gives an empty plan; further columns pass through.
The names in RESERVED are the operator's own: columns so called are replaced; _source and _copy are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismcat.llm.common import read, word_count, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target stops at this many times its size.
MAX_EPOCHS = 3
#: Up to so many sources, their rates are broadcast (one short row each); beyond, the join shuffles.
MAX_BROADCAST_SOURCES = 20_000
RESERVED = ("size", "source_size", "target", "rate", "copies", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, rate. `sizes` has the columns source and size.

    All sizes together are shared by weight; a source whose share is above its cap gets the cap, and the excess is
    shared again. The fixed point has the closed form target = min(cap, weight * level): with the sources in order of
    cap / weight, the level is the first (total - caps before) / (weights from here on) below cap / weight.
    The windows run over one row per source, after the partial sums.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    capped = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    levels = (
        capped.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        .withColumn("_rank", F.row_number().over(by_ratio))
        .withColumn("_open", F.col("_cap") / F.col("_w") > F.col("_level"))
    )
    first = F.min(F.when(F.col("_open"), F.struct("_rank", F.col("_level").alias("level")))).over(everything)["level"]
    return (
        levels.withColumn("_fill", first)
        .withColumn("target", F.when(F.col("_fill").isNull() | (F.col("_w") * F.col("_fill") >= F.col("_cap")), F.col("_cap")).otherwise(F.col("_w") * F.col("_fill")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5 of the seed and the id; a null id takes the text instead."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mixing_plan(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken (words that the mix takes).

    Documents are not shuffled where the sources are few: their rates are broadcast after their number is checked.
    """
    docs = docs.drop(*RESERVED, "_source", "_copy")
    sized = docs.withColumn("size", word_count(F.col("text")))
    targets = written(docs.sparkSession, source_targets(sized.select("source", "size"), weights, max_epochs).withColumnRenamed("source", "_source"), "rates")
    rates = F.broadcast(targets) if targets.count() <= MAX_BROADCAST_SOURCES else targets
    copies = (F.floor("rate") + (uniform(seed, F.col("doc_id"), F.col("text")) < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return (
        sized.join(rates, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The mixture itself: each document as often as the plan takes it, with the columns of docs."""
    plan = mixing_plan(docs, weights=weights, max_epochs=max_epochs, seed=seed).where(F.col("copies") > 0)
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*RESERVED, "_source", "_copy")])


def op4(spark, sf_dir: str) -> DataFrame:
    return mixing_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 3.0::DOUBLE AS cap FROM per),
lev AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM ranked),
fill AS (SELECT rest / ws AS f FROM lev WHERE cap / w > rest / ws ORDER BY cap / w, source NULLS LAST LIMIT 1),
tgt AS (
  SELECT source, source_size, CASE WHEN f IS NULL OR w * f >= cap THEN cap ELSE w * f END AS target
  FROM lev LEFT JOIN fill ON true),
plan AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN tgt ON sized.source IS NOT DISTINCT FROM tgt.source),
cop AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM plan)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM cop
"""
