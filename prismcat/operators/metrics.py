"""Classification and ranking metrics over long tables: (row, label, truth 0/1, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Thresholds 0.10, 0.15, ..., 0.90.
GRID = tuple(round(0.10 + 0.05 * k, 2) for k in range(17))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def counts(long: DataFrame, predicted: Column, *keys: str) -> DataFrame:
    t, p = F.col("truth") == 1, predicted
    return long.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def f1(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> Column:
    return ratio(2.0 * F.col(tp), 2.0 * F.col(tp) + F.col(fp) + F.col(fn))


def samples_f1(long: DataFrame, threshold: float) -> DataFrame:
    return counts(long, F.col("score") >= threshold, "row").agg(F.avg(f1()).alias("samples_f1"))


def threshold_curve(long: DataFrame, grid: Sequence[float] = GRID) -> DataFrame:
    """(threshold, samples_f1) over the grid: one scan, per row one count for each threshold."""
    aggregates = []
    for k, t in enumerate(grid):
        p, y = F.col("score") >= t, F.col("truth") == 1
        aggregates.append(ratio(2.0 * F.count_if(y & p), 2.0 * F.count_if(y & p) + F.count_if(~y & p) + F.count_if(y & ~p)).alias(f"t{k}"))
    per_row = long.groupBy("row").agg(*aggregates)
    wide = per_row.agg(*[F.avg(f"t{k}").alias(f"t{k}") for k in range(len(grid))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("samples_f1")) for k, t in enumerate(grid)])))


def best_threshold(curve: DataFrame) -> float:
    """The lowest threshold with the highest value."""
    return curve.orderBy(F.desc(F.round("samples_f1", 12)), "threshold").first()["threshold"]


def f1_family(long: DataFrame, threshold: float) -> DataFrame:
    """One row: macro and micro F1, macro precision and recall, samples F1, Hamming loss."""
    p = F.col("score") >= threshold
    per_label = counts(long, p, "label").agg(
        F.avg(f1()).alias("macro_f1"), F.avg(ratio(F.col("tp") * 1.0, F.col("tp") + F.col("fp"))).alias("macro_precision"), F.avg(ratio(F.col("tp") * 1.0, F.col("tp") + F.col("fn"))).alias("macro_recall"),
        ratio(2.0 * F.sum("tp"), 2.0 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"))
    hamming = long.agg(F.avg((p != (F.col("truth") == 1)).cast("double")).alias("hamming_loss"))
    return per_label.crossJoin(F.broadcast(hamming)).crossJoin(F.broadcast(samples_f1(long, threshold)))  # one row each


def ranked(long: DataFrame) -> DataFrame:
    """long with the position of each label in its row: by score, then by label."""
    return long.withColumn("position", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "label")))


def top_labels(long: DataFrame, k: int) -> DataFrame:
    return ranked(long).where(F.col("position") <= k)


def hit_and_recall(long: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """(k, hit, precision, recall): a hit in the first k, mean share of the first k that is true, and true ones found of all."""
    per = ranked(long).groupBy("row").agg(F.sum("truth").alias("n"), *[F.sum(F.when(F.col("position") <= k, F.col("truth")).otherwise(0)).alias(f"h{k}") for k in ks])
    wide = per.agg(F.sum("n").alias("n"), *[f for k in ks for f in (F.avg((F.col(f"h{k}") > 0).cast("double")).alias(f"hit{k}"), F.avg(F.col(f"h{k}") / k).alias(f"p{k}"), F.sum(f"h{k}").alias(f"s{k}"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit{k}").alias("hit"), F.col(f"p{k}").alias("precision"), ratio(F.col(f"s{k}") * 1.0, F.col("n")).alias("recall")) for k in ks])))


def coverage_and_lrap(long: DataFrame) -> DataFrame:
    """One row: coverage_error and lrap, null if there is no row or a row without a true label. Ties take the worst rank."""
    by = W.partitionBy("row").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)
    worst = long.withColumn("rank", F.count("*").over(by)).withColumn("true_rank", F.sum("truth").over(by))
    per = worst.groupBy("row").agg(F.sum("truth").alias("n"), F.max(F.when(F.col("truth") == 1, F.col("rank"))).alias("cover"), F.avg(F.when(F.col("truth") == 1, F.col("true_rank") / F.col("rank"))).alias("precision"))
    fine = (F.count("*") > 0) & (F.min("n") > 0)
    return per.agg(F.when(fine, F.avg("cover")).alias("coverage_error"), F.when(fine, F.avg("precision")).alias("lrap"))


def average_precision(long: DataFrame) -> DataFrame:
    """(label, ap): per label; null for a label with one kind of truth only. Tied scores are one step."""
    per = long.groupBy("label", "score").agg(F.sum("truth").alias("t"), F.count("*").alias("n"))
    by = W.partitionBy("label").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = per.withColumn("tp", F.sum("t").over(by)).withColumn("seen", F.sum("n").over(by))
    ap = F.sum(F.col("t") * F.col("tp") / F.col("seen")) / F.sum("t")
    return steps.groupBy("label").agg(F.when((F.sum("t") > 0) & (F.sum("t") < F.sum("n")), ap).alias("ap"))


def predictions(long: DataFrame) -> DataFrame:
    """(row, truth, predicted) of a single-label task: the first label of each row, and its true one. No window."""
    return long.groupBy("row").agg(F.max(F.when(F.col("truth") == 1, F.col("label"))).alias("truth"), F.min_by("label", F.struct((-F.col("score")).alias("s"), "label")).alias("predicted"))


def confusion(pred: DataFrame) -> DataFrame:
    """(truth, predicted, rows, share): share of the true label's rows."""
    cells = pred.groupBy("truth", "predicted").agg(F.count("*").alias("rows"))
    return cells.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy("truth")))


def confused_pairs(pred: DataFrame, n: int = 10) -> DataFrame:
    return confusion(pred).where("truth <> predicted").select("truth", "predicted", "rows").orderBy(F.desc("rows"), "truth", "predicted").limit(n)


def accuracy(pred: DataFrame) -> DataFrame:
    """One row: accuracy, balanced_accuracy, and how many true labels were seen."""
    per = pred.groupBy("truth").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("a"), F.count("*").alias("n"))
    return per.agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("a").alias("balanced_accuracy"), F.count("*").alias("labels_seen"))


def topk_accuracy(long: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    per = ranked(long).where("truth = 1").groupBy("row").agg(F.min("position").alias("p"))
    wide = per.agg(*[F.avg((F.col("p") <= k).cast("double")).alias(f"k{k}") for k in ks])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("accuracy")) for k in ks])))


def label_frequencies(long: DataFrame) -> DataFrame:
    """(label, frequency): the constant score of the frequency baseline."""
    return long.groupBy("label").agg(F.avg(F.col("truth").cast("double")).alias("frequency"))


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, the smallest on ties."""
    return df.groupBy(label).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), label).limit(1)


def serving(long: DataFrame, k: int, threshold: float) -> DataFrame:
    """(row, labels, below): each row's first k labels in order, and whether no score reaches the threshold."""
    per = top_labels(long, k).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("l"), F.max("score").alias("m"))
    return per.select("row", F.transform("l", lambda x: x["label"]).alias("labels"), (F.col("m") < threshold).alias("below"))
