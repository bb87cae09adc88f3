"""What the operators of this subpackage share: the shared folder, written tables, labelled samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the contracts that count words: space and the code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_caches: dict = {"owner": None, "items": {}}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task, of one operator at a time: workers outlive stages, and the tables
    of an operator that has ended must not stay beside those of the next."""
    if _caches["owner"] != owner:
        _caches["items"].clear()
        _caches["owner"] = owner
        gc.collect()
        give_back()
    return _caches["items"]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: else a worker keeps its largest task's for good."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not that C library
        return


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving memory back at a task's end, when its variables are gone: idle workers stay small."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine gets a temporary folder, which is set in its place; on a cluster that
    is an error, since executors would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prismcat-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; what is written there goes at the end of the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a path of any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but the contract's white space); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; null ids are in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A labelled sample brings at most so many bytes of text to the driver, and the first row in any case.
SAMPLE_BYTES = 48_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, limit: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most `bound` (text, label) pairs, of `limit` bytes, of the rows for which `keep` holds, brought to the driver.

    The sample is the `bound` smallest rows by hash of the id, then as many of them by hash of the text as the limit
    allows, so reruns agree and the bounds alone decide how much reaches the driver. An id with several labels takes the
    largest; null ids, labels and texts teach nothing; copies of a text count once and take their most frequent label
    (ties: 1).
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
        .withColumn("doc_id", F.col("_id"))
        .where(keep)
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(bound)
    )
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .join(F.broadcast(chosen), "_id")  # at most `bound` rows
        .where(F.col("_text").isNotNull())
        .groupBy(F.xxhash64("_text").alias("_h"), F.octet_length("_text").alias("_n"))
        .agg(F.min("_text").alias("text"), F.avg("_y").alias("y"))
        .select("_h", "_n", "text", (F.col("y") >= 0.5).cast("int").alias("y"))
    )
    kept = written(docs.sparkSession, rows, "sample")
    sizes = kept.select("_h", "_n").orderBy("_h", "_n").limit(bound).collect()
    total, last = 0, None
    for r in sizes:
        total += r["_n"]
        if last is not None and total > limit:
            break
        last = r
    if last is None:
        return []
    upto = F.struct("_h", "_n") <= F.struct(F.lit(last["_h"]).cast("long").alias("_h"), F.lit(last["_n"]).cast("int").alias("_n"))
    return [(r["text"], r["y"]) for r in kept.where(upto).orderBy("_h", "_n").select("text", "y").collect()]
