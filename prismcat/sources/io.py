"""Readers and writers: CSV with a schema, Parquet bundles, JSON reports, manifests, artefact folders, file hashes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import fields, is_dataclass
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prismcat.operators.quality import ContractError

C = TypeVar("C")

# The columns of a raw catalog row.
_STRINGS = ("track_id", "artists", "album_name", "track_name", "track_genre")
_LONGS = ("popularity", "duration_ms", "key", "mode", "time_signature")
_DOUBLES = ("danceability", "energy", "loudness", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo")
RAW_CATALOG = T.StructType(
    [T.StructField("ordinal", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in _STRINGS[:4]]
    + [T.StructField("popularity", T.LongType()), T.StructField("duration_ms", T.LongType()), T.StructField("explicit", T.BooleanType())]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLES]
    + [T.StructField(c, T.LongType()) for c in _LONGS[2:]]
    + [T.StructField("track_genre", T.StringType())]
)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; without a schema its types are inferred."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        raise ContractError(f"a folder, not a file: {path}")
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_bundle(spark: SparkSession, folder: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """Several Parquet tables of a folder; all must be there."""
    missing = [t for t in tables if not exists(spark, f"{folder}/{t}.parquet")]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}


def _ordered(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Ranges of the order, each sorted: files in order without a sort in one task."""
    return df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df


def write_parquet(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), order_by: Sequence[str] = ()) -> None:
    """A Parquet table; with order_by its files, in order of their names, hold the rows in that order."""
    _ordered(df, order_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, *, order_by: Sequence[str] = ()) -> None:
    _ordered(df, order_by).write.mode("overwrite").option("header", True).csv(path)


def write_json(report: Mapping, path: str) -> None:
    """A small report with sorted keys; not-a-number is not allowed."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False, default=str), encoding="utf-8")


def read_manifests(spark: SparkSession, pattern: str, order_by: Sequence[str] = ("experiment", "model_id")) -> DataFrame:
    """Many JSON manifests as one table with the file each came from, in order of those of the columns that are there, then of the file."""
    table = spark.read.option("multiLine", True).json(pattern).withColumn("file", F.input_file_name())
    return table.orderBy(*[c for c in order_by if c in table.columns], "file")


def size_on_disk(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder, in any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


def newest(folder: str, ending: str) -> Path:
    """The last folder by name that ends in _<ending>."""
    found = sorted(p for p in Path(folder).glob(f"*_{ending}") if p.is_dir())
    if not found:
        raise FileNotFoundError(f"no {ending} in {folder}")
    return found[-1]


def file_hash(path: str, algorithm: str = "sha256") -> str:
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        while part := f.read(1 << 16):
            h.update(part)
    return h.hexdigest()


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, digest) of files in any store that Spark reaches."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("digest"))


def table_hash(df: DataFrame) -> DataFrame:
    """One row: an order-free digest of a table and its row count."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.sum(h).cast("string").alias("digest"), F.count("*").alias("rows"))


def settings(path: str) -> dict:
    """A JSON or YAML file. Without PyYAML, YAML means nested mappings, lists and plain scalars, one to a line."""
    text = Path(path).read_text(encoding="utf-8")
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[:1] == text[-1:] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(t) for t in text[1:-1].split(",") if t.strip()]
    if text.lower() in ("", "~", "null"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _plain_yaml(text: str) -> dict:
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*", "", y).rstrip() for y in text.splitlines()) if x.strip()]

    def block(k: int, depth: int):
        out: dict | list | None = None
        while k < len(lines) and lines[k][0] == depth:
            line = lines[k][1]
            if line.startswith("- "):
                out = [] if out is None else out
                out.append(_scalar(line[2:]))
                k += 1
                continue
            name, colon, rest = line.partition(":")
            if not colon:
                raise ContractError(f"not a mapping: {line}")
            out = {} if out is None else out
            k += 1
            if not rest.strip() and k < len(lines) and (lines[k][0] > depth or (lines[k][0] == depth and lines[k][1].startswith("- "))):
                out[_scalar(name)], k = block(k, lines[k][0])
            else:
                out[_scalar(name)] = _scalar(rest)
        return out, k

    return block(0, lines[0][0])[0] if lines else {}


def read_configured(spark: SparkSession, config_path: str, path: str | None = None, *, key: str = "dataset_path", schema: T.StructType | None = None) -> DataFrame:
    """The CSV file that a configuration names, unless a path is given."""
    where = path or settings(config_path).get(key)
    if not where:
        raise ContractError(f"{config_path} has no {key}")
    return read_csv(spark, where, schema)


def read_presets(path: str, features: Sequence[str]) -> list:
    """Preference profiles of a configuration, each with values and weights for all features; weights within weight_scale."""
    from prismcat.operators.recommend import Profile

    found = settings(path)
    low, high = found.get("weight_scale", {}).get("min", 0), found.get("weight_scale", {}).get("max", 3)
    out = []
    for name, parts in found["presets"].items():
        for part in ("values", "weights"):
            if set(parts[part]) != set(features):
                raise ContractError(f"{name}: {part} are for {sorted(parts[part])}, not for {sorted(features)}")
        if any(not low <= w <= high for w in parts["weights"].values()):
            raise ContractError(f"{name}: weights lie between {low} and {high}")
        out.append(Profile(name, tuple(float(parts["values"][f]) for f in features), tuple(float(parts["weights"][f]) for f in features)))
    return out


def read_model_parameters(path: str, model: str) -> dict:
    """The parameters of one model; KeyError without them."""
    return dict(settings(path)["models"][model])


def config(kind: type[C], path: str) -> C:
    """A dataclass from a JSON or YAML file; unknown keys are an error."""
    values = settings(path)
    assert is_dataclass(kind)
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ContractError(f"unknown keys: {', '.join(sorted(unknown))}")
    return kind(**values)


def secrets(df: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """(pattern, rows): rows in which each pattern is found."""
    wide = df.agg(*[F.count_if(F.col(column).rlike(p)).alias(n) for n, p in patterns.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("rows")) for n in patterns])))
