"""Tables of the event warehouse as Spark schemas, with their keys, checks and indexes as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prismcat.operators.quality import constraint_checks, orphans

# Tables and columns of the warehouse; a question mark marks a column that may be null.
COLUMNS = {
    "app_sessions": "session_id char(36), started_at timestamp, last_seen_at timestamp, app_version varchar(50), environment varchar(20)",
    "recommendation_events": "event_id char(36), session_id char(36), created_at timestamp, recommendation_type varchar(20), selected_track_id varchar(100)?, selected_recording_group_id char(64)?, selected_preset varchar(100)?, query_payload json, requested_result_count smallint, returned_result_count smallint, model_version varchar(100), latency_ms int",
    "recommendation_results": "event_id char(36), result_position smallint, recommended_recording_group_id char(64), recommended_track_id varchar(100), similarity_score decimal(10,9)?, distance_score decimal(14,9)?, explanation_payload json?",
    "classifier_events": "event_id char(36), session_id char(36), created_at timestamp, classifier_type varchar(20), selected_track_id varchar(100), selected_recording_group_id char(64), model_version varchar(100), true_labels_payload json?, threshold_value decimal(8,6)?, latency_ms int",
    "classifier_predictions": "event_id char(36), prediction_rank smallint, genre varchar(100), score decimal(10,9), passed_threshold boolean",
    "feedback_events": "feedback_id char(36), session_id char(36), created_at timestamp, source_event_id char(36), source_type varchar(30), target_recording_group_id char(64)?, feedback_value tinyint, reason_code varchar(50)?",
}
# Primary keys, checks, foreign keys and indexes.
PRIMARY_KEYS = {
    "app_sessions": ("session_id",),
    "recommendation_events": ("event_id",),
    "recommendation_results": ("event_id", "result_position"),
    "classifier_events": ("event_id",),
    "classifier_predictions": ("event_id", "prediction_rank"),
    "feedback_events": ("feedback_id",),
}
CHECKS = {
    "app_sessions": {"environment": "environment in ('development', 'test', 'production')"},
    "recommendation_events": {
        "recommendation_type": "recommendation_type in ('track', 'preferences')",
        "requested_result_count": "requested_result_count between 1 and 100",
        "returned_result_count": "returned_result_count between 0 and 100",
    },
    "recommendation_results": {"result_position": "result_position between 1 and 100", "similarity_score": "similarity_score between -1.0 and 1.0", "distance_score": "distance_score >= 0.0"},
    "classifier_events": {"classifier_type": "classifier_type in ('multilabel', 'multiclass')", "threshold_value": "threshold_value between 0.0 and 1.0"},
    "classifier_predictions": {"prediction_rank": "prediction_rank between 1 and 114", "score": "score between 0.0 and 1.0"},
    "feedback_events": {"source_type": "source_type in ('recommendation_list', 'recommendation_item', 'classifier')", "feedback_value": "feedback_value in (-1, 1)"},
}
FOREIGN_KEYS = [
    ("recommendation_events", "session_id", "app_sessions", "session_id"),
    ("recommendation_results", "event_id", "recommendation_events", "event_id"),
    ("classifier_events", "session_id", "app_sessions", "session_id"),
    ("classifier_predictions", "event_id", "classifier_events", "event_id"),
    ("feedback_events", "session_id", "app_sessions", "session_id"),
]
INDEXES = {
    "app_sessions": [("last_seen_at",)],
    "recommendation_events": [("created_at",), ("session_id",), ("model_version",)],
    "recommendation_results": [("recommended_recording_group_id",)],
    "classifier_events": [("created_at",), ("session_id",), ("model_version",)],
    "classifier_predictions": [("genre",)],
    "feedback_events": [("created_at",), ("source_event_id", "source_type")],
}
_TYPES = {"json": T.StringType(), "timestamp": T.TimestampType(), "smallint": T.IntegerType(), "tinyint": T.IntegerType(), "int": T.LongType(), "boolean": T.BooleanType()}


def _type(name: str) -> T.DataType:
    kind, _, size = name.partition("(")
    if kind == "decimal":
        return T.DecimalType(*map(int, size.rstrip(")").split(",")))
    return _TYPES.get(kind, T.StringType())


def _parts(table: str) -> list[tuple[str, str, bool]]:
    """(column, declared type, may be null) of a table."""
    return [(name, kind.rstrip("?"), kind.endswith("?")) for name, kind in (c.split(" ") for c in COLUMNS[table].split(", "))]


TABLES = {t: T.StructType([T.StructField(n, _type(k), nullable) for n, k, nullable in _parts(t)]) for t in COLUMNS}


def violations(table: str, df: DataFrame) -> DataFrame:
    """(check, violations): rows that break each check of a table, or leave a required column null, or are too long for it. A check of a null holds."""
    checks = {n: F.coalesce(F.expr(c), F.lit(True)) for n, c in CHECKS.get(table, {}).items()}
    for name, kind, nullable in _parts(table):
        if not nullable:
            checks[f"{name} not null"] = F.col(name).isNotNull()
        if kind.startswith(("char", "varchar")):
            checks[f"{name} length"] = F.coalesce(F.length(name) <= int(kind.split("(")[1].rstrip(")")), F.lit(True))
    return constraint_checks(df, checks)


def repeated_keys(table: str, df: DataFrame) -> DataFrame:
    """Primary keys of a table that more than one row has."""
    return df.groupBy(*PRIMARY_KEYS[table]).count().where("count > 1")


def broken_references(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {f"{c}.{k}": orphans(tables[c], k, tables[p], pk).count() for c, k, p, pk in FOREIGN_KEYS if c in tables and p in tables}


def delete_cascade(tables: dict[str, DataFrame], table: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of `gone` (the key column of a table) and without all rows that refer to them, directly or not."""
    key = PRIMARY_KEYS[table][0]
    out = dict(tables)
    lost = out[table].join(gone.select(key), key, "left_semi")
    out[table] = out[table].join(gone.select(key), key, "left_anti").select(*tables[table].columns)
    for child, column, parent, parent_key in FOREIGN_KEYS:
        if parent == table and child in out:
            held = out[child].join(lost.select(F.col(parent_key).alias(column)).distinct(), column, "left_semi")
            out = delete_cascade(out, child, held.select(PRIMARY_KEYS[child][0]).distinct())
    return out


def introspect(spark: SparkSession) -> dict[str, DataFrame]:
    """What the schema declares, as ordered tables: tables, columns, keys (primary and foreign), checks, indexes."""
    columns = [(t, n, k + 1, kind, nullable) for t in COLUMNS for k, (n, kind, nullable) in enumerate(_parts(t))]
    keys = [(t, c, k + 1, "primary", None, None) for t, cs in PRIMARY_KEYS.items() for k, c in enumerate(cs)] + [(c, k, 1, "foreign", p, pk) for c, k, p, pk in FOREIGN_KEYS]
    checks = [(t, n, c) for t, cs in CHECKS.items() for n, c in cs.items()]
    indexes = [(t, "_".join(i), c, k + 1) for t, many in INDEXES.items() for i in many for k, c in enumerate(i)]
    return {
        "tables": spark.createDataFrame([(t,) for t in COLUMNS], "table_name string").orderBy("table_name"),
        "columns": spark.createDataFrame(columns, "table_name string, column_name string, position int, type string, nullable boolean").orderBy("table_name", "position"),
        "keys": spark.createDataFrame(keys, "table_name string, column_name string, position int, kind string, referenced_table string, referenced_column string").orderBy("table_name", "kind", "position"),
        "checks": spark.createDataFrame(checks, "table_name string, constraint_name string, clause string").orderBy("table_name", "constraint_name"),
        "indexes": spark.createDataFrame(indexes, "table_name string, index_name string, column_name string, position int").orderBy("table_name", "index_name", "position"),
    }


def missing_columns(spark: SparkSession, database: str) -> list[str]:
    """Tables and columns of the schema that a database of the session's catalog lacks."""
    there = {t.name for t in spark.catalog.listTables(database)}
    out = [t for t in COLUMNS if t not in there]
    for t in COLUMNS:
        if t in there:
            found = {c.name for c in spark.catalog.listColumns(f"{database}.{t}")}
            out += [f"{t}.{n}" for n, _, _ in _parts(t) if n not in found]
    return out


def create_tables(spark: SparkSession, database: str) -> None:
    """Empty tables of the schema in a database, where they are not there yet."""
    spark.sql(f"create database if not exists `{database}`")
    for t, schema in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{t}"):
            spark.createDataFrame([], schema).write.format("parquet").saveAsTable(f"{database}.{t}")
