"""Batch preparation of a raw catalog: quarantine, flags, normal forms, entities, bridges, groups.

Everything is one lazy plan per output table; nothing is collected. The quarantine, the entities and the bridges read
the same scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from prismcat.functions.features import constant_pattern
from prismcat.functions.text import fingerprint, with_normalized
from prismcat.operators import identity as I, quality as Q


@dataclass(frozen=True)
class PrepareRules:
    """How a raw catalog is read. Columns that are not there are skipped."""

    key: str = "track_id"
    identity: tuple[str, ...] = ("track_id", "artists", "album_name", "track_name")
    order: tuple[str, ...] = ("popularity", "ordinal")
    score: str = "popularity"
    label: str = "track_genre"
    makers: str = "artists"
    title: str = "track_name"
    duration: str = "duration_ms"
    drop: tuple[str, ...] = ("Unnamed: 0",)
    short_below: int = 60_000
    long_above: int = 600_000
    incomplete: Mapping[str, float] = field(default_factory=lambda: {"danceability": 0, "valence": 0, "tempo": 0, "time_signature": 0})
    group: tuple[str, ...] = ()


def flags(df: DataFrame, rules: PrepareRules) -> DataFrame:
    return df.withColumns(
        {
            "audio_analysis_incomplete": constant_pattern(df, dict(rules.incomplete)),
            "is_short_track": F.coalesce(F.col(rules.duration) < rules.short_below, F.lit(False)),
            "is_long_track": F.coalesce(F.col(rules.duration) > rules.long_above, F.lit(False)),
        }
    )


def prepare(raw: DataFrame, rules: PrepareRules = PrepareRules()) -> dict[str, DataFrame]:
    """The tables of a prepared catalog by name."""
    Q.require_columns(raw, [c for c in (rules.key, *rules.identity, rules.score, rules.label, rules.duration) if c])
    valid, invalid = Q.quarantine(raw.drop(*rules.drop), rules.identity)
    named = with_normalized(flags(valid, rules), [rules.title, rules.makers])
    skip = {rules.key, rules.label, rules.score, "ordinal"}
    columns = [c for c in named.columns if c not in skip]
    order = [F.col(c) for c in rules.order if c in named.columns]
    first = I.resolve_entities(named, rules.key, columns, order)
    tracks = first.join(I.observation_stats(named, rules.key, rules.score), rules.key).withColumn("duration_min", F.col(rules.duration) / 60000.0)
    group = list(rules.group) or [c for c in columns if c not in (rules.title, rules.makers, "album_name", "is_short_track", "is_long_track")]
    tracks = tracks.withColumn("recording_group_id", fingerprint(*group))
    genres = I.bridge(named, rules.key, rules.label)
    makers = I.split_bridge(tracks, rules.key, rules.makers, "artist")
    members = tracks.select("recording_group_id", rules.key)
    group_genres = members.join(genres, rules.key).select("recording_group_id", rules.label).distinct()
    best = I.representatives(tracks, "recording_group_id", f"{rules.score}_median", rules.key, [rules.title, rules.makers, "album_name", rules.duration, "audio_analysis_incomplete", f"{rules.score}_median"])
    recordings = I.with_count(best, group_genres, "recording_group_id", rules.label, "genre_count")
    recordings = I.with_count(recordings, members.join(makers, rules.key), "recording_group_id", "artist", "artist_count")
    return {
        "invalid_identity": invalid,
        "tracks": tracks,
        "track_genres": genres,
        "genre_catalog": I.dense_ids(genres, rules.label, "genre_id"),
        "track_artists": makers,
        "recording_tracks": members,
        "recording_genres": group_genres,
        "recordings": recordings,
        "anomalies": tracks.select(rules.key, "recording_group_id", "audio_analysis_incomplete", "is_short_track", "is_long_track"),
    }


def manifest(tables: Mapping[str, DataFrame], hashed: Sequence[str] = ()) -> dict:
    """Row counts, and order-free digests of the tables named."""
    from prismcat.sources.io import table_hash

    return {n: (table_hash(t).first().asDict() if n in hashed else {"rows": t.count()}) for n, t in tables.items()}
