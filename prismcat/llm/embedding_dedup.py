"""Near-duplicate embeddings: spherical k-means cells, exact blocked cosine products inside them.

Equal vectors of a label are one vector with a count. A spherical k-means on a bounded sample gives centres; each vector
is at home in the cell of its nearest centre, and a guest of every other cell in which a vector within reach could be at
home. Unit vectors with cosine s are sqrt(2 - 2s) apart, so a partner of x can only be at home in cell d, x being at home
in c, if x . (c - d) <= sqrt(2 - 2s) |c - d|: no link is lost at a cell's border. A pair meets once, in the later of the
two home cells. A cell, however large, is cut into bands of distance from its centre, as wide as the reach, so that
partners are in the same or the next band, and those into chunks. Each pair of chunks of such bands is a task of bounded
size that returns sums per vector and a star per group of linked vectors, never the pairs.

Defined results: a vector that is null, empty or zero, holds a null or non-finite component, or has no label or id links
with nothing; vectors of different lengths do not link; each row of repeated rows counts as a vector; a null vec_id has
a null component and is not kept; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prismcat.llm.common import read, written
from prismcat.llm.components import connected_components, union_find

SIMILARITY = 0.98
#: The centres are fitted on at most so many vectors, of so many bytes in all; a cell is meant to have so many rows, and a
#: centre to have so many vectors of the sample.
SAMPLE, SAMPLE_BYTES, CELL, PER_CENTRE = 40_000, 64_000_000, 2_000, 10
#: A task compares at most two chunks of about so many rows.
CHUNK = 2_000
ROUNDS = 8


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k unit centres of unit vectors; an empty cell takes the vector that fits its centre least."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home, fit = np.zeros(len(x), np.int64), np.zeros(len(x))
        for at in range(0, len(x), 1000):
            sims = x[at : at + 1000] @ centres.T
            home[at : at + 1000], fit[at : at + 1000] = sims.argmax(axis=1), sims.max(axis=1)
        order = np.argsort(home, kind="stable")
        full, starts = np.unique(home[order], return_index=True)
        sums = np.zeros_like(centres)
        sums[full] = np.add.reduceat(x[order], starts)
        worst = iter(np.argsort(fit, kind="stable"))
        for c in np.flatnonzero(np.bincount(home, minlength=len(centres)) == 0):
            sums[c] = x[next(worst)]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def distances(centres: np.ndarray) -> np.ndarray:
    """Distances between all centres, by products: the memory is that of the result."""
    square = (centres**2).sum(axis=1)
    return np.sqrt(np.maximum(0.0, square[:, None] + square - 2 * (centres @ centres.T)))


def _unit(rows: list[list[float]]) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # against overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(a: np.ndarray, b: np.ndarray, similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b with a cosine of at least `similarity`; within one chunk each pair once."""
    hit = a @ b.T >= similarity
    if same:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def compare_chunks(table: pa.Table, similarity: float) -> list[tuple[int, int | None, int]]:
    """Rows (u, null, links to add) and (u, v, 0) for a star over each group of linked vectors of a task."""
    first = np.asarray(table["first"].to_pylist(), bool)
    second = np.asarray(table["second"].to_pylist(), bool)
    ids = np.asarray(table["rep"].to_pylist(), np.int64)
    copies = np.asarray(table["copies"].to_pylist(), np.int64)
    x = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(ids), -1)
    same = bool((first & second).any())
    i, j = np.flatnonzero(first), np.flatnonzero(second)
    links = np.zeros(len(ids), np.int64)
    stars: list[tuple[int, int]] = []
    for at in range(0, len(i), 512):
        part = i[at : at + 512]
        a, b = linked_pairs(x[part], x[j], similarity, False)
        a, b = part[a], j[b]
        if same:
            keep = a < b
            a, b = a[keep], b[keep]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        stars += [(p, q) for p, q in union_find(zip(ids[a].tolist(), ids[b].tolist(), strict=True)).items() if p != q]
    stars = [(p, q) for p, q in union_find(iter(stars)).items() if p != q]
    return [(int(ids[k]), None, int(links[k])) for k in np.flatnonzero(links)] + [(p, q, 0) for p, q in stars]


def dedup_embeddings(vectors: DataFrame, *, similarity: float = SIMILARITY, chunk: int = CHUNK, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", good) & F.exists("v", lambda x: x != 0)
    keyed = rows.withColumn("ok", F.coalesce(fit, F.lit(False))).withColumns(
        {"h1": F.when(F.col("ok"), F.xxhash64("label", "v")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(9), "v", "label"))}
    )
    unique = written(
        spark,
        keyed.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("v").alias("v")).withColumn("dim", F.size("v")),
        "unique",
    )
    groups = unique.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n"), F.sum("count").alias("all")).orderBy(F.desc("all"), "dim").limit(1).collect()
    centres, dim = np.zeros((1, 1)), 0
    if groups:
        dim = groups[0]["dim"]
        bound = max(PER_CENTRE, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        wanted = max(1, min(bound // PER_CENTRE, math.ceil(groups[0]["n"] / cell)))
        if wanted > 1:
            first = unique.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(bound).select("v")
            centres = spherical_kmeans(_unit(np.stack(first.toPandas()["v"].to_numpy())), wanted)
        else:
            centres = np.zeros((1, dim))
    reach = math.sqrt(max(0.0, 2 - 2 * similarity))
    apart = distances(centres)
    width = max(reach, 1e-3) * (1 + 1e-6) + 1e-6  # of a band, with room for rounding

    norms = (centres**2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, rep, v in zip(*(batch.column(n).to_pylist() for n in ("dim", "rep", "v")), strict=True):
                out.append((rep, _unit([v])[0], d))
            cells: list[list[int]] = []
            bands: list[list[int]] = []
            main = [k for k, o in enumerate(out) if o[2] == dim]
            sims = np.asarray([out[k][1] for k in main]) @ centres.T if main else np.zeros((0, 1))
            by_row = dict(zip(main, sims, strict=True))
            for k in range(len(out)):
                if k not in by_row:
                    cells.append([0])
                    bands.append([0])
                    continue
                s = by_row[k]
                home = int(s.argmax())
                near = np.flatnonzero(s[home] - s <= reach * apart[home] + 1e-7)
                cells.append([home, *[int(c) for c in near if c > home]])
                bands.append((np.sqrt(np.maximum(0.0, 1 + norms[cells[-1]] - 2 * s[cells[-1]])) // width).astype(int).tolist())
            sizes = [len(c) for c in cells]
            at = np.repeat(np.arange(len(out)), sizes)
            taken = batch.select(["label", "rep", "copies", "dim"]).take(pa.array(at))
            unit = [out[k][1].tobytes() for k in at]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array([c for cs in cells for c in cs], pa.int32()), pa.array([k == 0 for cs in cells for k in range(len(cs))]), pa.array([b for bs in bands for b in bs], pa.int64()), pa.array(unit, pa.binary())],
                names=["label", "rep", "copies", "dim", "cell", "home", "band", "unit"],
            )

    label_type = dict(unique.dtypes)["label"]
    members = written(spark, unique.select("label", "rep", "copies", "dim", "v").mapInArrow(assign, f"label {label_type}, rep long, copies long, dim int, cell int, home boolean, band long, unit binary"), "cells")
    key = ["label", "dim", "cell"]
    chunks = lambda n: F.ceil(n / chunk).cast("int")
    sizes = members.groupBy(*key, "band").agg(chunks(F.count_if("home")).alias("h"), chunks(F.count_if(~F.col("home"))).alias("g"))
    # Chunks of homes (h) and guests (g) in a band and in the ones beside it.
    sides = (("lower", -1), ("same", 0), ("upper", 1))
    beside = sizes.withColumn("step", F.explode(F.array(*[F.lit(k) for _, k in sides]))).withColumn("band", F.col("band") - F.col("step"))
    per = [F.coalesce(F.max(F.when(F.col("step") == k, F.col(n))), F.lit(0)).alias(f"{n}_{side}") for side, k in sides for n in "hg"]
    sized = members.join(beside.groupBy(*key, "band").agg(*per), [*key, "band"])
    place = lambda band, c: band * (1 << 32) + c
    own = place(F.col("band"), F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("h_same")).otherwise(F.col("g_same"))))
    task = lambda a, b, kind, first, second: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), first.alias("first"), second.alias("second"))
    yes, no, c = F.lit(True), F.lit(False), F.col("c")

    def others(kind: str, make) -> Column:
        """make(chunk) for all chunks of homes or guests in this band and those beside it."""

        def part(n: Column, band: Column) -> Column:
            return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda j: make(place(band, j.cast("long"))))

        return F.concat(*[part(F.col(f"{kind}_{side}"), F.col("band") + k) for side, k in sides])

    among = others("h", lambda j: task(F.least(c, j), F.greatest(c, j), 0, c <= j, c >= j))
    hosts = others("g", lambda j: task(c, j, 1, yes, no))
    visits = others("h", lambda i: task(i, c, 1, no, yes))
    tasks = sized.withColumn("c", own).withColumn("t", F.explode(F.when(F.col("home"), F.concat(among, hosts)).otherwise(visits))).select(*key, "t.*", "rep", "copies", "unit")

    def compare(table: pa.Table) -> pa.Table:
        found = compare_chunks(table, similarity)
        return pa.table({"u": pa.array([r[0] for r in found], pa.int64()), "v": pa.array([r[1] for r in found], pa.int64()), "n": pa.array([r[2] for r in found], pa.int64())})

    found = written(spark, tasks.groupBy(*key, "a", "b", "kind").applyInArrow(compare, "u long, v long, n long"), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("id", "rep")
    per_unique = unique.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left")
    per_unique = per_unique.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return (
        keyed.select("vec_id", "h1", "h2")
        .join(per_unique, ["h1", "h2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op1(spark, sf_dir: str) -> DataFrame:
    return dedup_embeddings(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS c FROM e UNION SELECT l.w, r.c FROM r JOIN l ON l.u = r.u),
comp AS (SELECT u, min(c) AS c FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
FROM e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN comp ON comp.u = e.vec_id
"""
