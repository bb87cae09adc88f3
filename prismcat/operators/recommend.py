"""Ranking items: filters, nearest items, preference profiles, re-ranking, evaluation.

A catalog has the columns id, name, artists, genres (array), duration_ms, popularity, explicit, incomplete and f (array
of feature values). Every order ends in the id, so results are total.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from prismcat.functions.vectors import cosine, euclidean, scaled_vectors, weighted_distance


@dataclass(frozen=True)
class Filters:
    """What a result must satisfy; unset parts do not filter. A null popularity fails a minimum."""

    explicit: str = "all"
    genres: tuple[str, ...] = ()
    duration_min: float | None = None
    duration_max: float | None = None
    popularity_min: float | None = None
    different_artist: bool = False

    @classmethod
    def from_config(cls, values: dict) -> Filters:
        """Filters from a mapping of their names; what is not named keeps its default, an unknown name is an error."""
        known = {f.name for f in fields(cls)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if k == "genres" else v for k, v in values.items()})

    def __post_init__(self) -> None:
        if self.explicit not in ("all", "explicit", "non_explicit"):
            raise ValueError(f"explicit: {self.explicit}")

    def parts(self) -> dict[str, Column]:
        """Each rule as a predicate over catalog columns (and seed_artists)."""
        out: dict[str, Column] = {}
        if self.explicit != "all":
            out["explicit"] = F.col("explicit") if self.explicit == "explicit" else ~F.col("explicit")
        if self.genres:
            out["genres"] = F.coalesce(F.arrays_overlap("genres", F.array(*map(F.lit, self.genres))), F.lit(False))
        if self.duration_min is not None:
            out["duration_min"] = F.col("duration_ms") >= self.duration_min * 1000
        if self.duration_max is not None:
            out["duration_max"] = F.col("duration_ms") <= self.duration_max * 1000
        if self.popularity_min is not None:
            out["popularity_min"] = F.coalesce(F.col("popularity") >= self.popularity_min, F.lit(False))
        if self.different_artist:
            out["different_artist"] = F.col("artists") != F.col("seed_artists")
        return out

    def predicate(self) -> Column:
        out = F.lit(True)
        for p in self.parts().values():
            out = out & p
        return out


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def same_work() -> Column:
    """The seed itself under another id: same name and artists, unless the seed has no name."""
    return F.coalesce((_key(F.col("seed_name")) != "") & (_key(F.col("name")) == _key(F.col("seed_name"))) & (_key(F.col("artists")) == _key(F.col("seed_artists"))), F.lit(False))


def with_seed(catalog: DataFrame, seed: int | str) -> DataFrame:
    """Every other row with the seed's columns (seed_*) beside it: one row is broadcast."""
    one = catalog.where(F.col("id") == F.lit(seed)).limit(1).select(*[F.col(c).alias(f"seed_{c}") for c in ("name", "artists", "genres", "f")])
    return catalog.where(F.col("id") != F.lit(seed)).crossJoin(F.broadcast(one))


def eligible(catalog: DataFrame, exclude_incomplete: bool = True) -> DataFrame:
    return catalog.where(~F.col("incomplete")) if exclude_incomplete else catalog


def similar_items(catalog: DataFrame, seed: int | str, n: int = 10, *, filters: Filters = Filters(), exclude_same_work: bool = True, robust: bool = False, metric: str = "cosine") -> DataFrame:
    """(id, similarity): the n most similar eligible items. One scan, one row broadcast, a top-n without a full sort.

    Similarities are rounded to 12 places before ordering, so that ties are ties and the id decides.
    """
    table = with_seed(scaled_vectors(eligible(catalog), "f", robust=robust), seed)
    kept = table.where(filters.predicate() & (~same_work() if exclude_same_work else F.lit(True)))
    score = cosine(F.col("f"), F.col("seed_f")) if metric == "cosine" else 1 - euclidean(F.col("f"), F.col("seed_f"))
    return kept.select("id", F.round(score, 12).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(n)


def pool_sizes(n: int, total: int) -> list[int]:
    """Sizes of the growing candidate pool: max(100, 10 n), then 500 and 2000, then everything."""
    first = max(100, 10 * n)
    return [total] if first >= total else sorted({k for k in (first, 500, 2000) if first <= k < total}) + [total]


def affinity_items(catalog: DataFrame, seed: int | str, n: int = 10, *, filters: Filters = Filters()) -> DataFrame:
    """(id, similarity, shares_genre, pool): items that share a genre with the seed first, within the pool.

    The pool is the smallest of the sizes that holds n items passing the filters, by rank in the unfiltered order. The
    rank needs one order over the catalog; a pool that ends early is cut off before it, by a top-k.
    """
    table = with_seed(scaled_vectors(eligible(catalog), "f"), seed)
    scored = table.withColumn("similarity", F.round(cosine(F.col("f"), F.col("seed_f")), 12)).withColumn("passes", filters.predicate() & ~same_work())
    total = catalog.where(~F.col("incomplete")).count() - 1
    sizes = pool_sizes(n, max(1, total))
    columns = ["id", "similarity", "passes", F.coalesce(F.arrays_overlap("genres", "seed_genres"), F.lit(False)).alias("shares_genre")]
    order = (F.desc("similarity"), F.col("id"))
    pool, chosen = scored.select(*columns), sizes[-1]
    for size in sizes[:-1]:
        near = scored.select(*columns).orderBy(*order).limit(size)
        if near.where("passes").count() >= n:
            pool, chosen = near, size
            break
    return pool.where("passes").orderBy(F.desc("shares_genre"), *order).limit(n).select("id", "similarity", "shares_genre", F.lit(chosen).cast("long").alias("pool"))


def explanations(catalog: DataFrame, seed: int | str, results: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, feature, seed_value, value, difference, difference_std) of each result: differences in raw units and in deviations."""
    raw = with_seed(catalog, seed).join(F.broadcast(results.select("id")), "id")  # a result list is short
    stats = eligible(catalog).select(F.posexplode("f").alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("std"))
    long = raw.select("id", "seed_f", F.posexplode("f").alias("i", "value")).withColumn("seed_value", F.col("seed_f")[F.col("i")])
    label = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    difference = F.col("value") - F.col("seed_value")
    return long.join(F.broadcast(stats), "i").select("id", label.alias("feature"), "seed_value", "value", difference.alias("difference"), F.when(F.col("std") > 0, difference / F.col("std")).alias("difference_std"))


@dataclass(frozen=True)
class Profile:
    """Wanted feature values with weights, in the order of the catalog's features."""

    name: str
    values: tuple[float, ...]
    weights: tuple[float, ...]
    filters: Filters = field(default_factory=Filters)

    def __post_init__(self) -> None:
        if len(self.values) != len(self.weights):
            raise ValueError("values and weights differ in length")
        if any(w < 0 or w > 3 for w in self.weights) or sum(self.weights) <= 0:
            raise ValueError("weights lie between 0 and 3, and one at least is positive")


# The features of a preference profile, and for each preset its wanted values and their weights.
PREFERENCE_FEATURES = ("energy", "danceability", "valence", "acousticness", "instrumentalness", "tempo")
PRESETS = (
    Profile("entrenamiento_intenso", (0.90, 0.75, 0.65, 0.05, 0.05, 145), (3, 2, 1, 2, 1, 2)),
    Profile("fiesta", (0.85, 0.90, 0.75, 0.05, 0.02, 128), (2, 3, 2, 1, 1, 2)),
    Profile("concentracion_instrumental", (0.35, 0.30, 0.45, 0.55, 0.85, 90), (1, 1, 1, 2, 3, 1)),
    Profile("relajacion", (0.25, 0.35, 0.55, 0.75, 0.45, 80), (2, 1, 1, 2, 1, 2)),
    Profile("alegre_y_bailable", (0.72, 0.85, 0.88, 0.08, 0.02, 124), (2, 3, 3, 1, 1, 2)),
    Profile("melancolico", (0.30, 0.35, 0.15, 0.60, 0.20, 85), (2, 1, 3, 2, 1, 1)),
    Profile("acustico", (0.40, 0.45, 0.55, 0.90, 0.05, 95), (1, 1, 1, 3, 1, 1)),
)


def preset(name: str, presets: Sequence[Profile] = PRESETS) -> Profile:
    """The preset of a name; KeyError without one."""
    for p in presets:
        if p.name == name:
            return p
    raise KeyError(name)


def preferred_items(catalog: DataFrame, profile: Profile, n: int = 10) -> DataFrame:
    """(id, distance, similarity): the n items nearest to a profile given in scaled units; similarity is 1 / (1 + d)."""
    table = scaled_vectors(eligible(catalog), "f")
    d = F.round(weighted_distance(F.col("f"), profile.values, profile.weights), 12)
    rows = table.where(profile.filters.predicate()).select("id", d.alias("distance"), (1 / (1 + d)).alias("similarity"))
    return rows.orderBy("distance", "id").limit(n)


def in_scaled_units(presets: Sequence[Profile], catalog: DataFrame) -> list[Profile]:
    """Profiles whose values are given in the features' own units, in deviations from the catalog's means."""
    stats = eligible(catalog).select(F.posexplode("f").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("c"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row per feature
    return [replace(p, values=tuple((v - r["c"]) / (r["s"] or 1.0) for v, r in zip(p.values, stats, strict=True))) for p in presets]


def preset_items(catalog: DataFrame, presets: Sequence[Profile], n: int = 10) -> DataFrame:
    """(preset, id, distance, rank) for several profiles in one scan; at most n rows per profile and task are shuffled."""
    table = scaled_vectors(eligible(catalog), "f")
    scored = F.array(*[F.struct(F.lit(p.name).alias("preset"), F.when(p.filters.predicate(), F.round(weighted_distance(F.col("f"), p.values, p.weights), 12)).alias("distance")) for p in presets])
    rows = table.select("id", F.inline(scored)).where("distance is not null")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("preset").orderBy("distance", "id"))).where(F.col("rank") <= n)


def ood_reference(catalog: DataFrame) -> DataFrame:
    """One row: p95 and p99 of the distances to the centroid, in scaled units (the centroid is the origin there)."""
    from prismcat.functions.vectors import norm

    return scaled_vectors(eligible(catalog), "f").select(norm(F.col("f")).alias("d")).agg(F.percentile("d", F.array(F.lit(0.95), F.lit(0.99))).alias("p")).select(F.col("p")[0].alias("p95"), F.col("p")[1].alias("p99"))


def ood_status(distance: Column, p95: Column, p99: Column) -> Column:
    return F.when(distance > p99, "weak_match").when(distance > p95, "warning").otherwise("ok")


def mmr_order(items: Column, n: int, weight: float = 0.85) -> Column:
    """Greedy re-ranking of an array of structs (id, relevance, v): ids by weight * relevance - (1 - weight) * nearest pick.

    A fold over at most n steps in generated code; ties go to the earlier position.
    """
    empty = F.array().cast("array<int>")

    def pick(state: Column, _: Column) -> Column:
        def score(i: Column) -> Column:
            nearest = F.array_max(F.transform(state, lambda j: cosine(items[i]["v"], items[j]["v"])))
            value = F.when(F.size(state) == 0, items[i]["relevance"]).otherwise(weight * items[i]["relevance"] - (1 - weight) * nearest)
            return F.struct(F.round(value, 12).alias("s"), (-i).alias("p"))

        left = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: ~F.array_contains(state, i))
        best = F.array_max(F.transform(left, score))
        return F.when(F.size(left) == 0, state).otherwise(F.concat(state, F.array((-best["p"]).cast("int"))))

    order = F.aggregate(F.sequence(F.lit(1), F.lit(n)), empty, pick)
    return F.when(F.size(items) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(order, lambda i: items[i]["id"].cast("long")))


def rerank(results: DataFrame, catalog: DataFrame, weight: float = 0.85, n: int = 20) -> DataFrame:
    """(id, position): a short result list (id, similarity) re-ranked for diversity."""
    vectors = catalog.select("id", F.col("f").alias("v")).join(F.broadcast(results.select("id", "similarity")), "id")
    one = vectors.agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "id", F.col("similarity").alias("relevance"), "v"))).alias("items"))
    return one.select(F.posexplode(mmr_order(F.col("items"), n, weight)).alias("p", "id")).select("id", (F.col("p") + 1).cast("long").alias("position"))


def batch_similar(catalog: DataFrame, seeds: DataFrame, n: int = 10) -> DataFrame:
    """(seed, id, similarity, rank) for many seeds at once: the exact blocked kNN join over scaled features."""
    from prismcat.functions.vectors import knn_join

    table = scaled_vectors(eligible(catalog), "f")
    near = knn_join(table.join(seeds.select("id"), "id", "left_semi"), table, "id", "f", n)
    return near.select(F.col("a").alias("seed"), F.col("b").alias("id"), "similarity", "rank")


def evaluate(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: mean_similarity, coverage, self_recommendations and repeated results of lists (seed, id, similarity)."""
    size = eligible(catalog).agg(F.count("*").alias("_n"))
    sums = results.agg(F.avg("similarity").alias("mean_similarity"), F.count_distinct("id").alias("_ids"), F.count_if(F.col("seed") == F.col("id")).alias("self_recommendations"), (F.count("*") - F.count_distinct(F.struct("seed", "id"))).alias("repeated"))
    return sums.crossJoin(F.broadcast(size)).select("mean_similarity", (F.col("_ids") / F.col("_n")).alias("coverage"), "self_recommendations", "repeated")


def filter_violations(results: DataFrame, catalog: DataFrame, filters: Filters, seed: int | str) -> DataFrame:
    """(rule, violations): how many results break each rule."""
    from prismcat.operators.quality import conditional_counts

    rows = with_seed(catalog, seed).join(F.broadcast(results.select("id")), "id")
    return conditional_counts(rows, {n: ~F.coalesce(p, F.lit(False)) for n, p in filters.parts().items()}).toDF("rule", "violations")


def mean_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean over seeds of the Jaccard similarity of two sets of results (seed, id)."""
    x = a.groupBy("seed").agg(F.collect_set("id").alias("x"))
    y = b.groupBy("seed").agg(F.collect_set("id").alias("y"))
    return x.join(y, "seed").agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("mean_jaccard"), F.count("*").alias("seeds"))


def coherence(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """(seed, coherence): share of a seed's results that share a genre with it."""
    genres = catalog.select("id", "genres")
    own = genres.toDF("seed", "seed_genres")
    rows = results.join(genres, "id").join(own, "seed")
    return rows.groupBy("seed").agg(F.avg(F.coalesce(F.arrays_overlap("genres", "seed_genres"), F.lit(False)).cast("double")).alias("coherence"))


def summary(df: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    """One row: mean, p25, median, p75 and the share of values that reach the threshold."""
    x = F.col(column)
    p = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.avg(x).alias("mean"), p.alias("p"), F.avg((x >= threshold).cast("double")).alias("reached")).select("mean", F.col("p")[0].alias("p25"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p75"), "reached")
