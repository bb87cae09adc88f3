"""More of the catalogue: built indexes, studies of lists, datasets and serving, the warehouse."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismcat.operators import datasets as D, index as N, recommend as R, search as C, study as Y
from prismcat.plans.catalog import _FILTERS, _FILTERS_SQL, _WANTED, SEED, _cat, _distance, item_catalog, query, rounded, table
from prismcat.sources import warehouse


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one on a single machine without that setting. It goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended
        return


# --- built indexes ---------------------------------------------------------------------------------------------------

_indexes: dict[tuple, str] = {}


def built(spark: SparkSession, d: str, dims: int, reference: bool = False) -> N.Index:
    """The index of a folder's items: built once in a session, loaded after."""
    key = (spark.sparkContext.applicationId, d, dims, reference)
    if key not in _indexes:
        path = work_folder(spark, "index")
        N.build_index(item_catalog(spark, d, dims), path, reference=reference)
        _indexes[key] = path
    return N.load_index(spark, _indexes[key])


@query(f"WITH {_cat(64)} SELECT id, round(similarity, 6) AS similarity FROM sim WHERE NOT (name = seed_name AND artists = seed_artists) ORDER BY sim.similarity DESC, id LIMIT 10")
def index_topk(spark, d):
    return rounded(N.similar_in(built(spark, d, 64), SEED, 10))


@query(f"WITH {_cat()} SELECT id, round(similarity, 6) AS similarity FROM sim WHERE {_FILTERS_SQL} ORDER BY sim.similarity DESC, id LIMIT 10")
def index_topk_filtered(spark, d):
    return rounded(N.similar_in(built(spark, d, 9), SEED, 10, filters=_FILTERS))


_OWN = sum(v * v for v in _WANTED.values) ** 0.5


@query(f"""WITH {_cat(6)}, n AS (SELECT sqrt(list_sum(list_transform(z, lambda x: x * x))) AS d FROM z), o AS (SELECT quantile_cont(d, 0.95) AS p95, quantile_cont(d, 0.99) AS p99 FROM n), p AS (SELECT id, {_distance(_WANTED)} AS dd FROM z)
SELECT id, round(dd, 6) AS distance, round(1 / (1 + dd), 6) AS similarity, CASE WHEN {_OWN} > p99 THEN 'weak_match' WHEN {_OWN} > p95 THEN 'warning' ELSE 'ok' END AS status FROM p, o ORDER BY dd, id LIMIT 10""")
def preference_index_topk(spark, d):
    return rounded(N.preferred_in(built(spark, d, 6, True), _WANTED))


_PRESETS_SQL = " UNION ALL ".join(
    f"SELECT '{p.name}' AS preset, id, round(sqrt(("
    + " + ".join(f"{float(w)} * pow(z[{k + 1}] - (({float(v)}::DOUBLE) - c[{k + 1}]) / s[{k + 1}], 2)" for k, (v, w) in enumerate(zip(p.values, p.weights, strict=True)))
    + f") / {float(sum(p.weights))}), 12) AS dd FROM z, u"
    for p in R.PRESETS
)


@query(f"""WITH {_cat(6)}, u AS (SELECT list(c ORDER BY i) AS c, list(s ORDER BY i) AS s FROM st), p AS ({_PRESETS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY preset ORDER BY dd, id) AS rank FROM p)
SELECT preset, id, round(dd, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def seven_presets_topk(spark, d):
    items = item_catalog(spark, d, 6)
    return rounded(R.preset_items(items, R.in_scaled_units(R.PRESETS, items)), 5)


@query("""SELECT vec_id AS id, 'song ' || (vec_id % 120) AS name, CAST(vec_id % 100 AS DOUBLE) AS popularity FROM embeddings WHERE contains(lower('song ' || (vec_id % 120)), 'ong 7') AND contains(lower('artist ' || (vec_id % 40)), 'artist 3') ORDER BY popularity DESC, id LIMIT 1""")
def seed_match(spark, d):
    return C.find_seed(item_catalog(spark, d), "ONG 7", "Artist 3").select("id", "name", "popularity")


# --- studies of lists ------------------------------------------------------------------------------------------------

_LISTS = """b AS (SELECT x.id AS seed, y.id AS id, list_cosine_similarity(x.z, y.z) AS similarity FROM z x JOIN z y ON x.id <> y.id WHERE x.id % 20 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, id) AS rank FROM b), res AS (SELECT * FROM rk WHERE rank <= 10)"""


def _seeds(spark, d):
    items = item_catalog(spark, d)
    return items, items.where("id % 20 = 0")


@query(f"""WITH {_cat()}, {_LISTS}, l AS (SELECT seed, count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT artists) AS artists, stddev_samp(res.similarity) AS dv, sum(res.similarity) AS s, bool_or(seed = id) AS own FROM res JOIN cat USING (id) GROUP BY 1)
SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS total_results, count(*) FILTER (own) AS self_recommendations, CAST(sum(n - ids) AS BIGINT) AS duplicates, round(sum(s) / sum(n), 6) AS mean_similarity, round(avg(artists / n) FILTER (n > 1), 6) AS unique_artists,
round(avg(dv) FILTER (n > 1), 6) AS internal_diversity, round(100 * (SELECT count(DISTINCT id) FROM res) / (SELECT count(*) FROM cat), 6) AS coverage_pct FROM l""")
def offline_evaluation(spark, d):
    items, seeds = _seeds(spark, d)
    return rounded(Y.evaluate_lists(R.batch_similar(items, seeds, 10), items))


_NORMAL = "sqrt(-2 * ln((CAST('0x' || substr(md5('42:' || smp || ':' || id || ':' || i), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE)) * cos(2 * pi() * (CAST('0x' || substr(md5('43:' || smp || ':' || id || ':' || i), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE))"


@query(f"""WITH {_cat()}, {_LISTS}, q AS (SELECT id, CAST(unnest(range(0, 20)) AS INTEGER) AS smp, z FROM z WHERE id % 20 = 0), e AS (SELECT id, smp, z, CAST(unnest(range(0, 9)) AS INTEGER) AS i FROM q),
m AS (SELECT id, smp, list(z[i + 1] + 0.01 * {_NORMAL} ORDER BY i) AS z FROM e GROUP BY 1, 2),
nb AS (SELECT m.id AS seed, smp, y.id, row_number() OVER (PARTITION BY m.id, smp ORDER BY list_cosine_similarity(m.z, y.z) DESC, y.id) AS rank FROM m JOIN z y ON y.id <> m.id),
x AS (SELECT seed, list(DISTINCT id) AS x FROM res GROUP BY 1), y AS (SELECT seed, smp, list(DISTINCT id) AS y FROM nb WHERE rank <= 10 GROUP BY 1, 2)
SELECT round(avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS mean_jaccard, count(*) AS lists FROM x JOIN y USING (seed)""")
def noise_stability(spark, d):
    items, seeds = _seeds(spark, d)
    return rounded(Y.stability(R.batch_similar(items, seeds, 10), Y.noisy_lists(items, seeds, 10)))


_WEIGHTS = (1.0, 2.0, 0.5, 1.0, 1.0, 3.0, 1.0, 1.0, 0.5)
_FAR = "sqrt(" + " + ".join(f"{w / sum(_WEIGHTS)!r}::DOUBLE * pow(x.z[{k + 1}] - y.z[{k + 1}], 2)" for k, w in enumerate(_WEIGHTS)) + ")"
_STUDY = f"""{_LISTS}, wd AS (SELECT x.id AS seed, y.id AS id, list_cosine_similarity(x.z, y.z) AS similarity, row_number() OVER (PARTITION BY x.id ORDER BY {_FAR}, y.id) AS rank FROM z x JOIN z y ON x.id <> y.id WHERE x.id % 20 = 0),
raw AS (SELECT 'pool' AS variant, seed, id, similarity FROM rk WHERE rank <= 100 UNION ALL SELECT 'baseline', seed, id, similarity FROM res UNION ALL SELECT 'weighted', seed, id, similarity FROM wd WHERE rank <= 10),
sh AS (SELECT raw.*, list_has_any(a.genres, c.genres) AS shares FROM raw JOIN cat a ON a.id = raw.id JOIN cat c ON c.id = raw.seed),
af AS (SELECT 'affinity' AS variant, seed, id, similarity, shares FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY shares DESC, similarity DESC, id DESC) AS r FROM sh WHERE variant = 'pool') WHERE r <= 10),
al AS (SELECT * FROM sh UNION ALL SELECT * FROM af), per AS (SELECT variant, seed, avg(CAST(shares AS INTEGER)) AS c, avg(similarity) AS s FROM al GROUP BY 1, 2)"""


def _study(spark, d):
    items, seeds = _seeds(spark, d)
    return items, Y.study_lists(items, seeds, _WEIGHTS)


@query(f"WITH {_cat()}, {_STUDY} SELECT variant, round(avg(c), 6) AS coherence, round(avg(s), 6) AS mean_cosine, count(*) AS seeds FROM per GROUP BY 1")
def relevance_study(spark, d):
    return rounded(Y.study_summary(_study(spark, d)[1]))


@query(f"""WITH {_cat()}, {_STUDY}, w AS (SELECT seed, max(c) FILTER (variant = 'baseline') AS b, max(c) FILTER (variant = 'weighted') AS w, max(c) FILTER (variant = 'affinity') AS a, max(c) FILTER (variant = 'pool') AS p FROM per GROUP BY 1),
g AS (SELECT id AS seed, unnest(list_distinct(genres)) AS genre FROM cat)
SELECT genre, count(*) AS seeds, round(avg(p), 6) AS availability, round(avg(b), 6) AS baseline, round(avg(w), 6) AS weighted, round(avg(a), 6) AS affinity, round(avg(a) - avg(b), 6) AS gain, avg(p) = 0 AND count(*) >= 5 AS unrecoverable FROM w JOIN g USING (seed) GROUP BY 1""")
def relevance_by_genre(spark, d):
    items, lists = _study(spark, d)
    return rounded(Y.study_by_genre(lists, items))


# --- datasets, serving -----------------------------------------------------------------------------------------------


def _entities(spark, d) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("label")).distinct()
    return parts, lines


_DATA = "li AS (SELECT DISTINCT l_partkey AS id, l_returnflag || l_linestatus AS label FROM lineitem), cg AS (SELECT list(DISTINCT label ORDER BY label) AS c FROM li), ow AS (SELECT id, list(label) AS o FROM li GROUP BY 1)"


@query(f"WITH {_DATA} SELECT p_partkey AS id, round(CAST(p_size AS DOUBLE), 6) AS a, round(p_retailprice, 6) AS b, array_to_string(list_transform(c, lambda x: CAST(CAST(list_contains(o, x) AS INTEGER) AS VARCHAR)), '') AS y FROM part JOIN ow ON id = p_partkey, cg")
def multilabel_dataset(spark, d):
    data = D.multilabel_dataset(*_entities(spark, d), ["a", "b"])
    D.check_dataset(data)
    return rounded(data.select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.concat_ws("", F.transform("y", lambda v: v.cast("string"))).alias("y")))


@query("WITH o AS (SELECT l_orderkey AS id, list(DISTINCT l_linestatus) AS o FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, round(o_totalprice, 6) AS a, o[1] AS label FROM orders JOIN o ON id = o_orderkey WHERE len(o) = 1")
def multiclass_dataset(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("label"))
    data = D.multiclass_dataset(orders, lines, ["a"])
    D.check_dataset(data, arrays=["x"])
    return rounded(data.select("id", F.col("x")[0].alias("a"), "label"))


_MATRIX = """p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, p_partkey % 7 = 0 AS incomplete, CASE p_partkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM part)"""


def _matrix(spark, d, policy: str) -> DataFrame:
    rows = _entities(spark, d)[0].withColumns({"incomplete": F.col("id") % 7 == 0, "split": F.when(F.col("id") % 5 == 0, "test").when(F.col("id") % 5 == 1, "validation").otherwise("train")})
    kept, names = D.apply_policy(rows, policy, F.col("incomplete"), ["a", "b"], F.col("split") == "train")
    data = kept.select("id", "split", F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    return rounded(D.training_matrix(data, use_test=policy == "B").select("id", "split", *[F.col("x")[k].alias(n) for k, n in enumerate(names)]), 5)


@query(f"""WITH {_MATRIX}, k AS (SELECT * FROM p WHERE NOT incomplete), t AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM k WHERE split = 'train')
SELECT id, split, round((a - ma) / sa, 5) AS a, round((b - mb) / sb, 5) AS b FROM k, t WHERE split <> 'test'""")
def training_matrix_a(spark, d):
    return _matrix(spark, d, "A")


@query(f"""WITH {_MATRIX}, md AS (SELECT quantile_cont(a, 0.5) AS qa, quantile_cont(b, 0.5) AS qb FROM p WHERE split = 'train' AND NOT incomplete), k AS (SELECT id, split, CASE WHEN incomplete THEN qa ELSE a END AS a, CASE WHEN incomplete THEN qb ELSE b END AS b, CAST(incomplete AS DOUBLE) AS imputed FROM p, md),
t AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(imputed) AS mi, stddev_pop(imputed) AS si FROM k WHERE split = 'train')
SELECT id, split, round((a - ma) / sa, 5) AS a, round((b - mb) / sb, 5) AS b, round((imputed - mi) / si, 5) AS imputed FROM k, t""")
def training_matrix_b(spark, d):
    return _matrix(spark, d, "B")


@query("""WITH s AS (SELECT list_transform(embedding[1:10], lambda x: CAST(abs(x) AS DOUBLE)) AS s FROM embeddings WHERE vec_id = 7), u AS (SELECT unnest(s) AS score, unnest(range(0, 10)) AS i FROM s)
SELECT CAST(row_number() OVER (ORDER BY score DESC, i) AS INTEGER) AS prediction_rank, 'l' || i AS label, round(score, 6) AS score, score >= 0.1 AS passed_threshold FROM u ORDER BY score DESC, i LIMIT 5""")
def single_row_serving(spark, d):
    parts = [F.abs(F.col("embedding")[k]) for k in range(10)]
    scores = table(spark, d, "embeddings").select("vec_id", D.score_matrix(parts).alias("scores"))
    return rounded(D.serve(scores, "vec_id", 7, [f"l{k}" for k in range(10)], threshold=0.1))


# --- the warehouse ---------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT CAST(event_id AS VARCHAR) AS feedback_id, CASE WHEN event_id % 9 <> 0 THEN CAST(user_id AS VARCHAR) END AS session_id, CAST(event_id % 3 AS INTEGER) - 1 AS v, event_type AS source_type FROM events)
SELECT 'feedback_value' AS "check", count(*) FILTER (v NOT IN (-1, 1)) AS violations FROM f UNION ALL SELECT 'source_type', count(*) FILTER (source_type NOT IN ('recommendation_list', 'recommendation_item', 'classifier')) FROM f
UNION ALL SELECT 'session_id not null', count(*) FILTER (session_id IS NULL) FROM f UNION ALL SELECT 'source_type length', count(*) FILTER (length(source_type) > 30) FROM f""")
def warehouse_checks(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.col("event_id").cast("string").alias("feedback_id"), F.when(F.col("event_id") % 9 != 0, F.col("user_id").cast("string")).alias("session_id"), F.col("ts").alias("created_at"), F.lit("s").alias("source_event_id"),
        F.col("event_type").alias("source_type"), F.lit(None).cast("string").alias("target_recording_group_id"), (F.col("event_id") % 3 - 1).cast("int").alias("feedback_value"), F.lit(None).cast("string").alias("reason_code"),
    )
    return warehouse.violations("feedback_events", rows).where(F.col("check").isin("feedback_value", "source_type", "session_id not null", "source_type length"))
