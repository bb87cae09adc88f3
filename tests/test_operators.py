import math
import random
import shutil
from decimal import Decimal
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismcat.functions import features as X, text as S, vectors as V
from prismcat.operators import identity as I, metrics as M, quality as Q, recommend as R, search as C, splits as P, stats as A
from prismcat.operators.quality import ContractError
from prismcat.plans.catalog import QUERIES
from prismcat.plans.prepare import PrepareRules, prepare
from prismcat.sources import io, warehouse


# --- text


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_indel_ratio_is_the_table_version():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        expected = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100
        assert S.indel_ratio(a, b) == pytest.approx(expected)


def test_token_set_ratio():
    assert S.token_set_ratio("thunder imagine", "thunder imagine dragons") == 100
    assert S.token_set_ratio("", "x") == 0
    assert S.token_set_ratio("abc", "xyz") == 0
    assert 45 < S.token_set_ratio("stressed out", "stressed up") < 100


def test_normal_forms(spark):
    df = spark.createDataFrame([("  Song \t A  ",), ("ＣＡＦÉ Straße",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(S.normalize_text(F.col("t"))).collect()] == ["song a", "café strasse", None, ""]
    assert [r[0] for r in df.select(S.title_key(F.col("t"))).collect()][2:] == ["", ""]


def test_title_key_and_split(spark):
    df = spark.createDataFrame([("Don't -- Stop!", "a; b;;a ; ")], "t string, m string")
    row = df.select(S.title_key(F.col("t")), S.split_values(F.col("m"))).first()
    assert tuple(row) == ("don t stop", ["a", "b"])


def test_display(spark):
    row = spark.createDataFrame([(119.96, 61500, 1234567)], "b double, ms long, n long").select(
        S.format_bpm(F.col("b")), S.format_duration(F.col("ms")), S.format_thousands(F.col("n")), S.format_bpm(F.lit(None).cast("double")))
    assert tuple(row.first()) == ("120.0 BPM", "1:02", "1.234.567", "")


# --- contracts


def test_ranges_and_nulls(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, None), (3, 50, "z")], "id int, x int, m string")
    found = Q.range_violations(df, "id", {"x": Q.Range(0, 10), "m": Q.Range(allowed=("a", "b"))}).collect()
    assert sorted((r["column"], r["key"]) for r in found) == [("m", 2), ("m", 3), ("x", 3)]
    with pytest.raises(Q.ContractError):
        Q.require_columns(df, ["id", "missing"])


def test_constant_pattern(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, None), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(X.constant_pattern(df, {"a": 0, "b": 0, "c": 7})).collect()] == [True, False, False]
    assert df.select(X.constant_pattern(df, {"c": 7})).first()[0] is True


def test_duplicates_count_nulls_as_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert tuple(Q.duplicate_profile(df, ["a"]).first()) == (3, 1, 2, 1)


def test_null_checks_pass(spark):
    df = spark.createDataFrame([(None,), (5,), (-1,)], "x int")
    assert [tuple(r) for r in Q.constraint_checks(df, {"positive": F.col("x") > 0}).collect()] == [("positive", 1)]


# --- identity


def test_first_non_null_per_column(spark):
    df = spark.createDataFrame([("k", 1, None, "p"), ("k", 2, 2.0, "q")], "k string, o int, x double, y string")
    assert tuple(I.resolve_entities(df, "k", ["x", "y"], [F.col("o")]).first()) == ("k", 2.0, "p")


def test_representative_takes_the_smallest_key_on_ties(spark):
    df = spark.createDataFrame([("g", "t2", 5.0), ("g", "t1", 5.0), ("g", "t0", 1.0)], "g string, id string, s double")
    row = I.representatives(df, "g", "s", "id", ["s"]).first()
    assert (row["representative_id"], row["members"]) == ("t1", 3)


def test_fingerprint_groups_equal_rows(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 0.0, None), (3, 0.0, "null")], "i int, x double, y string")
    ids = [r["group_id"] for r in I.with_group_id(df, ["x", "y"]).orderBy("i").collect()]
    assert ids[0] == ids[1] != ids[2]


def test_block_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["One!", "one", "two"]), rng.uniform(0, 100)) for k in range(120)]
    got = {(r["a"], r["b"]) for r in I.block_pairs(spark.createDataFrame(rows, "id int, t string, x double"), "id", "t", "x", 7.0).collect()}
    key = lambda t: t.strip("!").lower()
    assert got == {(a[0], b[0]) for a, b in combinations(rows, 2) if key(a[1]) == key(b[1]) and abs(a[2] - b[2]) <= 7.0}


def test_knn_blocks_do_not_change_the_result(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)], "id long, v array<double>")
    one = {tuple(r)[:2] + (r["rank"],) for r in V.knn_self_join(df, "id", "v", 4).collect()}
    many = {tuple(r)[:2] + (r["rank"],) for r in V.knn_self_join(df, "id", "v", 4, block=13).collect()}
    assert one == many and len(one) == 240


def test_union_prefers_textual(spark):
    text = spark.createDataFrame([(2, 1, 80.0)], "a int, b int, score double")
    vector = spark.createDataFrame([(1, 2, 0.99), (1, 3, 0.98)], "a int, b int, score double")
    assert sorted(tuple(r) for r in I.union_pairs(text, vector).collect()) == [(1, 2, "textual", 80.0), (1, 3, "vector", 0.98)]


# --- statistics


BRIDGE = [("g0", "rock"), ("g1", "rock"), ("g1", "pop"), ("g2", "pop"), ("g3", "rock"), ("g3", "pop"), ("g3", "jazz")]


def test_cooccurrence_by_hand(spark):
    links = spark.createDataFrame(BRIDGE, "e string, l string")
    got = {(r["a"], r["b"]): r["shared"] for r in A.cooccurrence(links, "e", "l").collect()}
    assert got == {("rock", "rock"): 3, ("pop", "pop"): 3, ("jazz", "jazz"): 1, ("pop", "rock"): 2, ("jazz", "rock"): 1, ("jazz", "pop"): 1}
    full = {(r["a"], r["b"]) for r in A.overlap_pairs(links, "e", "l").where("full").collect()}
    assert full == {("jazz", "pop"), ("jazz", "rock")}
    stats = {r["statistic"]: r["value"] for r in A.multi_label_stats(links, "e", "l").collect()}
    assert stats == {"total": 4, "single": 2, "multi": 2, "most": 3, "mean": 1.75}


def test_duration_shares_and_cut(spark):
    df = spark.createDataFrame([(200000,), (30000,), (900000,), (250000,)], "d long")
    got = {r["category"]: r["rows"] for r in A.shares(df, {"short": F.col("d") < 60000, "long": F.col("d") > 600000}, "normal").collect()}
    assert got == {"normal": 2, "short": 1, "long": 1}
    assert {tuple(r) for r in A.cut(df, "d", [0, 200000, 10**9], ["a", "b"]).collect()} == {("a", 2), ("b", 2)}


# --- ranking


def catalog(spark):
    energy = [0.500, 0.501, 0.520, 0.600, 0.520, 0.900, 0.560, 0.700]
    rows = [(f"g{k:02d}", f"Song {k}", f"Artist {k % 3}", "Album", [f"genre{k % 2}"], 120000 + 60000 * k, 20.0 + k, k % 2 == 1, k == 7, [0.5, e, *[0.5] * 7]) for k, e in enumerate(energy)]
    return spark.createDataFrame(rows, "id string, name string, artists string, album string, genres array<string>, duration_ms long, popularity double, explicit boolean, incomplete boolean, f array<double>")


def test_golden_orders(spark):
    items = catalog(spark)
    assert [r["id"] for r in R.similar_items(items, "g00", 3).collect()] == ["g01", "g02", "g04"]
    assert [r["id"] for r in R.affinity_items(items, "g00", 3).collect()] == ["g02", "g04", "g06"]
    assert [r["id"] for r in R.affinity_items(items, "g00", 4).collect()] == ["g02", "g04", "g06", "g01"]


def test_filters_and_same_work(spark):
    items = catalog(spark)
    ids = {r["id"] for r in R.similar_items(items, "g00", 9, filters=R.Filters(explicit="explicit", duration_max=400, different_artist=True)).collect()}
    assert ids == {"g01"}
    twin = items.where("id = 'g00'").withColumn("id", F.lit("g00b")).withColumn("name", F.lit(" song 0 "))
    assert "g00b" not in {r["id"] for r in R.similar_items(items.unionByName(twin), "g00", 9).collect()}
    with pytest.raises(ValueError):
        R.Filters(explicit="maybe")


def test_weighted_distance(spark):
    df = spark.createDataFrame([([1.0, 100.0],)], "v array<double>")
    assert df.select(V.weighted_distance(F.col("v"), [0, 0], [0, 1])).first()[0] == 100
    assert spark.createDataFrame([([3.0],)], "v array<double>").select(V.weighted_distance(F.col("v"), [1], [2])).first()[0] == 2
    with pytest.raises(ValueError):
        V.weighted_distance(F.col("v"), [0, 0], [0, 0])


def test_mmr_is_a_permutation_that_keeps_the_head(spark):
    near = [math.cos(0.05), math.sin(0.05)]
    items = spark.createDataFrame([([(0, 1.0, [1.0, 0.0]), (1, 0.99, near), (2, 0.95, [0.1, 1.0])],)], "items array<struct<id:long,relevance:double,v:array<double>>>")
    order = items.select(R.mmr_order(F.col("items"), 3)).first()[0]
    assert order[:2] == [0, 2] and sorted(order) == [0, 1, 2]


def test_pool_sizes():
    assert R.pool_sizes(10, 83735) == [100, 500, 2000, 83735]
    assert R.pool_sizes(100, 600) == [600]
    assert R.pool_sizes(60, 5000) == [600, 2000, 5000]


def test_profiles_are_checked():
    for weights in ((0.0,), (-1.0,), (4.0,)):
        with pytest.raises(ValueError):
            R.Profile("p", (1.0,), weights)


def test_ood(spark):
    row = spark.range(1).select(*[R.ood_status(F.lit(x), F.lit(2.0), F.lit(3.0)) for x in (2.0, 2.5, 3.0, 3.5)]).first()
    assert tuple(row) == ("ok", "warning", "warning", "weak_match")


def test_search(spark):
    rows = [(1, "Thunder", "Imagine Dragons", "Evolve"), (2, "Believer", "Imagine Dragons", "Evolve"), (3, "Stressed Out", "Twenty One Pilots", "Blurryface"), (4, "Imagine", "John Lennon", "Imagine")]
    items = spark.createDataFrame(rows, "id int, name string, artists string, album string")
    found = C.search(items, "imagine dragons").collect()
    assert [r["boosted"] for r in found][:2] == [True, True]
    assert C.search(items, "stressed out").first()["id"] == 3
    assert C.search(items, "   ").count() == 0
    with pytest.raises(KeyError):
        C.resolve(items, "id", 99)


# --- splits and metrics


def test_splits_keep_groups_whole(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 300).alias("g"))
    tagged = df.withColumn("split", P.split_of(F.col("g"), 1))
    assert P.leaks(tagged, "g").count() == 0
    sizes = {r["split"]: r["count"] for r in tagged.groupBy("split").count().collect()}
    assert set(sizes) == {"train", "validation", "test"} and sizes["train"] > 1000


def long(spark, truth, score):
    return spark.createDataFrame([(i, j, int(t), float(s)) for i, (ts, ss) in enumerate(zip(truth, score)) for j, (t, s) in enumerate(zip(ts, ss))], "row int, label int, truth int, score double")


def test_samples_f1(spark):
    truth = [[1, 0, 1], [0, 1, 0]]
    assert M.samples_f1(long(spark, truth, truth), 0.5).first()[0] == 1.0
    assert M.samples_f1(long(spark, [[0, 0]], [[0, 0]]), 0.5).first()[0] == 0.0
    assert len(M.GRID) == 17 and M.GRID[0] == 0.1 and M.GRID[-1] == 0.9


def test_hits(spark):
    df = long(spark, [[1, 0, 1], [0, 1, 0]], [[0.2, 0.1, 0.9], [0.1, 0.9, 0.2]])
    got = {r["k"]: (r["hit"], r["recall"]) for r in M.hit_and_recall(df).collect()}
    assert got[1][0] == 1 and got[3] == (1, 1) and got[5][1] == 1


def test_undefined_metrics_are_null(spark):
    df = long(spark, [[1, 0], [0, 0]], [[0.9, 0.1], [0.5, 0.5]])
    assert tuple(M.coverage_and_lrap(df).first()) == (None, None)
    ap = {r["label"]: r["ap"] for r in M.average_precision(df).collect()}
    assert ap == {0: 1.0, 1: None}


def test_best_threshold_takes_the_first(spark):
    curve = spark.createDataFrame([(0.1, 0.5), (0.15, 0.7), (0.2, 0.7)], "threshold double, samples_f1 double")
    assert M.best_threshold(curve) == 0.15


# --- preparation and sources


def test_prepare(spark):
    rows = [("t1", "A;B", "al", "One", 10, 1, 200000, "pop", 0.0), ("t1", "A;B", "al", "One", 80, 2, 200000, "dance", 0.0), ("t2", "C", "al", "Two", 5, 3, 45000, "rock", 1.0), ("t3", None, "al", "Three", 5, 4, 700000, "jazz", 1.0)]
    raw = spark.createDataFrame(rows, "track_id string, artists string, album_name string, track_name string, popularity long, ordinal long, duration_ms long, track_genre string, tempo double")
    out = prepare(raw, PrepareRules(incomplete={"tempo": 0}))
    tracks = {r["track_id"]: r for r in out["tracks"].collect()}
    assert set(tracks) == {"t1", "t2"} and out["invalid_identity"].count() == 1
    assert (tracks["t1"]["popularity_min"], tracks["t1"]["popularity_max"], tracks["t1"]["observations"]) == (10, 80, 2)
    assert tracks["t2"]["is_short_track"] and tracks["t1"]["audio_analysis_incomplete"]
    assert out["track_genres"].count() == 3 and out["track_artists"].count() == 3
    assert {r["genre_count"] for r in out["recordings"].collect()} == {1, 2}


def test_sources(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("id,name\n1,a\n2,\n")
    df = io.read_csv(spark, str(tmp_path / "raw.csv"))
    assert df.count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(Q.ContractError):
        io.read_csv(spark, str(tmp_path))
    io.write_parquet(df, str(tmp_path / "a.parquet"))
    assert io.read_bundle(spark, str(tmp_path), ["a"])["a"].count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_bundle(spark, str(tmp_path), ["a", "b"])
    io.write_json({"b": 1, "a": 2}, str(tmp_path / "x" / "m.json"))
    assert len(io.file_hash(str(tmp_path / "x" / "m.json"))) == 64
    (tmp_path / "20240101_m").mkdir()
    (tmp_path / "20250101_m").mkdir()
    assert io.newest(str(tmp_path), "m").name == "20250101_m"
    assert io.table_hash(df).first() == io.table_hash(df.orderBy(F.desc("id"))).first()


def test_warehouse_rules(spark, tmp_path):
    assert sum(len(t) for t in warehouse.TABLES.values()) == 47
    results = spark.createDataFrame([("e1", 0, "g", "t", None, None, None), ("e1", 1, "g", None, Decimal("1.5"), Decimal("-1"), None)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in warehouse.TABLES["recommendation_results"].fields))
    broken = {r["check"]: r["violations"] for r in warehouse.violations("recommendation_results", results).collect() if r["violations"]}
    assert broken == {"result_position": 1, "similarity_score": 1, "distance_score": 1, "recommended_track_id not null": 1}
    events = spark.createDataFrame([], warehouse.TABLES["recommendation_events"])
    assert warehouse.broken_references({"recommendation_results": results, "recommendation_events": events})["recommendation_results.event_id"] == 2
    assert warehouse.repeated_keys("recommendation_results", results.unionByName(results)).count() == 2
    sessions = spark.createDataFrame([("s1",), ("s2",)], "session_id string")
    events = spark.createDataFrame([("e1", "s1"), ("e2", "s2")], "event_id string, session_id string")
    left = warehouse.delete_cascade({"app_sessions": sessions, "recommendation_events": events, "recommendation_results": results}, "app_sessions", sessions.where("session_id = 's1'"))
    assert {t: df.count() for t, df in left.items()} == {"app_sessions": 1, "recommendation_events": 1, "recommendation_results": 0}
    seen = warehouse.introspect(spark)
    assert [r[0] for r in seen["tables"].collect()] == sorted(warehouse.COLUMNS) and seen["columns"].count() == 47
    assert seen["keys"].where("kind = 'foreign'").count() == 5 and seen["checks"].count() == 13 and seen["indexes"].select("table_name", "index_name").distinct().count() == 11


def test_warehouse_tables_in_a_database(spark):
    assert set(warehouse.missing_columns(spark, "default")) >= set(warehouse.COLUMNS)
    try:
        warehouse.create_tables(spark, "prismcat_test")
        assert warehouse.missing_columns(spark, "prismcat_test") == []
    finally:
        spark.sql("drop database if exists prismcat_test cascade")


def test_built_index(spark, data, tmp_path):
    from prismcat.operators import index as N
    from prismcat.plans.catalog import item_catalog

    path, items = str(tmp_path / "index"), item_catalog(spark, data("sf0.001"))
    with pytest.raises(FileNotFoundError, match="items, statistics, manifest"):
        N.load_index(spark, path)
    N.build_index(items, path, reference=True)
    index = N.load_index(spark, path)
    ids = [r["id"] for r in index.items.collect()]
    assert ids == sorted(ids) and len(ids) == index.manifest["rows"] == items.where("not incomplete").count()
    assert index.statistics.first()["p95"] < index.statistics.first()["p99"]
    with pytest.raises(KeyError):
        N.similar_in(index, -5)
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,0)]" in index.items.where("id = 0")._jdf.queryExecution().toString()
    index.items.limit(3).write.mode("overwrite").parquet(path + "2/items")
    for part in ("statistics", "manifest"):
        shutil.copytree(f"{path}/{part}", f"{path}2/{part}")
    with pytest.raises(ValueError):
        N.load_index(spark, path + "2")


def test_smallest_is_exact(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), P.hash_number(F.col("id"), F.lit(1)).alias("h"))
    for share in (0.0, 0.15, 0.5, 1.0):
        got = P.smallest(rows, ["g"], "h", "id", F.lit(share)).where("taken").collect()
        for g in (0, 1):
            own = sorted((r["h"], r["id"]) for r in rows.where(F.col("g") == g).collect())
            assert sorted((r["h"], r["id"]) for r in got if r["g"] == g) == own[: math.ceil(round(share * len(own), 9))]


def test_split_carves_test_first(spark):
    sizes = {r["split"]: r["count"] for r in P.split_candidates(spark.range(1, 1001), "id", candidates=1).groupBy("split").count().collect()}
    assert sizes == {"test": 150, "validation": 150, "train": 700}


def test_datasets(spark):
    from prismcat.operators import datasets as D

    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)], "id long, a double, b double")
    links = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "y")], "id long, label string")
    assert sorted(tuple(map(str, r)) for r in D.multilabel_dataset(rows, links, ["a", "b"]).collect()) == [("1", "[1.0, 2.0]", "[1, 1]"), ("2", "[3.0, 4.0]", "[0, 1]")]
    assert [r["label"] for r in D.multiclass_dataset(rows, links, ["a"]).collect()] == ["y"]
    good = D.multilabel_dataset(rows, links, ["a", "b"])
    D.check_dataset(good)
    for bad in (good.unionByName(good), good.withColumn("y", F.when(F.col("id") == 1, F.array(F.lit(1).cast("tinyint"))).otherwise(F.col("y"))), good.withColumn("x", F.array(F.lit(None).cast("double")))):
        with pytest.raises(ContractError):
            D.check_dataset(bad)
    with pytest.raises(ValueError):
        D.apply_policy(rows, "C", F.lit(False), ["a"], F.lit(True))
    one = rows.select(D.score_matrix([F.col("a"), D.last_of(F.array("a", "b")), D.last_of(F.array("a"))]).alias("s")).first()
    assert one["s"] == [1.0, 2.0, 0.0]
    scores = spark.createDataFrame([(1, [0.2, 0.9, 0.2])], "id long, scores array<double>")
    assert [tuple(r) for r in D.serve(scores, "id", 1, ["p", "q", "r"], k=2, threshold=0.5).collect()] == [(1, "q", 0.9, True), (2, "p", 0.2, False)]
    assert D.serve(scores, "id", 9, ["p", "q", "r"]).count() == 0


def test_configuration(spark, tmp_path):
    text = "# a comment\nversion: 'v1'\nweight_scale:\n  min: 0\n  max: 3\npresets:\n  calm:\n    label: \"Calm\"\n    values:\n      energy: 0.5\n      tempo: 90\n    weights:\n      energy: 1\n      tempo: 3\nfilters:\n  explicit: non_explicit\n  genres:\n  - a\n  - b\nmodels:\n  M1: \n    c: 1.5\n    on: true\n  M2: [1, x]\n"
    path = tmp_path / "c.yaml"
    path.write_text(text)
    assert io._plain_yaml(text)["models"] == {"M1": {"c": 1.5, "on": True}, "M2": [1, "x"]}
    assert io.read_presets(str(path), ["energy", "tempo"]) == [R.Profile("calm", (0.5, 90.0), (1.0, 3.0))]
    assert io.read_model_parameters(str(path), "M1")["c"] == 1.5
    with pytest.raises(KeyError):
        io.read_model_parameters(str(path), "M9")
    with pytest.raises(ContractError):
        io.read_presets(str(path), ["energy"])
    assert R.Filters.from_config(io.settings(str(path))["filters"]) == R.Filters(explicit="non_explicit", genres=("a", "b"))
    with pytest.raises(ValueError):
        R.Filters.from_config({"colour": 1})
    (tmp_path / "raw.csv").write_text("id,x\n1,a\n")
    (tmp_path / "d.json").write_text('{"dataset_path": "%s"}' % (tmp_path / "raw.csv"))
    assert io.read_configured(spark, str(tmp_path / "d.json")).count() == 1
    with pytest.raises(FileNotFoundError):
        io.read_configured(spark, str(tmp_path / "d.json"), str(tmp_path / "none.csv"))
    assert len(R.PRESETS) == 7 and R.preset("fiesta").weights[1] == 3
    with pytest.raises(KeyError):
        R.preset("none")


def test_sinks_keep_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(5)
    io.write_parquet(df, str(tmp_path / "p"), order_by=["k"])
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "p").glob("*.parquet"))
    assert files and [v for f in files for v in pq.read_table(f)["k"].to_pylist()] == list(range(1000))
    io.write_csv(df, str(tmp_path / "c"), order_by=["k"])
    assert "".join(f.read_text() for f in sorted((tmp_path / "c").glob("*.csv"))).count("\n") >= 1000
    for name, (e, m) in {"b": ("x", "2"), "a": ("x", "1"), "c": ("a", "9")}.items():
        io.write_json({"experiment": e, "model_id": m}, str(tmp_path / "m" / f"{name}.json"))
    assert [r["model_id"] for r in io.read_manifests(spark, str(tmp_path / "m" / "*.json")).collect()] == ["9", "1", "2"]
    assert io.size_on_disk(spark, str(tmp_path / "m")) >= 3 * 30


def test_experiment_rules():
    import re

    from prismcat.operators import models as L

    with pytest.raises(ValueError):
        L.multilabel(None, None, [], [], "xgboost")
    with pytest.raises(ValueError):
        L.multiclass(None, None, [], "y", "xgboost")
    with pytest.raises(PermissionError):
        L.final_test(False, lambda: None)
    assert L.final_test(True, lambda: 5) == 5 and L.timed(lambda: None) >= 0
    assert re.fullmatch(r"\d{8}-\d{4}_m", L.experiment_manifest("m", "k", ["a"], {}, {})["id"])


def test_knn_join_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for metric in ("cosine", "euclidean"):
        got = {(r["a"], r["rank"]): r["b"] for r in V.knn_join(df.where("id % 9 = 0"), df, "id", "v", 4, block=20, metric=metric).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(0, 90, 9):
            s = u @ u[i] if metric == "cosine" else -np.linalg.norm(x - x[i], axis=1)
            s[i] = -np.inf
            assert [got[i, r] for r in range(1, 5)] == np.argsort(-s, kind="stable")[:4].tolist()
        assert len(got) == 40


def test_streams(spark, data, tmp_path):
    from prismcat.streaming.sessions import sessions, windowed_counts

    events = spark.read.parquet(f"{data('sf0.001')}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    streamed = {tuple(r)[:3] for r in spark.table("counts").collect()}
    assert streamed == {tuple(r)[:3] for r in windowed_counts(events).collect()} and streamed
    assert sessions(events).agg(F.sum("events")).first()[0] == events.where("user_id is not null").count()


def test_block_links_equal_pairs(spark):
    rng = random.Random(8)
    # copies, gaps of exactly the tolerance that rounding puts on either side, values below zero, a hot block, distant runs
    rows = [(k, rng.choice(["a b", "A, b", "c", "", None]), rng.choice([rng.randrange(-900, 1600) / 10 * 2, 1010.1, 1030.1, 990.1, 1e-10, -20.0, 20.0, 0.1 * 3, 20.3, None])) for k in range(700)]
    rows += [(9000, "c", 5000.0), (9001, "c", 5020.0), (9002, "c", 5040.0), (9003, "c", 5060.5)]
    odd = [(9100, "c", math.inf), (9101, "c", math.inf), (9102, "c", math.nan), (9103, "c", math.nan), (9104, "c", -math.inf)]
    df = spark.createDataFrame(rows, "k long, t string, x double")
    found = I.block_links(df.unionByName(spark.createDataFrame(odd, df.schema)), "k", "t", "x", 20.0)
    pairs = [(r["a"], r["b"]) for r in I.block_pairs(df, "k", "t", "x", 20.0).collect()]
    parent, links = {k: k for k, *_ in rows}, {k: 0 for k, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    expected = {(k, links[k], root(k)) for k, t, x in rows if t and x is not None}
    expected |= {(k, 0, k) for k, *_ in odd}
    got = found.collect()
    assert {(r["id"], r["n_links"], r["component_id"]) for r in got} == expected and len(got) == len(expected)


def test_text_blocks_of_many_copies_make_a_row_each(spark, tmp_path, data):
    spark.read.parquet(f"{data('sf0.001')}/part.parquet").crossJoin(spark.range(200).toDF("i")).withColumn("p_partkey", F.col("p_partkey") + 1_000_000 * F.col("i")).drop("i").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["near_dup_text_block"](spark, str(tmp_path))
    total = df.agg(F.count("*").alias("n"), F.min("n_links").alias("least"), F.countDistinct("component_id").alias("groups")).first()
    assert total["n"] == 200 * spark.read.parquet(f"{data('sf0.001')}/part.parquet").count() and total["least"] >= 199


def test_best_split_has_a_small_plan(spark):
    links = spark.range(400).selectExpr("id as g", "cast(id % 7 as int) as l").unionByName(spark.createDataFrame([(None, 3), (1, None)], "g long, l int"))
    best = P.best_split(links, "g", "l", candidates=5)
    exchanges, inside = 0, None
    for line in best._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is None or depth <= inside:  # not within a cached table
            inside = depth if "InMemoryRelation" in line else None
            exchanges += "Exchange " in line
    assert exchanges < 60  # 137 when each candidate's splits were planned again wherever they are read
    rows = {r["g"]: r["split"] for r in best.collect()}
    assert len(rows) == 401 and rows[None] == "train"
    assert sorted(list(rows.values()).count(s) for s in ("train", "validation", "test")) == [60, 61, 280]
    assert P.best_split(links.limit(0), "g", "l").count() == 0
