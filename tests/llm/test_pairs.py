"""Operators on pairs against brute force: embeddings, n-gram Jaccard, components."""

import itertools
import math
import random
import re
import tracemalloc
import weakref

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from prismcat.llm import common, embedding_dedup as E, ngram_join as N
from prismcat.llm.components import connected_components
from prismcat.llm.queries import ORACLES, QUERIES


class Sets:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", ["op1_embedding_dedup", "op5_ngram_jaccard"])
def test_query_equals_its_sql(name, data, against_duckdb):
    against_duckdb(QUERIES[name], ORACLES[name], data("sf0.001"))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(6000, 6200)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: sets.root(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "u long, v long")).count() == 0


@pytest.mark.parametrize(("hubs", "hub"), [(10_000, 64), (10_000, 3), (20, 3), (1, 1)])
def test_components_with_hubs(spark, hubs, hub):
    """Hubs above, below and between their neighbours, hubs on a path, and a double edge each."""
    edges = [(3000, k) for k in range(2800, 3200) if k != 3000] + [(9000, k) for k in range(8700, 9000)] + [(10, k) for k in range(11, 200, 2)]
    edges += [(199, 2800)] + [(20_000 + k, 20_000 + k // 5) for k in range(1, 300)]
    edges += [(b, a) for a, b in edges[::3]]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r["id"]: r["component"] for r in connected_components(frame, hubs=hubs, hub=hub).collect()}
    assert got == {x: sets.root(x) for x in {y for e in edges for y in e}}



def brute_embeddings(rows):
    sets, links = Sets(), dict.fromkeys((i for i, *_ in rows), 0)
    for i, *_ in rows:
        sets.root(i)

    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for (i, v, a), (j, w, b) in itertools.combinations(rows, 2):
        if a is not None and a == b and fine(v) and fine(w) and len(v) == len(w):
            x, y = np.float64(v), np.float64(w)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                sets.join(i, j)
    return {i: (links[i], sets.root(i), sets.root(i) == i) for i, *_ in rows}


@pytest.mark.parametrize("chunk,cell", [(2000, 2000), (7, 20)])
def test_embeddings_equal_brute_force(spark, chunk, cell):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(220):
        v = centres[rng.integers(12)] + rng.normal(size=6) * rng.choice([0.02, 0.15, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(300 + k, rows[3][1], rows[3][2]) for k in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 6, 1), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (403, [math.nan] + [1.0] * 5, 1), (404, [math.inf] + [1.0] * 5, 1), (405, [], 1), (406, rows[3][1], None), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.dedup_embeddings(df, chunk=chunk, cell=cell).collect()}
    assert got == brute_embeddings(rows)


def test_centres_of_wide_vectors_stay_small():
    """768 dimensions and 1,024 centres: no array of centres by centres by dimensions."""
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 768))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    centres = E.spherical_kmeans(x, 1024, rounds=1)
    apart = E.distances(centres)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    some = rng.integers(0, 1024, (50, 2))
    assert np.allclose(apart[some[:, 0], some[:, 1]], np.linalg.norm(centres[some[:, 0]] - centres[some[:, 1]], axis=1), atol=1e-7)


def test_embeddings_without_rows_or_ids(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.dedup_embeddings(empty).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in E.dedup_embeddings(odd).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (5, 1, 5, True), (5, 1, 5, True)], key=str)


def brute_jaccard(rows, words, num, den):
    sets, shingles = Sets(), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or ""))
        s = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
        shingles.setdefault(i, []).append(s)
        sets.root(i)
    flat = [(i, s) for i, many in shingles.items() for s in many if s]
    for (i, a), (j, b) in itertools.combinations(flat, 2):
        if i != j and len(a & b) * den >= len(a | b) * num:
            sets.join(i, j)
    return sorted((i, len(s), sets.root(i)) for i, many in shingles.items() for s in many)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "x's", "ÉÉ"]
    passage = [rng.choice(words) for _ in range(30)]
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.6:
            w = list(rng.choice(made))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.randint(0, 1)] = [f"new{rng.randrange(9999)}"] * rng.randint(0, 1)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 40, 150]))]
            if rng.random() < 0.3:
                w += passage
        made.append(w)
        rows.append((i, "".join((x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice([" ", "\n", "\t ", "  ", "\x0b"]) for x in w)))
    return rows


@pytest.mark.parametrize("words,share,task,few", [(3, (9, 10), N.TASK, 64), (5, (8, 10), N.TASK, 3), (3, (8, 10), 400, 64), (3, (1, 1), 400, 2)])
def test_jaccard_equals_brute_force(spark, words, share, task, few):
    rows = texts(words, 260) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a\x85b a\u2003b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(5)
    got = sorted(tuple(r) for r in N.jaccard_components(df, words=words, share=share, task=task, rows=few).collect())
    assert got == brute_jaccard(rows, words, *share)


@pytest.mark.parametrize("words,share,task", [(3, (9, 10), N.TASK), (5, (8, 10), N.TASK), (3, (8, 10), 400)])
def test_links_equal_brute_force(spark, words, share, task):
    rows = texts(words, 260) + [(900, None), (901, ""), (903, "one"), (904, "ONE"), (5, "one"), (5, "one"), (903, "a b c d e f g"), (None, "one")]
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or ""))
        sets.append(set() if i is None else {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    linked = lambda a, b: bool(a and b) and len(a & b) * share[1] >= len(a | b) * share[0]
    want = sorted((str(i), sum(linked(a, b) for j, b in enumerate(sets) if j != k)) for k, ((i, _), a) in enumerate(zip(rows, sets, strict=True)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = N.jaccard_links(df, words=words, share=share, task=task, pairs=task)
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got.collect()) == want and any(n > 1 for _, n in want)
    parts = N.jaccard_components(df, words=words, share=share, task=task)
    assert sorted(map(str, got.select(*parts.columns).collect())) == sorted(map(str, parts.collect()))


@pytest.mark.parametrize("few", [5, 16])
def test_one_large_group_of_near_copies(spark, few):
    """A group cut into many chunks: copies of one text that drift, so that its ends are linked only through others."""
    rng = random.Random(21)
    words, rows = [f"u{k}" for k in range(120)], []
    for i in range(160):
        if i % 4 == 0:  # the chain drifts on
            k = rng.randrange(len(words))
            words[k : k + 1] = [f"n{i}"] * rng.randint(0, 2)
        own = list(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in N.jaccard_components(df, rows=few).collect())
    assert got == brute_jaccard(rows, 3, 9, 10) and len({c for _, _, c in got}) < 100


def test_jaccard_odd_rows(spark):
    long = " ".join(f"v{k}" for k in range(30))
    rows = [(7, long), (7, long), (3, long), (8, "p q r s"), (8, long), (9, "P q r S"), (None, long)]
    got = sorted((tuple(r) for r in N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 28, 3), (7, 28, 3), (3, 28, 3), (8, 2, 3), (8, 28, 3), (9, 2, 3), (None, 28, None)], key=str)
    assert N.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    rows = texts(11, 120)
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in rows], "doc_id long, text string, source string")
    want = {i for i, n, c in brute_jaccard(rows, 5, 8, 10) if n == 0 or i == c}
    assert {r["doc_id"] for r in N.keep_one(df).collect()} == want
    again = N.keep_one(df.unionByName(df).unionByName(spark.createDataFrame([(None, "a text", "s"), (None, "a text", "s")], df.schema))).collect()
    assert sorted(str(r["doc_id"]) for r in again) == sorted([*map(str, want), "None", "None"])


def test_local_links_with_sides():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10**6, 50, replace=False)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 50 - k], rng.choice(10**6, k).astype(np.uint64) + np.uint64(10**7)])) for k in (0, 1, 2, 3, 9, 30)]
    joined = Sets()
    for i, j in N.local_links(sets, (8, 10)):
        joined.join(i, j)
    want = Sets()
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j])):
            want.join(i, j)
    assert [joined.root(k) for k in range(6)] == [want.root(k) for k in range(6)]


def test_block_is_counted_in_little_memory():
    rng, opener, rows, held = np.random.default_rng(5), zstandard.ZstdDecompressor(), [], []
    for number in range(4):  # two blocks in one task; grams of a block in order, as they come
        for block in (3, 8):
            g, o = np.sort(rng.choice(4_000_000, 400_000, replace=False).astype("<u4")), rng.integers(0, 1001, 400_000).astype("<u2")
            rows.append((block, number, N.GRAMS, [1000], zstandard.ZstdCompressor().compress(g.tobytes() + o.tobytes())))
            held.append((block, number, g, o))
    batch = N._rows(rows)
    tracemalloc.start()
    out = [r for b in N._count(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 400_000 * len(held)
    found = {(r["block"], r["slice"]): np.frombuffer(opener.decompress(r["data"]), "<u4") for r in out}
    for block, number, g, o in held:
        others = np.concatenate([x for b, n, x, _ in held if b == block and n != number])
        assert (found[block, number] == np.bincount(o[np.isin(g, others)], minlength=1001)[:1000]).all()


def test_tasks_give_memory_back_when_their_variables_are_gone(monkeypatch):
    seen = []

    def run(batches):
        large = np.zeros(10)
        seen.append(weakref.ref(large))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: seen.append(seen[0]()))
    assert list(common.freed(run)(iter([1, 2]))) == [1, 2] and seen[1:] == [None]
