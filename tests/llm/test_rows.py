"""Operators on rows: mixing, URL filter, classifiers, fingerprints, page text; and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismcat.llm import fingerprints as P, html_text as H, mixing as M, quality as Q, toxicity as X, url_filter as U
from prismcat.llm.common import worker_cache
from prismcat.llm.queries import ORACLES, QUERIES

# --- mixing


def water_fill(sizes, weights=(5, 2, 1), times=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, closed, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in closed]
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        over = [s for s in open_ if share[s] > times * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(times * sizes[s])
            closed.add(s)
            left -= target[s]


def test_mixing_sql(data, against_duckdb):
    against_duckdb(QUERIES["op4_mix_sources"], ORACLES["op4_mix_sources"], data("sf0.001"))


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_the_fixed_point(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 50, 900]) for s in ["a", "B", "é", "z", "Z", "q1", "q10", "q2", None][: 3 + 2 * seed]}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes))


def test_mixing_rows(spark):
    rows = [(k, "w " * (k % 50), "s%d" % (k % 4), "x") for k in range(2000)] + [(None, "lone words here", None, "x"), (5000, None, None, None), (5001, "", "s0", "x"), (5002, "long " * 300_000, "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = M.mixing_plan(df).collect()
    assert len(plan) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in plan)
    by = {}
    for r in plan:
        t = by.setdefault(r["source"], [0, 0, 0.0])
        t[0], t[1], t[2] = t[0] + r["size"], t[1] + r["taken"], r["target"]
    assert {s: t[2] for s, t in by.items()} == pytest.approx(water_fill({s: t[0] for s, t in by.items()}))
    assert all(t[1] == pytest.approx(t[2], rel=0.15) for s, t in by.items() if s and s != "s1")
    assert {r["size"] for r in plan if r["doc_id"] == 5002} == {300_000}
    assert sorted(map(str, plan)) == sorted(map(str, M.mixing_plan(df.repartition(5)).collect()))
    assert M.mix(df).count() == sum(r["copies"] for r in plan)
    assert M.mixing_plan(df.limit(0)).count() == 0
    assert M.mix(df).columns == ["doc_id", "text", "source"]


# --- URLs


def expected_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rules = ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "x", "http://", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/19", "https://example.org/en/2", "ftp://org/", "http://org", "http://borg/", "http://a.com/fr/", "http://com/de/x", "http://a.com/de", "http://a.net/en/9?p=1&q=2", "a://b://c/d", "http://ex?u=/org/", "http://ÄÖ.com/fr/é", "http://x.org\n/es/", "http://user@h.com:80/de/" + "9" * 5000]


def test_urls_and_rules(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    rows = U.filter_urls(df).collect()
    verdicts = dict(U.RULES and [(r, v) for v, r in U.RULES])
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == expected_url(r["url"]), r["url"]
        assert r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
    assert U.filter_urls(df.limit(0)).count() == 0
    only = U.filter_urls(df.where("url like 'http://a.net%'")).collect()
    assert {r["verdict"] for r in only} == {"allow"}


def test_entropy(spark):
    df = spark.createDataFrame([("aabb",), ("aaaa",), ("abcd",), ("",)], "u string")
    assert [round(r[0], 9) for r in df.select(U.entropy(F.col("u"))).collect()] == [1.0, 0.0, 2.0, 0.0]


def test_trees_learn_the_rules(spark, data):
    """Scores of rule-decided URLs that the trees have not seen agree with the rules far beyond chance."""
    pages = spark.read.parquet(f"{data('sf0.1')}/pages.parquet").select("page_id", "url")
    rows = U.filter_urls(pages, sample=400, score_all=True).where("rule is not null").withColumn("h", F.xxhash64("url")).orderBy("h", "url").collect()
    unseen = [r for r in rows if r["url"] not in {u for u in list(dict.fromkeys(x["url"] for x in rows))[:400]}]
    assert len(unseen) > 300 and {r["verdict"] for r in unseen} == {"allow", "block"}
    right = np.mean([(r["block_score"] >= 0.5) == (r["verdict"] == "block") for r in unseen])
    share = np.mean([r["verdict"] == "block" for r in unseen])
    assert right > max(share, 1 - share) + 0.1
    free = U.filter_urls(pages).where("rule is null").collect()
    assert free and all(0 <= r["block_score"] <= 1 and r["verdict"] == ("block" if r["block_score"] >= 0.5 else "allow") for r in free)


def test_suffix_statistics_leave_the_url_out(spark):
    urls = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 1.0), ("b", 1.0)], "_suffix string, label double")
    stats = urls.groupBy("_suffix").agg(F.sum("label").alias("_b"), F.count("*").alias("_n"))
    rates = sorted(round(r["f_suffix_rate"], 6) for r in U.with_suffix(urls, "suffix", stats, F.col("label")).collect())
    assert rates == [0.5, 0.5, 0.5, 0.75]
    assert {round(r["f_suffix_rate"], 6) for r in U.with_suffix(urls, "suffix", stats).collect()} == {0.6, round(2 / 3, 6)}


@pytest.mark.parametrize("kept,verdict", [("org/", "allow"), ("com/de/", "block")])
def test_labels_of_one_kind(spark, kept, verdict):
    rows = [(f"http://x.org/{k}",) for k in range(5)] + [(f"http://x.com/de/{k}",) for k in range(5)] + [("http://x.net/a",), (None,)]
    got = U.filter_urls(spark.createDataFrame(rows, "url string"), rules=[(verdict, kept)]).where("rule is null").collect()
    assert len(got) == 7 and {r["verdict"] for r in got} == {verdict}


def test_suffixes_are_counted_over_all_labelled_urls(spark):
    ends = [f"{kind}{chr(97 + k // 6)}{chr(97 + k % 6)}" for kind in "ab" for k in range(30)]
    rules = [("block" if e[0] == "b" else "allow", f"host.{e}/x") for e in ends]
    pages = spark.createDataFrame([(f"http://host.{e}/x/{k}",) for e in ends for k in range(10, 50)] + [(f"http://host.{e}/y/10",) for e in ends], "url string")
    free = U.filter_urls(pages, rules=rules, sample=60).where("rule is null").collect()
    assert len(free) == 60 and all(r["verdict"] == ("block" if r["host"][5] == "b" else "allow") for r in free)


def test_no_python_in_native_plans(spark, data):
    for name in ("op4_mix_sources", "op9_url_filter"):
        plan = QUERIES[name](spark, data("sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- classifiers


def held_out(spark, data, query, label, sf="sf0.1"):
    truth = spark.read.parquet(f"{data(sf)}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return QUERIES[query](spark, data(sf)).where("held_out").join(truth, "doc_id").select("predicted", "y", "score").collect()


def test_quality_held_out(spark, data):
    rows = held_out(spark, data, "op8_quality", "quality")
    good, bad = [r for r in rows if r["y"] == 1], [r for r in rows if r["y"] == 0]
    assert sum(r["predicted"] for r in good) >= 0.99 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.85 * len(bad)


def test_toxicity_held_out(spark, data):
    rows = held_out(spark, data, "op6_toxicity", "toxic")
    toxic, clean = [r for r in rows if r["y"] == 1], [r for r in rows if r["y"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("leave", [False, True])
def test_block_max_index_is_exact(leave):
    rng = random.Random(10)
    for k, n in ((1, 300), (5, 1500), (40, 700)):
        vectors = []
        for _ in range(n):
            v = {rng.randrange(rng.choice([9, 90])): rng.random() + 0.1 for _ in range(rng.randint(0, 6))}
            norm = sum(w * w for w in v.values()) ** 0.5
            vectors.append({t: w / norm for t, w in v.items()})
        flat = [(i, t, w) for i, v in enumerate(vectors) for t, w in sorted(v.items())]
        row, term, weight = (np.asarray(x) for x in zip(*flat))
        index = X.BlockMaxIndex(row, term, weight, n, 90)
        assert 0 < len(index.dense) < 90
        few = row < 60
        doc, found, product = index.nearest(row[few], term[few], weight[few], 60, k, np.arange(60) if leave else None)
        for q in range(60):
            sims = {i: sum(w * v.get(t, 0) for t, w in vectors[q].items()) for i, v in enumerate(vectors) if not leave or i != q}
            ranked = sorted((s for s in sims.values() if s > 0), reverse=True)
            least = ranked[min(k, len(ranked)) - 1] if ranked else 1
            own = doc == q
            assert set(found[own].tolist()) == {i for i, s in sims.items() if s > 0 and s >= least - 1e-12}
            assert all(abs(sims[i] - s) < 1e-9 for i, s in zip(found[own].tolist(), product[own]))


def test_toxicity_words():
    assert [w.decode() for w in X.words_of("It's «Über»-cool… x²\u3000終わり。2nd")] == ["it", "s", "über", "cool", "x", "終わり", "nd"]
    assert X.words_of(None) == X.words_of(" 12 ?!") == []
    assert X.terms_of(b"idiots") == [b"idiots", b"^idiot"] and X.terms_of(b"of") == [b"of"]
    assert len(X.terms_of(b"x" * 100_000)) == 100_000 - X.WINDOW + 1


def test_toxicity_equals_brute_force(spark, data):
    """Scores, neighbours and evidence of every document, from all cosines with all labelled examples."""
    import math
    import zlib
    from collections import Counter

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data('sf0.001')}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data('sf0.001')}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    taught = {}
    for i, y in labels.items():
        if docs.get(i) is not None:
            taught.setdefault(docs[i], []).append(y)
    sample = [(t, int(2 * sum(y) >= len(y))) for t, y in taught.items()]
    terms = lambda text: Counter(t for w in X.words_of(text) for t in X.terms_of(w))
    counts, n, toxic = [terms(t) for t, _ in sample], len(sample), sum(y for _, y in sample)
    df, a = Counter(t for c in counts for t in c), Counter(t for c, (_, y) in zip(counts, sample) if y for t in c)

    def factor(t):
        below = df[t] * (n - df[t]) * toxic * (n - toxic)
        chi = n * (a[t] * n - df[t] * toxic) ** 2 / below if below else 0.0
        return (math.log((1 + n) / (1 + df[t])) + 0.05) * (X.FLOOR + min(1.0, chi / X.LEVEL))

    def unit(c):
        v = {t: (1 + math.log(k)) * factor(t) for t, k in c.items() if t in df}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    vectors = [unit(c) for c in counts]

    def vote(v, leave=None):
        sims = sorted(((sum(w * e.get(t, 0.0) for t, w in v.items()), j) for j, e in enumerate(vectors) if j != leave), reverse=True)
        sims = [s for s in sims if s[0] > 1e-15]
        near = [s for s in sims if s[0] >= sims[min(X.NEIGHBOURS, n - 1 if leave is not None else n, len(sims)) - 1][0] - 1e-12]
        return (sum(s**X.POWER * sample[j][1] for s, j in near) / sum(s**X.POWER for s, _ in near) if near else -1.0), near

    at, value = X.isotonic(np.asarray([vote(v, j)[0] for j, v in enumerate(vectors)]), np.asarray([float(y) for _, y in sample]))
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, data("sf0.001")).collect()}
    assert got.keys() == docs.keys()
    silent = 0
    for i, text in docs.items():
        v = unit(terms(text))
        share, near = vote(v)
        if not near:
            silent += 1
            assert got[i]["evidence"] == []
            continue
        assert got[i]["score"] == pytest.approx(float(np.interp(share, at, value)), abs=1e-9)
        assert [e["similarity"] for e in got[i]["evidence"]] == pytest.approx([s for s, _ in near[: X.SHOWN]])
        for e in got[i]["evidence"]:
            known = [t.decode("utf-8", "ignore") for t in v]
            assert 0 < len(e["words"]) <= X.WORDS and set(e["words"]) <= set(known)
    assert silent < 0.05 * len(docs)


def test_isotonic():
    at, value = X.isotonic(np.asarray([0.1, 0.2, 0.3, 0.4, 0.4]), np.asarray([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert at.tolist() == [0.1, 0.2, 0.4] and value.tolist() == [0.0, 0.5, 1.0]


@pytest.mark.parametrize("score,label", [(X.score_toxicity, "toxic"), (Q.score_quality, "quality")])
def test_classifiers_odd_rows(spark, score, label):
    rows = [(k, ("bad worse words " if k % 2 else "fine good things ") * 3 + f"n{k}", 1 - k % 2 if label == "quality" else k % 2) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(100, None, None), (101, "", "x"), (None, "bad words", "x"), (102, "zzz " * 50000, "x"), (1, rows[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (200, 1)], f"doc_id long, {label} int")
    got = score(docs, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    high, low = (2, 1) if label == "quality" else (1, 2)
    assert by[high] > by[low]
    if label == "quality":
        assert by[100] == by[101] == 0 and {r["predicted"] for r in got if r["doc_id"] in (100, 101)} == {0}
    assert score(docs.limit(0), docs, labels).count() == 0
    assert score(docs, docs, labels.limit(0)).count() == docs.count()


def labelled_texts(spark, folder):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    return docs, [(docs[i], y) for i, y in labels if docs.get(i) is not None and zlib.crc32(str(i).encode()) % 5]


def test_quality_equals_brute_force(spark, data):
    """Projection and votes one by one, from the terms of each text and a model's axes."""
    import math

    docs, sample = labelled_texts(spark, data("sf0.001"))
    model = Q.fit(sample)
    name = {i: t for t, i in model.terms.items()}
    assert set(name.values()) == {t for t, n in __import__("collections").Counter(t for x, _ in sample for t in Q.terms_of(x)).items() if n >= 2}  # no cap

    def project(text):
        v = np.zeros(model.axes.shape[1])
        for t, c in Q.terms_of(text).items():
            if t in model.terms:
                v += (1 + math.log(c)) * model.idf[model.terms[t]] * model.axes[model.terms[t]]
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else v

    odd = [None, "", " \n", "x" * 100, "x" * 10_000, "so " + "0aB" * 40, "天地玄黄" * 30, "a a a b"]
    texts = [*docs.values(), *odd]
    got = model.score(texts)
    examples = [project(t) for t, _ in sample]
    for text, score in zip(texts, got, strict=True):
        if not (text or "").split():
            assert score == 0
            continue
        v = project(text)
        sims = [float(v @ e) for e in examples]
        least = sorted(sims, reverse=True)[min(Q.NEIGHBOURS, len(sims)) - 1]
        near = [(max(s, 0.0) ** Q.POWER, y) for s, (_, y) in zip(sims, sample, strict=True) if s >= least - 1e-9]
        want = (sum(w * y for w, y in near) + 1e-3 * model.prior) / (sum(w for w, _ in near) + 1e-3)
        assert score == pytest.approx(want if v.any() else model.prior, abs=1e-6)
    for k, text in enumerate(texts):
        text_of, term, weight = model.counts([text])
        assert {name[t]: w for t, w in zip(term, weight)} == {t: c for t, c in Q.terms_of(text).items() if t in model.terms}, k


def test_quality_axes_span_the_best_space(spark, data):
    """The axes keep almost as much of the TF-IDF matrix as those of an exact SVD."""
    _, sample = labelled_texts(spark, data("sf0.001"))
    model = Q.fit(sample, axes=8)
    row, term, weight = model.counts([t for t, _ in sample])
    dense = np.zeros((len(sample), len(model.terms)))
    dense[row, term] = (1 + np.log(weight)) * model.idf[term]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    best = np.linalg.svd(dense, compute_uv=False)[:8]
    assert np.linalg.norm(dense @ model.axes) >= 0.99 * np.linalg.norm(best)
    assert np.allclose(model.axes.T @ model.axes, np.eye(8), atol=1e-5)


def test_quality_ties_count_all():
    """More equal neighbours than votes: all of them vote, whatever their order."""
    sample = [("one two three", k % 2) for k in range(60)] + [("four five six", 1)] * 60
    texts = ["one two three", "four five six", "one two three four"]
    a, b = Q.fit(sample).score(texts), Q.fit(sample[::-1]).score(texts)
    assert np.allclose(a, b) and a[0] == pytest.approx(0.5, abs=0.01) and a[1] == pytest.approx(1.0, abs=0.01)


@pytest.mark.parametrize("large_first", [True, False])
def test_quality_models_in_turn(spark, large_first):
    """F1 (op8_quality): a process that scores with one model and then another takes no term numbers of the first."""
    texts = [f"alpha{k % 7} beta{k % 5} gamma{k % 3}, delta{k} {'A-1 ' * (k % 4)}{'x' * 41 * (k % 2)}" for k in range(60)]
    large = [(f"{t} " + " ".join(f"word{k}" for k in range(300)), k % 2) for k, t in enumerate(texts)]
    small = [(" ".join(t.split()[2:0:-1]), k % 3 % 2) for k, t in enumerate(texts)]
    models = [Q.fit(sample) for sample in ((large, small) if large_first else (small, large))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    alone = []
    for model in models:
        worker_cache("nothing")
        alone.append(model.score(texts))
    for model, want in [*zip(models, alone, strict=True)] * 2:
        assert np.allclose(model.score(texts), want)
        got = {r["doc_id"]: r["score"] for r in Q.score_with(docs, model, 0.3).collect()}
        assert np.allclose([got[k] for k in range(len(texts))], want)
    docs.unpersist()


def test_quality_reads_texts_without_spaces(spark):
    rng = random.Random(14)
    head = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(300))
    tails = ["".join(rng.choice(letters) for _ in range(300)) for letters in ("辰宿列张寒来暑往", "秋收冬藏闰余成岁") for _ in range(40)]
    rows = [(k, head + t, int(k < 40)) for k, t in enumerate(tails)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in Q.score_quality(docs, docs, labels).where("held_out").collect()}
    assert min(s for i, s in scores.items() if i < 40) > max(s for i, s in scores.items() if i >= 40)


def test_quality_terms_of_long_words():
    code = "function(a,b){return a_1+b}".replace(" ", "") * 3
    for word in (code, "x" * 41, "0aB" * 100, "天" * 50 + "。" + "地" * 60, "=" * 90):
        pieces = Q.pieces_of(word)
        assert set("".join(pieces)) == set(word) and all(len(p) <= Q.WHOLE for p in pieces)
        assert all(Q.terms_of("so " + word)["w " + p.lower()] for p in pieces)
        kind = lambda c: ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        assert "".join(Q.shapes_of(word)) == "".join(kind(c) for i, c in enumerate(word) if not i or kind(c) != kind(word[i - 1]))


# --- fingerprints


def edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        m = len(a) // 3
        yield i, a, a[: len(a) - m] + b[:m], b


def plain_hash(text):
    """The polynomial hash by its definition, code point by code point."""
    parts = []
    for p in P.PRIMES:
        total, power = 0, 1
        for c in text:
            total = (total + (ord(c) + 1) * power) % p
            power = power * P.BASE % p
        parts.append(total)
    return parts[0] << 31 | parts[1]


def dice(a, b):
    x, y = ({t[i : i + P.SPAN] for i in range(max(1, len(t) - P.SPAN + 1))} if t else set() for t in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def test_fingerprints_equal_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data('sf0.001')}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op7_fingerprints"](spark, data("sf0.001")).collect()}
    errors = []
    for i, text, edited, after in edits(rows):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for own, mark in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            n, whole, sketch = mark.split(":")
            assert (int(n), int(whole, 16), len(sketch)) == (len(own), plain_hash(own), 2 * P.BINS)
        for found, other in ((r["near_edited"], edited), (r["near_next"], after)):
            assert 0 <= found <= 1 and (found == 1.0 or text != other)
            errors.append(found - dice(text, other))
        assert r["near_edited"] == pytest.approx(P.fingerprint_likeness(r["fingerprint"], r["edited_fingerprint"]))
    # an estimate from 64 bins: against the true Dice coefficient of the sets of spans
    assert len(got) == len(rows) and np.abs(errors).mean() < 0.05 and np.abs(errors).max() < 0.3 and abs(np.mean(errors)) < 0.02


def test_fingerprints_of_a_very_long_text(spark):
    rng = random.Random(15)
    long = "".join(rng.choice("abcdé 🙂") for _ in range(400_000))
    df = spark.createDataFrame([(2, long), (1, "x" + long[1:]), (0, long)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.fingerprint_documents(df).collect()}
    assert got[2]["fingerprint"] == got[0]["fingerprint"] != got[1]["fingerprint"] and got[2]["near_next"] > 0.9
    assert int(got[1]["fingerprint"].split(":")[1], 16) == plain_hash("x" + long[1:])


def test_fingerprints_odd_rows(spark):
    rows = [(3, "héllo wörld 🙂" * 3), (2, None), (1, ""), (5, "ab"), (5, "ab"), (4, "x" * 40), (None, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = P.fingerprint_documents(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "5", "5", "None"]
    same = [r for r in got if r["doc_id"] == 5]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and 1.0 in {r["near_next"] for r in same}
    alone = P.fingerprint_documents(df.where("doc_id = 3")).first()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == len(rows[0][1])
    assert P.fingerprint_documents(df.limit(0)).count() == 0


def test_prefix_hashes():
    rng = random.Random(11)
    a, b = ("".join(rng.choice("abé🙂") for _ in range(300)) for _ in range(2))
    b = b[:100] + a[50:200] + b[100:]
    x, y = P.PrefixHashes(a), P.PrefixHashes(b)
    for _ in range(300):
        i, j, n = rng.randrange(200), rng.randrange(300), rng.randrange(1, 60)
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.common_extension(i, y, j) == k
    assert x.spans(8)[7] == x.span(7, 15)[0]
    z = P.PrefixHashes(a[:120] + b[:77])
    assert P.joined_hash(x, 120, y, 77) == P.joined_hash(z, z.n, z, 0)


@pytest.mark.parametrize("times", [20, 200, 2000])
def test_likeness_of_repetitive_texts(times):
    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60))
    texts = [passage * times, passage * times + " x", passage[:30] * times]
    sets = [{t[i : i + P.SPAN] for i in range(len(t) - P.SPAN + 1)} for t in texts]
    bins = [P.Document(0, t).bins for t in texts]
    for k in (1, 2):
        dice = 2 * len(sets[0] & sets[k]) / (len(sets[0]) + len(sets[k]))
        assert P.likeness(bins[0], bins[k]) == pytest.approx(dice, abs=0.2)
    # the bins are those of the distinct spans, however often each is there
    assert all((P.sketch(np.unique(P.PrefixHashes(t).spans(P.SPAN))) == b).all() for t, b in zip(texts, bins, strict=True))


# --- pages

PAGES = [
    ("<p>Hello <b>wor</b>ld &amp; &lt;x&gt; a&nbsp;b</p><p>2nd", "Hello world & <x> a b 2nd"),
    ("<article><header><h1>T</h1></header><p>x <a href='#'>link</a> y</p><aside>side</aside><form><input>go</form><div id=comments>c</div></article>", "T x link y"),
    ("<article><p>a < b and c > d</p><script>if(a<b){x='</p>'}</script><p>t</article>", "a < b and c > d t"),
    ("<article>x<!-- c <p>no</p> -->y</article><footer>f", "xy"),
    ("<title>t</title><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><p><b>A<br><p>B</p></article>", "A B"),
    ("<article><table><tr><td>a<td>b</table><pre> x\n  y</pre></article>", "a b x y"),
    ("<body><div class='cookie-notice'>We use cookies</div><div><p>A long paragraph of text without any article around it, which ends well.</p></div></body>", "A long paragraph of text without any article around it, which ends well."),
    ("<head><title>t</title><p>No body, but a text that goes on for a while.", "No body, but a text that goes on for a while."),
    ("<div class='site-header'>Site</div><article><div class='entry-header'><h1>T</h1></div><p>x</p><div class='share-bar'>s</div></article>", "T x"),
    ("<article><p>a</p><section class='reader-comments'><article class='comment'><p>A comment of some length, here.</p></article></section></article>", "a"),
    ("<main><h1>T</h1><p>One.</p><div class='notice'>n</div></main><aside class='sidebar'>s</aside><div role='search'>q</div>", "T One."),
    ("plain text only", "plain text only"),
    ("<article><p>cut <a href=\"", "cut"),
    ("", ""),
    (None, ""),
    ("<<<>>><a <b></", None),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    got = H.main_text(page)
    assert text is None or got == text


UNCLOSED = [
    ("<article><p>a</p><datalist><option value=a><option value=b></datalist><p>b</p></article>", "a b"),
    ("<article><p>a <svg viewBox='0 0 1 1'/> b</p><p>c</p><svg><text>no</text><path d=''/></svg><p>d</p></article>", "a b c d"),
    ("<article><p>a</p><svg><path d='M0'><title/><p>b</p></article>", "a b"),
    ("<article><p>a <svg><title>no</title><g/></svg>, b</p></article>", "a , b"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/><semantics><annotation>x=2</annotation></semantics></math>, yes</p></article>", "so x=2, yes"),
    ("<article><p>a</p><video src=x><p>b</p><audio src=y/><p>c</p><canvas/><p>d</p><iframe src=z/><p>e</p><object data=w><p>f</p></article>", "a b c d e f"),
    ("<article><p>a<video src=x><source src=y>no video</video>b</p><object data=w><p>no</p></object><canvas>no</canvas><iframe><p>no</p></iframe><p>c</p></article>", "ab c"),
    ("<div><select><option>x<option>y</div><article><p>a</p><div><select><option>no</div><p>b</p></article>", "a b"),
    ("<article><p>a<noscript><div>no</div></noscript>b</p><template><p>no</p><template>no</template><p>no</p></template><div><noscript>no</div><p>c</p></article>", "ab c"),
    ("<head><noscript><link rel=x><body><article><p>a</p></article>", "a"),
    ("<head><noscript><style>no</style></noscript><title>no</title></head><body><article><p>a</p></article>", "a"),
]


@pytest.mark.parametrize("page,text", UNCLOSED)
def test_skipped_elements_end(page, text):
    assert H.main_text(page) == text


LONG = "A long paragraph of text, which goes on and on until it has said all that there is to say about a matter of this size, and which then ends well."
WRAPPED = [
    (f"<div class='content has-sidebar'><p>{LONG}</p><p>Short.</p></div>", f"{LONG} Short."),
    (f"<div id='page' class='no-sidebar'><nav>menu</nav><article><p>{LONG}</p></article><div class='sidebar'>side</div></div>", LONG),
    ("<div class='layout with-comments'><article><p>a</p><div class='comments'><p>c</p></div></article></div>", "a"),
    ("<section class='legal'><article><h1>T</h1><p>a</p></article></section>", "T a"),
    ("<div id='search-page'><main><p>a</p></main><footer>f</footer></div>", "a"),
    (f"<section class='legal'><p>{LONG}</p><p>{LONG}</p></section><div class='menu'>m</div>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p></article><div class='comments'><article class='comment'><p>{LONG}</p></article></div>", LONG),
    (f"<article><p>{LONG}</p><div class='ad'>Buy it now, and get another one.</div><p>b</p></article><div class='related'><p>{LONG}</p></div>", f"{LONG} b"),
]


@pytest.mark.parametrize("page,text", WRAPPED)
def test_words_of_a_wrapper_do_not_decide(page, text):
    assert H.main_text(page) == text


INSIDE = [
    ("<article><h2 id='related-work'>Related work</h2><p>x</p></article>", "Related work x"),
    ("<article><section id='legal-history'><p>x</p></section><p class='search-term'>y</p><h2 id='comments-on-the-law'>z</h2></article>", "x y z"),
    ("<article><h2 class='menu'>Menu</h2><section id='comments'><p>On comments.</p></section><p id='ad'>y</p><span class='notice'>z</span></article>", "Menu On comments. y z"),
    ("<article><p>a</p><figure><svg viewBox='0 0 1 1' /></figure><p>rest</p></article>", "a rest"),
    ("<article><p>a</p><aside>s</aside><div>Body text.</div><aside>t</aside><p>b</p></article>", "a Body text. b"),
    ("<article><div class='ad'>x</div><div>One sentence.</div><div class='ad'>y</div></article>", "One sentence."),
    ("<article><nav>n</nav><p>a</p><nav>n</nav><div>b</div><footer>f</footer></article>", "a b"),
    ("<article><div class='reader-comments'><p>c</p></div><div class='cookie-notice'>d</div><ul class='share-buttons'><li>e</ul><div id='sidebar'>f</div><div class='advert'>g</div><div class='commentary'>h</div></article>", "h"),
    ("<title>t<article><p>a</p></article>", "a"),
    ("<article><p>a</p><textarea>no<p>b</p></article>", "a b"),
    ("<article><noscript><p>no</p></article><p class='ad'>x</p>", ""),
]


@pytest.mark.parametrize("page,text", INSIDE)
def test_text_inside_an_article_stays(page, text):
    assert H.main_text(page) == text


DEEP = ["<div>word ", "<p><b>word ", "<h1>word ", "<b>word ", "<li>word ", "<td>word ", "<x>word ", "<a>word</b> ", "<i><p><b>word</i> ", "<svg><g>word ", "<ul><li>word ", "</p>word ", "<video>word ", "<article><aside>word</aside>word "]


@pytest.mark.parametrize("piece", DEEP)
def test_deep_and_unclosed_nesting_is_linear(piece):
    import time
    import tracemalloc

    def took(n):
        began = time.process_time()
        H.main_text("<article>" + piece * n + "</article>")
        return time.process_time() - began

    took(500)
    small, large = min(took(4000) for _ in range(2)), took(40_000)
    assert large < 30 * small + 0.5
    tracemalloc.start()
    H.main_text("<article>" + piece * 10_000)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_a_hundred_thousand_nested_elements():
    assert H.main_text("<article>" + "<div>w " * 100_000) == " ".join("w" * 100_000)


def test_the_classifier_is_fitted():
    """The labels are those of the elements; what is learned decides about blocks that no element names."""
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    # here boilerplate is long and unlinked, and articles are made of short lines
    odd = [f"<footer>{line(60)}.</footer><article>" + "".join(f"<div>{line(2)}</div>" for _ in range(4)) + "</article>" for _ in range(80)]
    usual = [f"<footer>{line(2)}</footer><article><p>{line(60)}.</p></article>" for _ in range(80)]
    block = H.blocks_of(f"<div>{line(60)}.</div>")[0]
    assert np.dot(H.fit_costs(odd), H.features(block)) < 0 < np.dot(H.fit_costs(usual), H.features(block))
    assert (H.fit_costs([]) == H.START).all() and (H.fit_costs(["<p>x", None]) == H.START).all()


def test_pages_equal_their_article(spark, data):
    import html

    rows = spark.read.parquet(f"{data('sf0.01')}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op10_html_text"](spark, data("sf0.01")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]]["text"] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a", "y"), (2, "u", "<article>" + "<p>long text here" * 20000, "z")], "page_id long, url string, html string, text string")
    rows = H.extract_text(df).collect()
    assert [r["text"] for r in rows][:2] == ["", "a"] and rows[2]["n_chars"] == 20000 * 15 - 1
    assert H.extract_text(df.limit(0)).count() == 0


def test_minimum_cut_is_minimal():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = [rng.randrange(6) for _ in range(n)], [rng.randrange(6) for _ in range(n)]
        edges = [(a, b, rng.randrange(5)) for a in range(n) for b in range(a) if rng.random() < 0.6]
        value = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(value([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert value(H.minimum_cut(list(s), list(t), edges)) == best


# --- the pipeline


def test_pipeline_stage_by_stage(spark, data):
    import corpus_pipeline as C

    folder = data("sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard", "mix_sources", "bpe"]
    now = docs
    truth = spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, now, folder)
        out = spark.createDataFrame(out.collect(), out.schema)
        before, after = {r["doc_id"] for r in now.collect()}, {r["doc_id"] for r in out.collect()}
        assert after and after <= before
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "quality_classifier":
            good = {r["doc_id"] for r in truth.where("quality = 1").collect()} & before
            assert len(good & after) >= 0.97 * len(good)
        if name == "ngram_jaccard":
            from tests.llm.test_pairs import brute_jaccard

            rows = [(r["doc_id"], r["text"]) for r in now.collect()]
            assert after == {i for i, n, c in brute_jaccard(rows, 5, 8, 10) if n == 0 or i == c}
        now = out
    assert now.count() == spark.createDataFrame(C.run(spark, folder).collect(), now.schema).count()
