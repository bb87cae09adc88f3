"""URL filter: host and path rules first, gradient-boosted trees on lexical features for every other URL.

DataFrame operations only. The rules that decide URLs also label them; the trees (Spark ML) learn from a bounded
sample of these labelled URLs and are then turned into column expressions, so scoring stays in generated code.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the
trees on zero features; repeated rows are judged alike; with no labelled URL every undecided one is allowed, with
labels of one kind all get that verdict; an empty table gives an empty result; further columns pass through, those
named like the operator's own (host, path, rule, verdict, block_score) are replaced, those named like a feature
(FEATURES, _suffix, _site, _section, _b, _n) are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from prismcat.llm.common import ascii_lower, read, written

#: (verdict, rule): host up to the first "/", then the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The trees are fitted on at most so many labelled URLs, the first by hash.
SAMPLE = 20_000
#: Statistics of at most so many suffixes (sites, sections) are broadcast; more are joined by shuffle.
SUFFIXES = 100_000
TREES, DEPTH, STEP, SEED = 12, 4, 0.3, 11
FEATURES = ("f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_entropy", "f_params", "f_fragment", "f_hyphens", *[f"f_{k}_{x}" for k in ("suffix", "site", "section") for x in ("rate", "log")])
#: Keys of the suffix statistics: the host's last label, its last two, and these with the path's first segment.
KEYS = ("suffix", "site", "section")
_OWN = ("host", "path", "rule", "verdict", "block_score")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits the host (or a parent domain of it) and the start of the path; else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits: one pass over the sorted characters, run by run."""
    bits = lambda n: n * F.log2(n)
    chars = F.array_sort(F.split(text, ""))
    zero = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(
        F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["s"] + F.when(a["n"] > 0, bits(a["n"])).otherwise(0.0)).alias("s"))
    )
    done = lambda a: a["s"] + F.when(a["n"] > 0, bits(a["n"])).otherwise(0.0)
    n = F.length(text).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(chars, zero, step, done) / n).otherwise(0.0)


def keys_of(host: Column, path: Column) -> dict[str, Column]:
    site = F.substring_index(host, ".", -2)
    return {"_suffix": F.substring_index(host, ".", -1), "_site": site, "_section": F.concat(site, F.lit("/"), F.regexp_extract(path, r"(?s)\A/([^/]*)/", 1))}


def with_features(urls: DataFrame) -> DataFrame:
    """The lexical features that need no other row; host and path are there already."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return urls.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_labels": F.when(F.col("host") == "", 0.0).otherwise(count(F.col("host"), ".") + 1),
            "f_depth": count(F.col("path"), "/"),
            "f_digits": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0),
            "f_entropy": entropy(url),
            "f_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "f_fragment": url.contains("#").cast("double"),
            "f_hyphens": count(F.col("host"), "-"),
            **keys_of(F.col("host"), F.col("path")),
        }
    )


def with_suffix(urls: DataFrame, key: str, stats: DataFrame, label: Column | None = None) -> DataFrame:
    """Share of blocked ones (smoothed) and log count of all labelled URLs of the same key; with label, of all others."""
    blocked, many = F.coalesce("_b", F.lit(0.0)), F.coalesce("_n", F.lit(0)).cast("double")
    if label is not None:
        blocked, many = blocked - label, many - 1
    return urls.join(stats, f"_{key}", "left").withColumns({f"f_{key}_rate": (blocked + 1.0) / (many + 2.0), f"f_{key}_log": F.log1p(many)}).drop("_b", "_n")


def _tree(node, depth: int = 0) -> Column:
    """A fitted regression tree as a column expression."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), depth + 1)).otherwise(_tree(node.rightChild(), depth + 1))


def filter_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE, score_all: bool = False) -> DataFrame:
    """pages with host, path, rule, verdict and block_score (null where a rule decides, unless score_all).

    The trees learn from the first `sample` labelled URLs by hash; there the suffix statistics leave the URL itself out.
    """
    verdict = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]) if rules else None
    judged = pages.drop(*_OWN, *FEATURES, *[f"_{k}" for k in KEYS], "_b", "_n").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string") if verdict is None else F.element_at(verdict, F.col("rule"))
    judged = judged.withColumn("verdict", by_rule)
    full = with_features(judged)
    every = judged.where(F.col("rule").isNotNull()).select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("label")).distinct()
    labelled = every.orderBy(F.xxhash64("url"), "url").limit(sample)
    fitted = with_features(labelled).select("label", *[f"_{k}" for k in KEYS], *[f for f in FEATURES if not f.startswith(tuple(f"f_{k}_" for k in KEYS))]).cache()
    try:
        # Suffix statistics of all labelled URLs.
        tables: dict[str, DataFrame] = {}
        for key in KEYS:
            counted = every.select(keys_of(F.col("host"), F.col("path"))[f"_{key}"].alias(f"_{key}"), "label").groupBy(f"_{key}").agg(F.sum("label").alias("_b"), F.count("*").alias("_n"))
            tables[key] = written(pages.sparkSession, counted, key)
            if tables[key].count() <= SUFFIXES:
                tables[key] = F.broadcast(tables[key])

        def join(urls: DataFrame, label: Column | None = None) -> DataFrame:
            for key, stats in tables.items():
                urls = with_suffix(urls, key, stats, label)
            return urls

        kinds = {r["label"] for r in fitted.select("label").distinct().collect()}
        if len(kinds) < 2:
            margin = F.lit(1.0 if kinds == {1.0} else -1.0)
        else:
            data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(join(fitted, F.col("label"))).select("label", "features").coalesce(1)
            model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, maxBins=32).fit(data)
            margin = F.lit(0.0)
            trees = model._java_obj.trees()
            for tree, weight in zip(trees, model.treeWeights, strict=True):
                margin = margin + F.lit(float(weight)) * _tree(tree.rootNode())
    finally:
        fitted.unpersist()
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * margin))
    every_score = score if score_all else F.when(F.col("rule").isNull(), score)
    scored = join(full).withColumn("block_score", every_score)
    decided = F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", decided).drop(*[f"_{k}" for k in KEYS], *FEATURES)


def op9(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
