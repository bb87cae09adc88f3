"""Quality by the vote of the nearest labelled documents in a latent-semantic space.

A document's terms are its words, the shapes of its words and a few marks of how it repeats itself. Words over 40 characters,
as in scripts without spaces or packed code, count as their pieces, so all of a text counts. The labelled sample
gives vocabulary (every term that two of its documents have), inverse document frequencies and, by a randomised truncated
SVD of its sparse TF-IDF matrix, the latent axes. The sample is bounded by parameters, and the model is broadcast. Each
document is projected, compared with every labelled vector by exact cosine, block by block, and scored by the labels of
its nearest neighbours, weighted by similarity; all neighbours as near as the k-th vote, so ties cannot depend on an order.

Defined results: a null, empty or blank text has no quality and the score 0; one whose terms are all unknown has a zero
vector and gets the prior (the share of label 1 in the sample; 0.5 without any labels, in which case that is every other
text's score); repeated rows get the same score; an empty table gives an empty result; further columns pass through,
those named held_out, score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from sys import intern

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from prismcat.llm.common import fold_of, give_back, labelled_sample, read, worker_cache
from prismcat.llm.pieces import slices

#: Labelled documents that the model learns from, and latent axes.
SAMPLE, AXES = 3000, 64
NEIGHBOURS, POWER = 25, 4
THRESHOLD = 0.3
ROWS = 256
#: Documents are scored for about so many bytes of text at once.
SLICE = 500_000


#: Longest word that is a term as it is, and kinds of characters in a shape; a word with more kinds has several shapes.
WHOLE, KINDS = 40, 6
_PIECE = re.compile(r"[^\W\d_]+|\d+|([\W_])\1*")


class _Kinds(dict):
    """Code point to the code point of its kind: lower a, upper A, digit 0, anything else as it is."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = ord(("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c)
        return self[code]


_kinds = _Kinds()
_REPEAT = re.compile(r"(.)\1+", re.S)


def shapes_of(word: str) -> list[str]:
    """Kinds of characters in a word, runs as one; by six."""
    kinds = _REPEAT.sub(r"\1", word.translate(_kinds))
    return [kinds] if len(kinds) <= KINDS else [kinds[k : k + KINDS] for k in range(0, len(kinds), KINDS)]


def pieces_of(word: str) -> list[str]:
    """The runs of letters, digits or one mark in a long word; of long runs and of those that are not ASCII the character pairs."""
    out = []
    for m in _PIECE.finditer(word):
        run = m[0]
        if len(run) == 1 or (len(run) <= WHOLE and run.isascii()):
            out.append(run)
        else:
            out += map(str.__add__, run, run[1:])
    return out


def terms_of(text: str | None) -> Counter:
    """Terms and their weights before TF-IDF: words, shapes, and marks of length and repetition."""
    cache = worker_cache("quality").setdefault(0, {})
    split = (text or "").split()
    if not split:
        return Counter()
    long = [w for w in split if len(w) > WHOLE]
    run = [p for w in split for p in (pieces_of(w) if len(w) > WHOLE else (w,))] if long else split
    n, words = len(run), Counter(run)
    terms: Counter = Counter()
    shaped = 0
    for word, count in (Counter(w for w in split if len(w) <= WHOLE) if long else words).items():
        found = cache.get(word)
        if found is None:
            found = (intern("w " + word.lower()), *(intern("s " + kinds) for kinds in shapes_of(word)))
            if len(cache) > 100_000:
                cache.clear()
            cache[word] = found
        for term in found:
            terms[term] += count
        shaped += count * (len(found) - 1)
    for word in long:
        shapes = shapes_of(word)
        terms.update(["s " + kinds for kinds in shapes])
        terms.update(["w " + piece.lower() for piece in pieces_of(word)])
        shaped += len(shapes)
    bucket = lambda name, x, weight: terms.update({f"m {name} {x}": weight})
    common = {k: c / shaped for k, c in terms.items() if k[0] == "s"}
    bucket("length", n.bit_length() - 1, 1)
    bucket("distinct", int(10 * len(words) / n), 8)
    bucket("top", int(10 * words.most_common(1)[0][1] / n), 8)
    bucket("again", int(10 * sum(map(str.__eq__, run, run[1:])) / n), 8)
    for k, share in common.items():  # how much of the text has a shape
        bucket(f"share {k}", int(5 * share), 2)
    return terms


def model_cache(key: str) -> dict:
    """What a worker keeps of words for the model with this key. Numbers of terms are of one model's vocabulary, so
    another model, also a later fit for other tables in the same session, starts with nothing."""
    cache = worker_cache("quality")
    if cache.get("model") != key:
        cache.clear()
        give_back()
        cache["model"] = key
    return cache


@dataclass
class QualityModel:
    terms: dict[str, int]
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    #: The same in all copies of a model that workers get, another in each fit.
    key: str = field(default_factory=lambda: uuid.uuid4().hex, init=False)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, known term, weight before TF-IDF) in order of both: what terms_of says, for many texts at once."""
        get = self.terms.get
        split = [(t or "").split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        owner = np.repeat(np.arange(len(texts)), sizes)
        numbered = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        words, at = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        long = np.unique(owner[(pc.utf8_length(numbered.dictionary).to_numpy(zero_copy_only=False) > WHOLE)[at]]) if len(at) else np.zeros(0, np.int64)
        slow = np.zeros(len(texts), bool)
        slow[long] = True  # texts with long words go one by one
        keep = ~slow[owner]
        owner, at, sizes = owner[keep], at[keep], np.where(slow, 0, sizes)
        cache = model_cache(self.key)
        numbers, shapes, parts = cache.setdefault(1, {}), cache.setdefault(2, []), cache.setdefault(3, {})  # of each shape: its number, name; of each word: its known term, its shapes
        found = []
        for w in words:
            part = parts.get(w)
            if part is None:
                if len(parts) > 100_000:
                    parts.clear()
                own = shapes_of(w) if len(w) <= WHOLE else []
                for k in own:
                    if k not in numbers:
                        numbers[k] = len(shapes)
                        shapes.append(k)
                parts[w] = part = (get("w " + w.lower(), -1), *[numbers[k] for k in own])
            found.append(part)
        widths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(widths.sum()))
        starts = np.cumsum(widths) - widths
        texts_of, terms, weights = [], [], []

        def put(text: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
            known = term >= 0
            texts_of.append(text[known])
            terms.append(term[known])
            weights.append(weight[known])

        def counted(text: np.ndarray, thing: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key, n = np.unique(text * size + thing, return_counts=True)
            return key // size, key % size, n

        if len(at):
            word = flat[starts[at]]
            text, term, n = counted(owner[word >= 0], word[word >= 0], max(1, len(self.terms)))
            put(text, term, n)
            more = widths[at] - 1
            ends = np.cumsum(more)
            shape = flat[np.repeat(starts[at] + 1 - (ends - more), more) + np.arange(int(ends[-1]))]
            text, shape, n = counted(np.repeat(owner, more), shape, len(numbers))
            put(text, np.fromiter((get("s " + k, -1) for k in shapes), np.int64, len(shapes))[shape], n)
            share = (5 * (n / np.bincount(text, n, minlength=len(texts))[text])).astype(np.int64)
            pair, back = np.unique(shape * 8 + share, return_inverse=True)
            put(text, np.fromiter((get(f"m share s {shapes[p // 8]} {p % 8}", -1) for p in pair.tolist()), np.int64, len(pair))[back], np.full(len(text), 2))
            text, _, n = counted(owner, at, len(words))
            distinct, top = np.bincount(text, minlength=len(texts)), np.zeros(len(texts), np.int64)
            np.maximum.at(top, text, n)
            again = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (at[1:] == at[:-1])], minlength=len(texts))
            has = np.flatnonzero(sizes)
            for name, value, weight in (("length", None, 1), ("distinct", distinct, 8), ("top", top, 8), ("again", again, 8)):
                x = [int(sizes[k]).bit_length() - 1 for k in has] if value is None else (10 * value[has] / sizes[has]).astype(np.int64).tolist()
                put(has, np.fromiter((get(f"m {name} {v}", -1) for v in x), np.int64, len(has)), np.full(len(has), weight))
        for k in long.tolist():
            own = [(i, c) for t, c in terms_of(texts[k]).items() if (i := get(t)) is not None]
            put(np.full(len(own), k), np.asarray([i for i, _ in own], np.int64), np.asarray([c for _, c in own], np.int64))
        if not texts_of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        text, term, weight = np.concatenate(texts_of), np.concatenate(terms), np.concatenate(weights).astype(np.float64)
        order = np.lexsort((term, text))
        return text[order], term[order], weight[order]

    def project(self, texts: list[str | None]) -> np.ndarray:
        """Unit latent vectors, zero where a text has no known term."""
        text, term, weight = self.counts(texts)
        out = np.zeros((len(texts), self.axes.shape[1]), np.float64)
        if len(text):
            has, starts = np.unique(text, return_index=True)
            out[has] = np.add.reduceat(self.axes[term] * ((1 + np.log(weight)) * self.idf[term])[:, None], starts)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        wordless = np.asarray([not (t or "").strip() for t in texts], bool)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.where(wordless, 0.0, self.prior)
        x = self.project(texts)
        sims = x @ self.vectors.T
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        votes = np.where(sims >= least[:, None] - 1e-12, np.maximum(sims, 0.0) ** POWER, 0.0)
        total = votes.sum(axis=1) + 1e-3  # the prior has a small vote of its own
        scores = np.where(x.any(axis=1), np.clip((votes @ self.labels + 1e-3 * self.prior) / total, 0.0, 1.0), self.prior)
        return np.where(wordless, 0.0, scores)


class _Sparse:
    """A sparse matrix by row and by column; products with dense ones, by parts of bounded size."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        by = np.lexsort((row, column))
        self.forms = ((row, column, value), (column[by], row[by], value[by]))

    def times(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        row, column, value = self.forms[transposed]
        n = self.shape[transposed]
        out = np.zeros((n, x.shape[1]))
        at, step = np.searchsorted(row, np.arange(n + 1)), 20_000
        k = 0
        while k < n:
            z = max(k + 1, int(np.searchsorted(at, at[k] + step, "right")) - 1)
            a, b = at[k], at[z]
            if b > a:
                has, starts = np.unique(row[a:b], return_index=True)
                out[has] = np.add.reduceat(x[column[a:b]] * value[a:b, None], starts)
            k = z
        return out


def fit(sample: list[tuple[str, int]], *, axes: int = AXES) -> QualityModel:
    """The model of a bounded sample of (text, label). Terms are read again rather than kept for all documents."""
    labels = np.asarray([y for _, y in sample], np.float64)
    frequency: Counter = Counter()
    for text, _ in sample:
        frequency.update(terms_of(text).keys())
    chosen = sorted(t for t, n in frequency.items() if n >= 2)
    n = len(sample)
    idf = np.asarray([math.log((1 + n) / (1 + frequency[t])) + 0.1 for t in chosen])
    del frequency
    prior = float(labels.mean()) if n else 0.5
    model = QualityModel({t: i for i, t in enumerate(chosen)}, idf, np.zeros((len(chosen), 1)), np.zeros((0, 1)), np.zeros(0), prior)
    if not chosen:
        return model
    worker_cache("driver")  # gives back the terms of all words that the sample has
    parts = [(text + k, term, weight) for k in range(0, n, ROWS) for text, term, weight in [model.counts([t for t, _ in sample[k : k + ROWS]])]]
    row, term, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    worker_cache("driver")
    weight = (1 + np.log(weight)) * idf[term]
    matrix = _Sparse(row, term, weight / np.sqrt(np.bincount(row, weight**2, minlength=n))[row], (n, len(chosen)))
    rank = max(1, min(axes, n, len(chosen)))
    rng = np.random.default_rng(3)
    basis = matrix.times(rng.standard_normal((len(chosen), min(rank + 16, len(chosen)))))
    for _ in range(2):
        basis, _r = np.linalg.qr(matrix.times(matrix.times(basis, True)))
    image = matrix.times(basis, True)
    value, turn = np.linalg.eigh(image.T @ image)  # its right singular vectors are those of a small square matrix
    best = np.argsort(-value, kind="stable")[: max(1, min(rank, int((value > 1e-10 * value.max()).sum())))]
    model.axes = (image @ (turn[:, best] / np.sqrt(value[best]))).astype(np.float32)
    del image, basis
    vectors = matrix.times(model.axes.astype(np.float64))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    model.vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 1e-12)
    model.labels = labels
    return model


def score_with(docs: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """docs with score and predicted, by any model that has score(texts); no shuffle."""
    key = getattr(model, "key", "")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that the model is made of
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_cache(key)  # gives back what the stage before or another model has left, ahead of the model
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                scores = shared.value.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores, pa.float64())], names=[*names, "score"])

    scored = docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_model(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> QualityModel:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(labelled_sample(docs, labels, "quality", fold_of(F.col("doc_id"), 5) != 0, sample))


def score_quality(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) with held_out, score and predicted."""
    scored = score_with(docs.withColumn("held_out", fold_of(F.col("doc_id"), 5) == 0), quality_model(labelled_docs, labels), threshold)
    give_back()  # what the driver needed for the fit
    return scored


def op8(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
