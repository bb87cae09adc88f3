"""Toxicity by the votes of the nearest labelled examples, found exactly in a block-max inverted index.

Every term of a bounded labelled sample (words, their starts, character windows of long runs) is in the vocabulary, and
every example is in the index. A term weighs tf * idf, times a factor between FLOOR and 1 + FLOOR that grows with its
chi-squared against the label: neutral terms count for little, but they count. The index keeps each term's postings by block of examples
with the largest weight in each block. For a batch of documents every block gets the bound sum(q * largest); the best
blocks are read first, then all others whose bound reaches the k-th best cosine found there, so the neighbours are
exact. All examples as near as the k-th vote, weighted by a power of their cosine. An isotonic fit to leave-one-out
votes of the sample turns the vote into a probability. The nearest examples and the terms that the document shares with each of them are
the evidence, a report of the first few.

Defined results: a null or empty text, and one that shares no term with any example, gets the calibrated share of label
1 among such examples, and no evidence; without labels every score is 0; repeated rows score alike; an empty table gives
an empty result; further columns pass through, those named held_out, score, predicted or evidence are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from prismcat.llm.common import fold_of, give_back, labelled_sample, read, worker_cache
from prismcat.llm.pieces import slices

#: Labelled documents that the model learns from.
SAMPLE = 3000
#: Chi-squared (one degree of freedom) at which a term has its full weight, and the share of it that any term has.
LEVEL, FLOOR = 30.0, 0.1
NEIGHBOURS, BLOCK, POWER = 25, 64, 2
THRESHOLD = 0.7
#: Neighbours and terms of each that the evidence names.
SHOWN, WORDS = 3, 5
#: Documents that are searched at once, and blocks that each reads before the others are pruned.
ROWS, FIRST = 16, 8
#: Terms are looked up for about so many bytes of text at once.
SLICE = 1_000_000
#: Terms that more than so large a part of the examples have are kept as full rows of the index.
DENSE = 12

#: Besides whole words, their first START bytes are terms: endings vary. Runs of more than LONG bytes, as in scripts
#: without spaces, count as their windows of WINDOW bytes instead.
START, LONG, WINDOW = 5, 60, 6


#: Everything in ASCII but letters parts words, and so do the spaces and marks of these blocks of Unicode, in UTF-8.
_APART = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MARKS = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef\xbc[\x80-\x8f]")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, in lower case and UTF-8."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    return (data if data.isascii() else _MARKS.sub(b" ", data)).translate(_APART).split()


def terms_of(word: bytes) -> list[bytes]:
    """Terms of a word: itself and its start, marked with a caret; the windows of a long run."""
    if len(word) > LONG:
        return [word[k : k + WINDOW] for k in range(len(word) - WINDOW + 1)]
    return [word, b"^" + word[:START]] if len(word) >= START else [word]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start, start + 1, ... of each run in a row, and each one's run."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0), np.repeat(np.arange(len(sizes)), sizes)


class BlockMaxIndex:
    """Sparse vectors (row, term, weight) by term and block of rows; nearest() gives all rows at least as near as the k-th.

    Terms that more than a DENSE-th of the rows have are kept as full rows of weights and multiplied at once; all others
    are postings by block with each block's largest weight.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, n_terms: int):
        # Rows with the same heaviest term among those that fill a block stand together: tight bounds.
        frequency = np.bincount(term, minlength=n_terms)
        lead, most = np.full(n_rows, n_terms), np.zeros(n_rows)
        for k in np.flatnonzero(frequency[term] >= BLOCK):
            if weight[k] > most[row[k]]:
                lead[row[k]], most[row[k]] = term[k], weight[k]
        self.n, self.blocks = n_rows, max(1, -(-n_rows // BLOCK))
        self.rows = np.lexsort((np.arange(n_rows), -most, lead))  # row at each place
        self.place = np.empty(n_rows, np.int64)
        self.place[self.rows] = np.arange(n_rows)
        at = self.place[row]
        full = np.flatnonzero(frequency * DENSE > n_rows)
        self.full = np.full(n_terms, -1, np.int32)
        self.full[full] = np.arange(len(full))
        heavy = self.full[term] >= 0
        self.dense = np.zeros((len(full), self.blocks * BLOCK))
        self.dense[self.full[term[heavy]], at[heavy]] = weight[heavy]
        term, at, weight = term[~heavy], at[~heavy], weight[~heavy]
        order = np.lexsort((at, term))
        self.at, self.weight, term = at[order].astype(np.int32), weight[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.at[1:] // BLOCK != self.at[:-1] // BLOCK)
        self.start = np.flatnonzero(new).astype(np.int32)  # entries: a term in a block
        self.size = np.diff(np.append(self.start, len(term))).astype(np.int32)
        self.block = self.at[self.start] // BLOCK
        self.most = np.maximum.reduceat(self.weight, self.start) if len(term) else np.zeros(0)
        self.entries = np.searchsorted(term[self.start], np.arange(n_terms + 1))

    def __getstate__(self) -> dict:
        """Travels with the full rows as sparse ones."""
        at = np.flatnonzero(self.dense)
        return self.__dict__ | {"dense": (self.dense.shape, at.astype(np.int32), self.dense.ravel()[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, values = state["dense"]
        self.__dict__ |= state
        self.dense = np.zeros(shape)
        self.dense.ravel()[at] = values

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n_docs: int, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, row, product) of the rows with a positive product that are as near as the document's k-th; leave: a row to skip for each."""
        nb, n = self.blocks, self.blocks * BLOCK
        column = self.full[term]
        heavy = column >= 0
        query = np.zeros((n_docs, len(self.dense)))
        query[doc[heavy], column[heavy]] = weight[heavy]
        found = (query @ self.dense).reshape(n_docs, nb, BLOCK)  # exact for the full terms; blocks that are read get the postings added
        doc, term, weight = doc[~heavy], term[~heavy], weight[~heavy]
        first = self.entries[term]
        entry, of = _runs(first, self.entries[term + 1] - first)
        key = doc[of] * nb + self.block[entry]
        bounds = np.bincount(key, weight[of] * self.most[entry], minlength=n_docs * nb).reshape(n_docs, nb) + found.max(axis=2)
        base = doc * n

        def look(chosen: np.ndarray) -> None:
            """Adds the postings of these blocks."""
            nonlocal found
            use = np.flatnonzero(chosen.ravel()[key])
            e, o = entry[use], of[use]
            post, run = _runs(self.start[e], self.size[e])
            found += np.bincount(base[o][run] + self.at[post], weight[o][run] * self.weight[post], minlength=n_docs * n).reshape(n_docs, nb, BLOCK)
            if leave is not None:
                found.reshape(n_docs, n)[np.arange(n_docs), self.place[leave]] = 0.0

        best = np.argpartition(-bounds, min(FIRST, nb) - 1, axis=1)[:, : min(FIRST, nb)]
        read = np.zeros((n_docs, nb), bool)
        read[np.arange(n_docs)[:, None], best] = True
        read &= bounds > 0
        look(read)
        seen = found[np.arange(n_docs)[:, None], best].reshape(n_docs, -1)
        reach = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k] if seen.shape[1] >= k else np.zeros(n_docs)
        rest = ~read & (bounds > 0) & (bounds >= reach[:, None] - 1e-12)
        look(rest)
        d, b, j = np.nonzero((found > 0) & (found >= reach[:, None, None] - 1e-12) & (read | rest)[:, :, None])
        product = found[d, b, j]
        order = np.lexsort((-product, d))  # a few more than k each
        d, at, product = d[order], (b * BLOCK + j)[order], product[order]
        starts = np.searchsorted(d, np.arange(n_docs))
        last = np.minimum(starts + k - 1, np.searchsorted(d, np.arange(n_docs), "right") - 1)
        keep = product >= product[last][d] - 1e-12 if len(product) else np.zeros(0, bool)
        return d[keep], self.rows[at[keep]], product[keep]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps (from, value) by pooling adjacent violators; equal x are one point."""
    xs, at = np.unique(x, return_inverse=True)
    total, count = np.bincount(at, y), np.bincount(at).astype(float)
    pools: list[list[float]] = []
    for a, s, n in zip(xs, total, count, strict=True):
        pools.append([a, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s2, n2 = pools.pop()
            pools[-1][1] += s2
            pools[-1][2] += n2
    return np.asarray([p[0] for p in pools]), np.asarray([p[1] / p[2] for p in pools])


class ToxicityModel:
    def __init__(self, sample: list[tuple[str, int]]):
        self.labels = np.asarray([y for _, y in sample], float)
        n, positive = len(sample), float(self.labels.sum())
        self.prior = positive / n if n else 0.0
        vocabulary: dict[bytes, None] = {}
        for text, _ in sample:
            for word in set(words_of(text)):
                vocabulary.update(dict.fromkeys(terms_of(word)))
        self.words = pa.array(list(vocabulary), pa.binary())
        del vocabulary
        counted = [(row + k, term, count) for k in range(0, n, 256) for row, term, count in [self.count([t for t, _ in sample[k : k + 256]])]]
        row, term, count = (np.concatenate(x) for x in zip(*counted, strict=True)) if counted else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        f = np.bincount(term, minlength=len(self.words)).astype(float)
        a = np.bincount(term, self.labels[row], minlength=len(self.words)) if n else f
        below = f * (n - f) * positive * (n - positive)
        chi = np.divide(n * (a * n - f * positive) ** 2, below, out=np.zeros_like(f), where=below > 0)
        idf = np.log((1 + n) / (1 + f)) + 0.05
        self.factor = idf * (FLOOR + np.minimum(1.0, chi / LEVEL))
        weight = self.unit(row, term, count, n)
        self.index = BlockMaxIndex(row, term, weight, n, len(self.words))
        self.at, self.of, self.weight = np.searchsorted(row, np.arange(n + 1)), term.astype(np.int32), weight  # by example, for the evidence
        raw = np.full(n, -1.0)
        for k in range(0, n, ROWS):
            a, z = self.at[k], self.at[min(n, k + ROWS)]
            size = min(ROWS, n - k)
            raw[k : k + size] = self.votes(*self.index.nearest(row[a:z] - k, term[a:z], weight[a:z], size, min(NEIGHBOURS, max(1, n - 1)), np.arange(k, k + size)), size)
        silent = raw < 0  # examples that share nothing with another one
        self.base = float((self.labels[silent].sum() + self.prior) / (silent.sum() + 1)) if n else 0.0
        self.steps = isotonic(raw[~silent], self.labels[~silent]) if (~silent).any() else (np.zeros(0), np.zeros(0))

    def count(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of the known terms, in order of text and term."""
        number = max(1, len(self.words))
        found = [words_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
        word = pa.array(chain.from_iterable(found), pa.binary())
        width = pc.binary_length(word).to_numpy(zero_copy_only=False)
        short, long = np.flatnonzero(width <= LONG), np.flatnonzero(width > LONG)
        starts = np.flatnonzero((width >= START) & (width <= LONG))
        windows = [terms_of(w) for w in word.take(pa.array(long)).to_pylist()]
        asked = [word.take(pa.array(short)), pc.binary_join_element_wise(pa.scalar(b"^"), pc.binary_slice(word.take(pa.array(starts)), 0, START), pa.scalar(b"")), pa.array(chain.from_iterable(windows), pa.binary())]
        term = pc.fill_null(pc.index_in(pa.concat_arrays(asked), value_set=self.words), -1).to_numpy().astype(np.int64)
        owner = np.concatenate([owner[short], owner[starts], np.repeat(owner[long], np.fromiter(map(len, windows), np.int64, len(windows)))])
        key, count = np.unique((owner * number + term)[term >= 0], return_counts=True)
        return key // number, key % number, count.astype(float)

    def unit(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """TF-IDF weights of unit vectors."""
        weight = (1 + np.log(count)) * self.factor[term]
        return weight / np.sqrt(np.bincount(row, weight**2, minlength=n))[row]

    def votes(self, doc: np.ndarray, example: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """Share of the weight of each document's neighbours that has label 1, -1 where there are none."""
        weight = cosine**POWER
        total = np.bincount(doc, weight, minlength=n)
        toxic = np.bincount(doc, weight * self.labels[example], minlength=n)
        return np.divide(toxic, total, out=np.full(n, -1.0), where=total > 0)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        at, value = self.steps
        scores = np.clip(np.interp(votes, at, value), 0.0, 1.0) if len(at) else votes
        return np.where(votes < 0, self.base, scores)

    def judge(self, texts: Sequence[str | None]) -> tuple[list[float], list[list[dict]]]:
        """Scores, and the first of the nearest examples: similarity, label, terms that they share with the text."""
        scores: list[float] = []
        evidence: list[list[dict]] = []
        query = np.zeros(len(self.words))
        docs, terms, counts = self.count(texts)
        weights = self.unit(docs, terms, counts, len(texts))
        for k in range(0, len(texts), ROWS):
            n = min(ROWS, len(texts) - k)
            a, z = np.searchsorted(docs, (k, k + n))
            doc, term, weight = docs[a:z] - k, terms[a:z], weights[a:z]
            d, example, cosine = self.index.nearest(doc, term, weight, n, NEIGHBOURS)
            scores += self.calibrated(self.votes(d, example, cosine, n)).tolist()
            order = np.lexsort((example, -cosine, d))
            starts, at = np.searchsorted(d[order], np.arange(n + 1)), np.searchsorted(doc, np.arange(n + 1))
            for i in range(n):
                own = slice(at[i], at[i + 1])
                query[term[own]] = weight[own]
                evidence.append([self._shared(query, int(example[j]), float(cosine[j])) for j in order[starts[i] : min(starts[i] + SHOWN, starts[i + 1])]])
                query[term[own]] = 0.0
        return scores, evidence

    def _shared(self, query: np.ndarray, example: int, cosine: float) -> dict:
        """A neighbour, with the terms that make most of its cosine, heaviest first."""
        terms = self.of[self.at[example] : self.at[example + 1]]
        product = query[terms] * self.weight[self.at[example] : self.at[example + 1]]
        first = np.lexsort((terms, -product)) if len(terms) <= WORDS else (few := np.argpartition(-product, WORDS - 1)[:WORDS])[np.lexsort((terms[few], -product[few]))]
        return {"similarity": min(1.0, cosine), "label": int(self.labels[example]), "words": [self.words[int(terms[j])].as_py().decode("utf-8", "ignore") for j in first if product[j] > 0]}

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        return np.asarray(self.judge(texts)[0], float)


EVIDENCE = T.ArrayType(T.StructType([T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))]))
_ARROW = pa.list_(pa.struct([("similarity", pa.float64()), ("label", pa.int32()), ("words", pa.list_(pa.string()))]))


def toxicity_model(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from rows whose crc32(doc_id as text) mod 3 is not 1."""
    return ToxicityModel(labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), 3) != 1, sample))


def score_toxicity(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) with held_out, score, predicted and evidence; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(labelled_docs, labels))  # bounded by the sample that it is made of
    give_back()  # what the driver needed for the fit
    own = ("held_out", "score", "predicted", "evidence")
    kept = [f for f in docs.schema.fields if f.name not in own]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("evidence", EVIDENCE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = batch.column("text").to_pylist()
                place = {t: k for k, t in enumerate(dict.fromkeys(texts))}  # copies are judged once
                scores, evidence = model.value.judge(list(place))
                scores, evidence = ([found[place[t]] for t in texts] for found in (scores, evidence))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores, pa.float64()), pa.array(evidence, _ARROW)], names=[*names, "score", "evidence"])

    scored = docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)
    return scored.withColumn("held_out", fold_of(F.col("doc_id"), 3) == 1).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "evidence")
