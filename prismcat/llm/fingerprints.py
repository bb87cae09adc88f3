"""Document fingerprints from prefix polynomial hashes.

For the code points c of a text, S[i] = sum of (c[j] + 1) * B**j over j < i, modulo a prime, is one array operation. Any
span then has the hash (S[end] - S[start]) / B**start, whatever its place, so equal spans are told in constant time and
the longest common extension of two places is found by binary search. Two primes make 62 bits for whole texts.

A fingerprint is "length:hash:sketch": the number of code points, the whole text's hash, and 64 bins, each with eight
bits of the smallest span hash that falls in it, over all spans of SPAN code points. Two fingerprints' likeness is the
Dice coefficient of their sets of spans as the bins estimate it, and 1 for equal fingerprints.

Each document is compared with an edited text that ends in the start of the next document. Texts are dealt out once by
range of doc_id, sorted, and met in order; only the first and last text of each range are brought together afterwards.

Defined results: a null text is empty; an empty text has length 0, hash 0 and an empty sketch, and likeness 0 to anything
but another empty text; texts shorter than SPAN are one span; equal doc_ids are ordered by hash and text, null doc_ids
come last; the only document of a table is its own next; an empty table gives an empty result; only doc_id and text are
read, other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from prismcat.llm.common import read, written

PRIMES, BASE = (2147483647, 2147483629), 1_000_003
SPAN, BINS = 8, 64
#: Of a text's span hashes, about so many times BINS of the smallest are looked at first: if spans differ, a bin stays empty
#: with chance e**-12. Where one does, as in repetitive texts, all are looked at.
DEPTH = 12


class _Powers:
    """B**j and B**-j modulo each prime, as far as the longest text so far."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def reach(self, n: int) -> None:
        while len(self.up[0]) < n:
            for k, p in enumerate(PRIMES):
                for tables, base in ((self.up, BASE), (self.down, pow(BASE, -1, p))):
                    t = tables[k]
                    tables[k] = np.concatenate([t, t * np.uint64(pow(base, len(t), p)) % np.uint64(p)])


_powers = _Powers()


class PrefixHashes:
    """Prefix arrays of a text."""

    __slots__ = ("n", "text", "sums")

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        _powers.reach(self.n + 1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * _powers.up[k][: self.n] % np.uint64(p), out=s[1:])
            s %= np.uint64(p)
            self.sums.append(s)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of the code points start to end, the same wherever they stand."""
        return tuple((int(self.sums[k][end]) - int(self.sums[k][start])) * int(_powers.down[k][start]) % p for k, p in enumerate(PRIMES))

    def spans(self, size: int, end: int | None = None) -> np.ndarray:
        """Hashes (first prime) of all spans of this size that end at `end` at the latest."""
        end = self.n if end is None else min(end, self.n)
        m = end - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        p, s = np.uint64(PRIMES[0]), self.sums[0]
        return (s[size : size + m] + p - s[:m]) % p * _powers.down[0][:m] % p

    def common_extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common extension of this text from start and the other from at."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(at, at + middle):
                low = middle
            else:
                high = middle - 1
        return low


def joined_hash(a: PrefixHashes, a_end: int, b: PrefixHashes, b_end: int) -> int:
    """Hash of a's first a_end code points followed by b's first b_end, from the prefix arrays alone."""
    _powers.reach(a_end + 1)
    parts = [(int(a.sums[k][a_end]) + int(b.sums[k][b_end]) * int(_powers.up[k][a_end])) % p for k, p in enumerate(PRIMES)]
    return parts[0] << 31 | parts[1]


def sketch(spans: np.ndarray) -> np.ndarray:
    """64 bins of eight bits, 0 for an empty one."""
    mixed = spans * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed >>= np.uint64(2)
    n = len(mixed)
    if n > DEPTH * BINS:
        out = _bins(mixed[mixed < np.uint64((1 << 62) // n * DEPTH * BINS)])
        if out.all():
            return out
    return _bins(mixed)


def _bins(mixed: np.ndarray) -> np.ndarray:
    """The eight bits of the smallest hash in each bin."""
    mixed.sort()
    out = np.zeros(BINS, np.uint8)
    bins = (mixed % np.uint64(BINS)).astype(np.int64)[::-1]
    out[bins] = (mixed[::-1] // np.uint64(BINS) % np.uint64(255)).astype(np.uint8) + 1  # the smallest is written last
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of the span sets behind two sketches, as estimated."""
    either = int(((a > 0) | (b > 0)).sum())
    if not either:
        return 0.0
    same = int(((a == b) & (a > 0)).sum())
    jaccard = max(0.0, (same / either - 1 / 255) / (1 - 1 / 255))
    return 2 * jaccard / (1 + jaccard)


def fingerprint_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints as strings."""
    return 1.0 if a == b else likeness(*(np.frombuffer(bytes.fromhex(x.rpartition(":")[2]), np.uint8) for x in (a, b)))


class Document:
    """A text with its prefix arrays and the hashes of its spans."""

    __slots__ = ("doc_id", "text", "hashes", "spans", "bins", "print")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.hashes = PrefixHashes(text)
        n = len(text)
        self.spans = self.hashes.spans(min(SPAN, n)) if n else np.zeros(0, np.uint64)
        self.bins = sketch(self.spans.copy())
        self.print = _print(n, joined_hash(self.hashes, n, self.hashes, 0), self.bins)


def _print(n: int, whole: int, bins: np.ndarray) -> str:
    return f"{n}:{whole:016x}:{bins.tobytes().hex()}"


def compare(doc: Document, after: Document) -> tuple:
    """The contract's columns for a document and the next one."""
    n = len(doc.text)
    m = n // 3
    keep, take = n - m, min(m, len(after.text))
    edited = doc.text[:keep] + after.text[:take]
    size = len(edited)
    if size >= SPAN:  # spans inside either part are there already; only those across are new
        across = PrefixHashes(edited[max(0, keep - SPAN + 1) : keep + SPAN - 1])
        own = doc.spans[: max(0, keep - SPAN + 1)] if n >= SPAN else np.zeros(0, np.uint64)
        its = after.spans[: max(0, take - SPAN + 1)] if len(after.text) >= SPAN else np.zeros(0, np.uint64)
        bins = sketch(np.concatenate([own, its, across.spans(SPAN)]))
    else:
        bins = sketch(PrefixHashes(edited).spans(size)) if size else np.zeros(BINS, np.uint8)
    edited_print = _print(size, joined_hash(doc.hashes, keep, after.hashes, take), bins)
    near_edited = 1.0 if edited_print == doc.print else likeness(doc.bins, bins)
    near_next = 1.0 if after.print == doc.print else likeness(doc.bins, after.bins)
    common = keep + (doc.hashes.common_extension(keep, after.hashes, 0) if m else 0)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc.doc_id, n, sha, doc.print, edited_print, near_edited, near_next, min(common, size)


RESULT = [
    ("doc_id", pa.int64(), T.LongType()),
    ("n_chars", pa.int64(), T.LongType()),
    ("edited_sha256", pa.string(), T.StringType()),
    ("fingerprint", pa.string(), T.StringType()),
    ("edited_fingerprint", pa.string(), T.StringType()),
    ("near_edited", pa.float64(), T.DoubleType()),
    ("near_next", pa.float64(), T.DoubleType()),
    ("common_start", pa.int64(), T.LongType()),
]
_SCHEMA = T.StructType([T.StructField(n, t) for n, _, t in RESULT])
_MET = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType()), *_SCHEMA.fields])
#: place of a row: a finished result, or the first or last text of a range.
DONE, FIRST, LAST = 0, 1, 2


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_ARROW = [(n, t) for n, t, _ in RESULT]
_ARROW_MET = [("range", pa.int32()), ("place", pa.int32()), ("text", pa.string()), *_ARROW]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results for all but the last document of a sorted range; its first and last text as they are."""
    number, last, rows = TaskContext.get().partitionId(), None, []
    nothing = (None,) * (len(RESULT) - 1)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            doc = Document(doc_id, text)
            rows.append((number, FIRST, text, doc_id, *nothing) if last is None else (number, DONE, None, *compare(last, doc)))
            last = doc
            if len(rows) >= 512:
                yield _batch(rows, _ARROW_MET)
                rows = []
    if last is not None:
        rows.append((number, LAST, last.text, last.doc_id, *nothing))
    if rows:
        yield _batch(rows, _ARROW_MET)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([compare(Document(i, t), Document(None, u)) for i, t, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)], _ARROW)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: the columns of RESULT."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h")]
    met = written(
        spark,
        texts.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(_in_order, _MET),
        "fingerprints",
    )
    ranges = sorted(r["range"] for r in met.where(F.col("place") == FIRST).select("range").collect())  # one number per range
    follows = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)) or [(0, 0)], "range int, _next int")
    firsts = met.where(F.col("place") == FIRST).select(F.col("range").alias("_next"), F.col("text").alias("_text"))
    lasts = met.where(F.col("place") == LAST).select("range", "doc_id", "text").join(F.broadcast(follows), "range").join(firsts, "_next")
    return met.where(F.col("place") == DONE).select(*_SCHEMA.names).unionByName(lasts.select("doc_id", "text", "_text").mapInArrow(_pairs, _SCHEMA))


def op7(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))
