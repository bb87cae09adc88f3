"""Token ids in bit planes.

Format of a chunk (all integers little-endian): the magic "PCT1"; a header of five uint32: kind of planes (1: bit
planes, 8: byte planes), ids per block, number of ids, number of documents, number of blocks; the document index, one
uint32 length per document, compressed; the block index, one (uint32 offset, uint8 planes) per block; and the blocks.
A block holds a fixed number of ids (the last one of a chunk may hold fewer), transposed: plane k has bit (byte) k of every id. Each plane is compressed
with zstandard by itself and stands behind its uint32 length; planes above the block's highest bit are not stored. So a
reader gets any block, and any document, of a chunk without touching the others.

A data set is a folder with the Parquet table `chunks` (shard, chunk, doc_ids, n_ids, data): whole documents in each
chunk, in ascending doc_id order over shards and chunks; doc_ids says which document is where. Spark's committed writes
make a data set survive lost executors, and any store that Spark reaches will hold it.

Defined results: a null or empty text has only the end id; equal doc_ids stand next to each other, ordered by their
ids' checksum and bytes, and null doc_ids come first; an empty table gives an empty data set; further columns do not matter, only
doc_id and text are read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from prismcat.llm.common import fresh_path, read, worker_cache
from prismcat.llm.pieces import PieceCache, slices

MAGIC, BLOCK, LEVEL = b"PCT1", 8192, 3
#: A chunk is closed when it has so many ids (one very long document can make it longer).
CHUNK_IDS = 1 << 18
#: The id that ends each document.
END_ID = 2
#: Bytes of input for each shard, about; below as many shards as there are shuffle partitions, so many at least.
SHARD_BYTES, SMALL_SHARD = 1 << 28, 1 << 20
#: Stands for a null id among the bounds.
NULL_ID = -(1 << 63)


def bit_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """Planes of a block from the lowest to the highest that holds anything."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == 1:
        narrow = ids.astype("<u2") if top <= 16 else ids.astype("<u4")
        bits = np.unpackbits(narrow.view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little")[:, :top]
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        return [row.tobytes() for row in packed]
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((top + 7) // 8)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    """The block of n ids that has these planes."""
    if kind == 1:
        width = 16 if len(planes) <= 16 else 32
        bits = np.zeros((width, n), np.uint8)
        for k, plane in enumerate(planes):
            bits[k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(f"<u{width // 8}").reshape(-1).astype("<u4")
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        raw[:, k] = np.frombuffer(plane, np.uint8)
    return raw.view("<u4").reshape(-1)


def write_chunk(docs: list[bytes], *, kind: int = 1, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """A chunk of whole documents, each given as its ids in little-endian unsigned 32-bit integers."""
    packer = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(docs), "<u4")
    lengths = packer.compress(np.asarray([len(d) // 4 for d in docs], "<u4").tobytes())
    starts = range(0, len(ids), block)
    bodies, index, at = [], [], 0
    for start in starts:
        planes = [packer.compress(p) for p in bit_planes(ids[start : start + block], kind)]
        body = b"".join(struct.pack("<I", len(p)) + p for p in planes)
        index.append(struct.pack("<IB", at, len(planes)))
        bodies.append(body)
        at += len(body)
    head = MAGIC + struct.pack("<5I", kind, block, len(ids), len(docs), len(starts)) + struct.pack("<I", len(lengths))
    return b"".join([head, lengths, *index, *bodies])


class Chunk:
    """Reader of a chunk: blocks and documents by number."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a chunk of token ids")
        self.data = data
        self.kind, self.block, self.n_ids, self.n_docs, self.n_blocks, size = struct.unpack_from("<6I", data, 4)
        at = 28
        self.unpacker = zstandard.ZstdDecompressor()
        self.lengths = np.frombuffer(self.unpacker.decompress(data[at : at + size]), "<u4")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        at += size
        self.index = [struct.unpack_from("<IB", data, at + 5 * k) for k in range(self.n_blocks)]
        self.body = at + 5 * self.n_blocks

    def block_ids(self, k: int) -> np.ndarray:
        offset, n_planes = self.index[k]
        at, planes = self.body + offset, []
        for _ in range(n_planes):
            (size,) = struct.unpack_from("<I", self.data, at)
            planes.append(self.unpacker.decompress(self.data[at + 4 : at + 4 + size]))
            at += 4 + size
        return from_planes(planes, min(self.block, self.n_ids - k * self.block), self.kind)

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the chunk; only the blocks that hold them are read."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        ids = np.concatenate([self.block_ids(k) for k in range(first, last + 1)])
        return ids[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> list[np.ndarray]:
        return np.split(self.span(0, self.n_ids), self.starts[1:-1]) if self.n_docs else []


def piece_cache(path: str) -> PieceCache:
    """One per worker and tokenizer file."""
    kept = worker_cache("token files")
    if path not in kept:
        kept[path] = _library_cache(path)
    return kept[path]


def _library_cache(path: str) -> PieceCache:
    """The library encodes, each new word once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    if suffix:
        last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def each(words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(words: list[str]) -> list[bytes]:
        """Words of letters go to the library many at a time: word-end tokens tell their ids apart."""
        if not suffix:
            return each(words)
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        found = dict(zip(others, each(others), strict=True))
        for k in range(0, len(letters), 500):
            some = letters[k : k + 500]
            ids = np.asarray(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(some):  # each word has one end at least, so exactly one
                data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                found.update((w, data[a:b]) for w, a, b in zip(some, at[:-1], at[1:], strict=True))
            else:
                found.update(zip(some, each(some), strict=True))
        return [found[w] for w in words]

    return PieceCache(encode)


def shard_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """shards - 1 quantiles of doc_id, from a scan of that column alone; null ids are the least."""
    if shards < 2:
        return np.zeros(0, np.int64)
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    found = docs.agg(F.percentile_approx(least, [k / shards for k in range(1, shards)], min(1_000_000, max(10_000, 10 * shards))).alias("q")).first()["q"]
    return np.asarray(found or [], np.int64)


def shard_of(ids: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shards in ascending order of (id, tie). An id that several bounds name is spread over their shards by its ties."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return (low + (ties * (high - low + 1)).astype(np.int64)).astype(np.int32)


def tokenize(docs: DataFrame, path: str, bounds: np.ndarray, end_id: int = END_ID) -> DataFrame:
    """shard, doc_id, tie and ids (zstandard over little-endian uint32, with the end id) of each document, unshuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = piece_cache(path), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = cache.encode(batch.column(1))
                ids = np.insert(ids, at[1:], end_id).astype("<u4")  # behind each document
                at = at + np.arange(len(at))
                data = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                ties = np.fromiter((zlib.crc32(x) for x in data), np.float64, len(data)) / 2**32
                names = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard_of(names, ties, bounds)), batch.column(0), pa.array(ties), pa.array([packer.compress(x) for x in data], pa.binary())],
                    names=["shard", "doc_id", "tie", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "shard int, doc_id long, tie double, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, kind: int = 1, block: int = BLOCK, chunk_ids: int = CHUNK_IDS, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encodes docs and writes the data set at path.

    Texts are encoded where they are read; only ids, compressed, move, once, to shards that are ranges of doc_id (and of
    a hash, so that no repeated id holds up a task), and are sorted within each.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or (most if size > 1 << 50 else max(1, size // SHARD_BYTES, min(most, size // SMALL_SHARD)))
    order = [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("ids")]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, shard = 0, 0, None
        ids: list[bytes] = []
        names: list[int | None] = []
        unpacker = zstandard.ZstdDecompressor()

        def close() -> pa.RecordBatch:
            data = write_chunk(ids, kind=kind, block=block)
            return pa.RecordBatch.from_pydict({"shard": [shard], "chunk": [number], "doc_ids": [names], "n_ids": [size], "data": [data]}, schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for into, doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if into != shard:
                    if names:
                        yield close()
                    number, size, ids, names, shard = 0, 0, [], [], into
                ids.append(unpacker.decompress(packed))
                names.append(doc)
                size += len(ids[-1]) // 4
                if size >= chunk_ids:
                    yield close()
                    number, size, ids, names = number + 1, 0, [], []
        if names:
            yield close()

    (
        tokenize(docs, tokenizer, shard_bounds(docs, shards), end_id)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions(*order)
        .mapInArrow(chunks, "shard int, chunk int, doc_ids array<bigint>, n_ids bigint, data binary")
        .write.parquet(f"{path}/chunks")
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document, from the files alone.

    The ids before each chunk are summed over one small row per chunk; documents never move.
    """
    chunks = spark.read.schema("shard int, chunk int, doc_ids array<bigint>, n_ids bigint, data binary").parquet(f"{path}/chunks")
    sums = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row per shard
    base, at = {}, 0
    for r in sums:
        base[r["shard"]] = at
        at += r["n"]
    # Within a shard, chunks are summed on (shard, chunk, n_ids) only: a few bytes per chunk.
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.select("shard", "chunk", "n_ids").withColumn("_at", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    starts = spark.createDataFrame(list(base.items()) or [(0, 0)], "shard int, _base long")
    offsets = offsets.join(F.broadcast(starts), "shard").select("shard", "chunk", (F.col("_base") + F.col("_at")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, data, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                chunk = Chunk(data)
                docs = chunk.documents()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(first + chunk.starts[:-1], pa.int64()), pa.array(chunk.lengths.astype(np.int64)), pa.array([d.astype("<u4").tobytes() for d in docs], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    # Offsets are a few bytes for a quarter of a million ids; their number is checked before they are broadcast.
    small = F.broadcast(offsets) if chunks.count() <= 200_000 else offsets
    return chunks.join(small, ["shard", "chunk"]).select("doc_ids", "data", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def with_crc(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-files")
    write_token_files(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_crc(read_token_files(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
