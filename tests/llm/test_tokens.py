"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismcat.llm import bpe as B, token_files as K

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(6)
    alphabet = list("aAbéßΣς \n\t'sstre!<|>endoftx01．ﬁÀẞｱİIKΑ²Ⅷ각ᄀ🙂") + ["\u0300", "\u0345", "\u3099", "\x85", "\u3000", "\x1c", "\x00", "<|endoftext|>", "'re", "\u200b"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    return made + ["", " ", "x" * 3000, "ab" * 2000 + " é" * 9, "It's we'LL I'm", "<|startoftext|>a<|endoftext|>", "foo'!!bar", "it's, it's", "İ|x", "1234 ½"]


def naive(bpe, ids):
    ids = list(ids)
    while True:
        ranks = [bpe.merges.get(p, (B.NONE,))[0] for p in zip(ids, ids[1:])]
        if not ranks or min(ranks) == B.NONE:
            return ids
        k = ranks.index(min(ranks))
        ids[k : k + 2] = [bpe.merges[ids[k], ids[k + 1]][1]]


def test_segment_tree_merges_like_the_naive_loop():
    bpe, rng = B.Bpe(B.default_path()), random.Random(7)
    for _ in range(400):
        word = "".join(rng.choice("etaoinsh!12") for _ in range(rng.randint(1, 30)))
        ids = [bpe.vocab[c] for c in word]
        assert bpe.merge(ids) == naive(bpe, ids)


def test_segment_tree():
    rng = random.Random(8)
    values = [rng.randrange(20) for _ in range(37)]
    tree = B.SegmentTree(list(values))
    for _ in range(200):
        assert tree.lowest == min(values) and tree.first_lowest() == values.index(min(values))
        k = rng.randrange(37)
        values[k] = rng.randrange(20)
        tree.update(k, values[k])


def test_encode_and_decode_equal_the_library(library):
    bpe, texts = B.Bpe(B.default_path()), odd_texts()
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.encode(t) for t in texts] == expected
    for _ in range(2):
        assert [x.tolist() for x in bpe.pieces.encode_batch(texts)] == expected
    assert [bpe.decode(x) for x in expected] == [library.decode(x, skip_special_tokens=False) for x in expected]
    cache = K._library_cache(P.path("word_bpe_49k.json"))
    assert [x.tolist() for x in cache.encode_batch(texts)] == expected
    assert [x.tolist() for t in texts for x in cache.encode_batch([t])] == expected


def test_small_tables_forget_and_still_agree(library):
    cache = K._library_cache(P.path("word_bpe_49k.json"))
    cache.limit = 50
    texts = odd_texts()
    assert [x.tolist() for x in cache.encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_query_equals_the_library(spark, data, library):
    rows = {r["doc_id"]: r for r in B.op3(spark, data("sf0.001")).collect()}
    for r in spark.read.parquet(f"{data('sf0.001')}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        got = rows.pop(r["doc_id"])
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not rows


def test_bpe_rows_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 2.0), (None, "", "y", None), (3, "hi", "z", 1.0), (3, "hi", "z", 1.0)], "doc_id long, text string, ids string, extra double")
    rows = B.bpe_round_trip(df, B.default_path()).collect()
    assert [r["n_tokens"] for r in rows] == [0, 0, 1, 1] and [r["decoded"] for r in rows] == ["", "", "hi</w>", "hi</w>"]
    assert rows[0].asDict().keys() == {"doc_id", "text", "extra", "n_tokens", "ids", "decoded"}
    assert B.bpe_round_trip(df.limit(0), B.default_path()).count() == 0


@pytest.mark.parametrize("kind", [1, 8])
def test_chunks_round_trip(kind):
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, top, size=n, dtype=np.uint32) for n, top in ((0, 9), (1, 2), (5000, 49407), (3, 1), (17, 2**32 - 1), (300, 70000), (0, 2))]
    data = K.write_chunk([d.astype("<u4").tobytes() for d in docs], kind=kind, block=64)
    chunk = K.Chunk(data)
    assert [d.tolist() for d in chunk.documents()] == [d.tolist() for d in docs]
    assert [chunk.document(k).tolist() for k in range(len(docs))] == [d.tolist() for d in docs]
    assert np.concatenate([chunk.block_ids(k) for k in range(chunk.n_blocks)]).tolist() == np.concatenate(docs).tolist()
    assert K.Chunk(K.write_chunk([b""], kind=kind)).documents()[0].tolist() == []
    with pytest.raises(ValueError):
        K.Chunk(b"nothing of the kind")


def test_token_files_equal_the_library(spark, data, library):
    docs = spark.read.parquet(f"{data('sf0.001')}/documents.parquet").orderBy("doc_id").collect()
    start, expected = 0, []
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in K.op2(spark, data("sf0.001")).collect()) == expected


def test_shards_keep_the_order_and_spread_ties():
    rng = np.random.default_rng(13)
    ids = np.sort(np.where(rng.random(5000) < 0.4, 77, rng.integers(0, 1000, 5000)))
    ties = rng.random(5000)
    order = np.lexsort((ties, ids))
    shard = K.shard_of(ids[order], ties[order], np.quantile(ids, np.arange(1, 16) / 16, method="nearest").astype(np.int64))
    assert (np.diff(shard) >= 0).all() and np.bincount(shard).max() < 900


def test_token_files_odd_rows(spark, tmp_path, library):
    rows = [(5, "b b", 1), (None, "n", 1), (5, "a", 2), (5, "a", 2), (1, None, 3), (2, "", 4), (9, "w " * 3000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    path = f"file://{tmp_path}/set"
    K.write_token_files(df, path, B.default_path(), chunk_ids=10, block=4, shards=3)
    got = K.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 5, 5, 5, 9]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert np.frombuffer(got[1]["ids"], "<u4").tolist() == [2] and got[6]["n_tokens"] == 3001
    K.write_token_files(df.limit(0), f"file://{tmp_path}/none", B.default_path())
    assert K.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
