"""Every pipeline stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stage_on_odd_rows(spark, data, name, stage):
    docs = spark.read.parquet(f"{data('sf0.001')}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, "text without an id", "en", "src1", 5), (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "word " * 30000, "en", "src1", 150000), (9004, "a b c d e f g h", None, None, None), (9004, "a b c d e f g h", None, None, None)],
        docs.schema)
    both = docs.unionByName(odd).withColumns({c: F.lit("clash") for c in ("score", "size", "ids", "n_shingles", "extra")})
    rows = stage(spark, both, data("sf0.001")).collect()
    assert rows
    if name == "quality_classifier":
        assert not {9001, 9002} & {r["doc_id"] for r in rows}
    if name != "bpe":
        assert rows[0].asDict().keys() == set(C.COLUMNS)
    else:
        by = {r["doc_id"]: r["n_tokens"] for r in rows}
        assert len(rows) == 46 and by[9001] == by[9002] == 0 and by[9003] == 30000
    if name == "ngram_jaccard":
        kept = [r["doc_id"] for r in rows]
        assert {None, 9001, 9002, 9003, 9004} <= set(kept)
    if name == "mix_sources":
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in both.collect()}
    empty = stage(spark, docs.limit(0), data("sf0.001"))
    assert empty.count() == 0
