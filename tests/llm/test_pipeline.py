from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ("copy", "rate", "source_size", "_spans", "its_spans", "_source", "of_source", "component", "seed", "dig", "total")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, edges, nothing, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = edges.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
    out = f(spark, docs, SF)
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.schema.simpleString() == docs.schema.simpleString()
        for r in out.collect():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHING) and r["size"] == r["copies"] == r["target"] == 1
    assert f(spark, nothing, SF).count() == 0


def test_the_pipeline_by_its_rules(spark):
    out = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out and out <= {r.doc_id for r in docs.select("doc_id").collect()}
