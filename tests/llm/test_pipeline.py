import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairsight.llm.ngram_join import similar_components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, first = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    sizes = [len(first)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= first and len(ids) == len(set(ids))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "exact_dedup":
            assert docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "").alias("t")).distinct().count() == docs.count()
        if name == "near_dedup":
            assert similar_components(docs, 5, 80).where("component_id <> doc_id").count() == 0
        sizes.append(len(ids))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert {r.copies for r in docs.select("copies").collect()} <= {1, 2}


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
