"""The pipeline on small tables: what each stage keeps, and that every stage takes odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ROWS, row

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    whole = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= whole


def test_stages_take_odd_rows(spark, docs, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns and out.count() <= len(ROWS)
            clean = {r.doc_id for r in out.collect()}
            assert {12, 15, None} <= clean, name
        assert stage(spark, nothing, SMALL).count() == 0


def test_stages_take_columns_named_like_their_own_results(spark, docs):
    names = ["_rejected", "_score", "_leaks", "_key", "_blocks", "_deleted", "_chosen_id", "_chosen_text", "_text", "column_1"]
    more = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, SMALL)
        if name == "packing":
            assert out.count() > 0
            continue
        assert out.columns == more.columns and out.dtypes == more.dtypes
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names), name


def test_contaminated_documents_go(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(3).collect()]
    leaked = spark.createDataFrame([row(100 + i, f"before {t} after") for i, t in enumerate(items)], docs.schema)
    out = corpus_pipeline.decontamination_stage(spark, docs.union(leaked), SMALL)
    assert {r.doc_id for r in out.collect()} == {r[0] for r in ROWS}


def test_the_pipeline_packs_what_it_kept(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and all(0 < r.length <= 4096 for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None
