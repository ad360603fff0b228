"""Each stage of the pipeline on its own input, against the operator's decisions."""

from collections import Counter

import corpus_pipeline
import pytest
from odd import no_documents, odd_documents

from stockloom.llm import near_text, quality_rules
from stockloom.plans.durable import staged
from stockloom.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    rows = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == columns and not out.exceptAll(out.intersect(table(spark, SF, "documents"))).where("doc_id is null").count()
            rows[name] = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "quality_rules":
            judged = quality_rules.judge_quality(quality_rules.measure_quality(docs)).where("kept").collect()
            assert sorted(rows[name]) == sorted(r.doc_id for r in judged)
        if name == "quality_model":
            assert 0.8 * len(rows["quality_rules"]) < len(rows[name]) <= len(rows["quality_rules"])
        if name == "near_duplicates":
            groups = near_text.near_duplicate_texts(docs).collect()
            assert sorted(rows[name]) == sorted({r.component_id for r in groups})
        if name == "mixing":
            assert set(rows[name]) <= set(rows["near_duplicates"]) and max(Counter(rows[name]).values()) <= 3
        if name == "packing":
            packed = out.toPandas()
            assert Counter(packed[packed.piece == 0].doc_id) == Counter(rows["mixing"])
            assert (packed.groupby("sequence_id").length.sum() <= 2048).all()
        docs = out


def test_run_is_the_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
    of = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    run = corpus_pipeline.run(spark, SF)
    assert of(run) == of(docs) and run.columns == docs.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_stand_odd_and_empty_tables(spark, name, stage):
    for docs in (odd_documents(spark, clashing=True), no_documents(spark)):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in docs.collect()}
        if name in ("near_duplicates", "packing") and docs.take(1):
            assert {r.doc_id for r in rows} >= {1, 6, 7, 10, None}


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
