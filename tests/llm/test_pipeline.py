"""The pipeline stage by stage: what each decides follows from its operator on its own input."""

import corpus_pipeline as pipeline
from ledgerloom.llm import decontamination, near_duplicates
from ledgerloom.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept.append(docs)
    assert all(frame.columns == columns for frame in kept[:-1])
    known, deduplicated, clean, mixed, sharded = kept
    groups = near_duplicates.near_duplicates(known, k=5).select("component_id").distinct().count()
    assert deduplicated.count() == groups
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontamination.decontaminate(deduplicated, benchmark)
    assert clean.count() == judged.where("not contaminated").count() < deduplicated.count()
    assert mixed.count() <= clean.count() and mixed.count() > 0.9 * clean.count()
    assert {r.doc_id for r in sharded.select("doc_id").collect()} == {r.doc_id for r in mixed.select("doc_id").collect()}
