"""The pipeline's stages keep the columns, act on what the one before kept, and end in a valid packing."""

import collections

import corpus_pipeline as cp
from dpframe.llm import decontaminate, near_dedup
from dpframe.llm.common import read, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now < ids | {None} and now, name
        ids = now
    assert near_dedup.near_duplicates(docs)[0].where("doc_id <> class_id").count() == 0
    assert decontaminate.contamination(docs, read(spark, SF, "benchmark")).where("contaminated").count() == 0
    rows = cp.packing_stage(spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} == ids
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


def test_odd_rows_pass_every_stage(spark, odd, none):
    for df in (odd, none):
        docs = df
        for _, stage in cp.STAGES:
            docs = written(stage(spark, docs, SF), "stage")
        docs.count()
