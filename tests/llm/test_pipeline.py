"""The pipeline as a whole: its stages chain, and its parts survive without each other."""

from collections import Counter

import corpus_pipeline as cp

from millrace.llm import linedup, mixing, neardup
from millrace.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    at, seen = docs, {}
    for name, stage in cp.STAGES:
        got = stored(stage(spark, at, SF))
        seen[name] = (at, got)
        at = got
        if name != "packing":
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
    before, after = seen["line_dedup"]
    want = {r.doc_id: r.text for r in linedup.dedup_lines(before).collect() if (r.text or "").strip()}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in neardup.classes(before).collect()}
    before, after = seen["mixing"]
    assert Counter(r.doc_id for r in after.collect()) == Counter({r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies})
    before, after = seen["packing"]
    assert after.filter("start = 0").count() == before.count()
    assert cp.run(spark, SF).count() == after.count()


def test_stages_on_odd_rows(spark, odd, nothing):
    for docs in (odd, nothing):
        at = docs
        for name, stage in cp.STAGES:
            at = stored(stage(spark, at, SF))
            assert name == "packing" or at.columns == docs.columns
