"""What the plans must and must not contain, whatever the size of the data."""

import pytest

import __spark_entry__ as entry
from tests.compare import TESTDATA
from weftline.operators import corpus as C
from weftline.operators import packing as P
from weftline.operators import prefix as X
from weftline.plans.corpus import documents

SF = f"{TESTDATA}/sf0.001"
QUERIES = {key: query for plan in entry.plans() for key, query in plan.QUERIES.items()}
STREAMS = [k for k in QUERIES if k.startswith("stream_")]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in STREAMS])
def test_no_pairwise_joins_and_no_row_at_a_time_python(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{key} has {bad}"


def test_text_scan_is_pruned_and_filtered(spark):
    plan = plan_of(C.corpus_totals(spark.read.parquet(f"{SF}/documents.parquet")))
    assert "ReadSchema: struct<text:string>" in plan
    assert "IsNotNull(text)" in plan and "Not(EqualTo(text,))" in plan


def test_range_totals_do_not_read_ids(spark):
    docs = documents(spark, SF)
    encoded = C.encoded_corpus(docs, C.native_encoder(C.vocabulary(docs)))
    plan = plan_of(C.token_spans(encoded))
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan  # the totals' branch
    assert plan.count("Exchange hashpartitioning(_range") == 2  # ids once, totals once
    blocks = plan_of(P.overlapping_blocks(C.token_spans(encoded), 128))
    assert blocks.count("hashpartitioning(block_id") == 1


def test_large_groups_are_never_one_window_partition(spark, monkeypatch):
    monkeypatch.setattr(X, "ROWS_PER_RANGE", 10)
    frame = spark.range(200).selectExpr("id AS o", "1L AS v", "IF(id % 3 = 0, id, 0) AS g")
    plan = plan_of(X.running_total(frame, "o", "v", "t", ["g"]))
    assert "_range" in plan and "BroadcastHashJoin [g" in plan
    monkeypatch.setattr(X, "ROWS_PER_RANGE", 1000)
    assert "_range" not in plan_of(X.running_total(frame, "o", "v", "t", ["g"]))


def test_a_short_range_prunes_the_scan(spark, monkeypatch):
    monkeypatch.setattr(X, "WEIGHT_PER_RANGE", 5_000)
    docs = documents(spark, SF)
    encoded = C.encoded_corpus(docs, C.native_encoder(C.vocabulary(docs)))
    plan = plan_of(C.spans_within(encoded, 30_000, 31_000))
    assert "GreaterThanOrEqual(doc_id" in plan and "LessThanOrEqual(doc_id" in plan
