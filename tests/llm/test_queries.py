"""The registered queries of this subpackage: against their SQL, or run whole where SQL cannot express them."""

import pytest

import corpus_pipeline
from tests.compare import TESTDATA, differences, duck
from weftline.llm import queries

SF = f"{TESTDATA}/sf0.001"
#: Held against plain versions or the tokenizers library in the other tests here.
NO_SQL = {"op2_quality", "op3_secrets", "op4_token_files", "op6_token_counts", "op9_mixing", "op10_html_text", "op11_whitening"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_numbers_are_whole():
    assert sorted(int(key[2:].split("_")[0]) for key in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) - set(queries.SQL) == NO_SQL


@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_query_equals_sql(spark, con, key):
    assert differences(queries.QUERIES[key](spark, SF).toPandas(), con.execute(queries.SQL[key]).df()) is None


@pytest.mark.parametrize("key", sorted(NO_SQL))
def test_one_row_for_each_input_row(spark, con, key):
    rows = queries.QUERIES[key](spark, SF)
    table = {"op10_html_text": "pages", "op11_whitening": "embeddings"}.get(key, "documents")
    each = 32 if key == "op11_whitening" else 1
    assert rows.count() == each * con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_no_pairwise_joins_and_no_row_at_a_time_python(spark, key):
    plan = queries.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{key} has {bad}"


def test_native_queries_have_no_python(spark):
    for key in ("op9_mixing", "op13_quality_rules"):
        plan = queries.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "Python" not in plan


def test_pipeline_is_registered():
    assert set(corpus_pipeline.QUERIES) == {"pipeline"} and len(corpus_pipeline.STAGES) == 5
