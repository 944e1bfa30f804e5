"""Every registered query of the library's own plans against its SQL, and the published result rows."""

import csv
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import TESTDATA, differences, duck
from weftline.operators import results as R

SF = f"{TESTDATA}/sf0.001"
QUERIES = {key: query for plan in entry.plans() for key, query in plan.QUERIES.items()}
SQL = {key: sql for plan in entry.plans() for key, sql in plan.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= SQL.keys()


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_sql(spark, con, key):
    assert differences(QUERIES[key](spark, SF).toPandas(), con.execute(SQL[key]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def published(spark):
    """Result rows recorded beside the survey."""
    path = os.path.join(os.path.dirname(__file__), "..", "FIXTURES.md")
    block = re.search(r"```csv\n(.*?)```", open(path).read(), re.S).group(1)
    rows = list(csv.DictReader(block.splitlines()))
    number = lambda v, kind: kind(v) if v else None
    data = [
        (r["file"], r["model"], int(r["step"]), number(r["tokens"], int), *[number(r[t], float) for t in R.TASKS]) for r in rows
    ]
    schema = "source string, model string, step long, tokens long, " + ", ".join(f"{t} double" for t in R.TASKS)
    return spark.createDataFrame(data, schema)


def test_published_token_mismatches(published):
    found = R.token_mismatches(published).collect()
    assert sorted(r.excess for r in found) == [376_832, 389_120, 524_288]
    assert {(r.source, r.step) for r in found} == {("p1", 9536)}
    assert R.fill_tokens(published).where("tokens IS NULL").count() == 0


def test_published_convergence(published):
    """First step at which the second model passes the first one's final score."""
    base = published.where("source = 'p1' AND model = 'transformer'")
    limit = R.final_rows(base, ["model"]).select(F.lit("lambada").alias("task"), F.col("lambada").alias("threshold"))
    steps = {}
    for source in ("p1", "p1v2"):
        long = R.to_long(published.where(F.col("source") == source)).where("task = 'lambada'")
        reached = R.first_step_reaching(long, limit, ["task"])
        steps[source] = min(r.first_step for r in reached.where("model <> 'transformer'").collect() if r.first_step)
    assert steps == {"p1": 4000, "p1v2": 2000}


def test_published_final_rows(published):
    finals = R.final_rows(published.where("source IN ('p1', 'p3')"), ["source", "model"])
    assert finals.count() == 8 and finals.where("step < 9536").count() == 0
