"""Running totals keep rows with null keys, on either side of the size from which groups are split."""

import pytest

from weftline.operators import prefix


@pytest.mark.parametrize("rows_per_range", [200_000, 10])
def test_null_groups_and_orders_stay(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", rows_per_range)
    rows = [(None if i % 10 == 0 else i % 3, float(i), 1) for i in range(200)]
    got = prefix.running_total(spark.createDataFrame(rows, "g int, o double, v int"), "o", "v", "t", by=["g"]).collect()
    seen: dict = {}
    want = []
    for g, o, _ in rows:
        want.append((g, o, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert sorted(((r.g, r.o, r.t) for r in got), key=str) == sorted(want, key=str)


def test_null_order_comes_first(spark):
    rows = [(None, 5), (1.0, 2), (2.0, 3)]
    got = prefix.running_total(spark.createDataFrame(rows, "o double, v int"), "o", "v", "t").collect()
    assert sorted(((r.o, r.t) for r in got), key=str) == sorted([(None, 0), (1.0, 5), (2.0, 7)], key=str)
