"""Ordered work gives the same rows whether a group fits one task or is cut into slices."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulse.operators import ordered

HOT = 30


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows, one is null; values and times repeat and may be null."""
    chance = random.Random(7)
    table = []
    for i in range(300):
        key = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{chance.randrange(60)}"
        value = None if chance.random() < 0.4 else chance.randrange(10)
        table.append((i, key, chance.randrange(8), value))
    return spark.createDataFrame(table, "id long, key string, at int, value int").repartition(6)


def same(first, second):
    assert first.columns == second.columns
    assert sorted(map(tuple, first.collect()), key=repr) == sorted(map(tuple, second.collect()), key=repr)


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("order", [["at", "id"], ["-at", "-id"], ["value", "-id"]])
def test_row_number(rows, keys, order):
    same(
        ordered.with_row_number(rows, keys, order, hot_rows=HOT),
        ordered.with_row_number(rows, keys, order),
    )


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("order", [["at", "id"], ["-at", "id"]])
def test_lag(rows, keys, order):
    columns = {"before": "value", "before_at": "at"}
    same(ordered.with_lag(rows, keys, order, columns, HOT), ordered.with_lag(rows, keys, order, columns))


def test_large_helper_tables_are_shuffled(rows, monkeypatch):
    plain = ordered.with_lag(rows, ["key"], ["at", "id"], {"before": "value"})
    monkeypatch.setattr(ordered, "HELPER_ROWS", 0)
    same(ordered.with_lag(rows, ["key"], ["at", "id"], {"before": "value"}, HOT), plain)


@pytest.mark.parametrize("keys", [["key"], []])
def test_fill(rows, keys):
    order = ["at", "id"]
    same(ordered.with_fill(rows, keys, order, ["value"], HOT), ordered.with_fill(rows, keys, order, ["value"]))


@pytest.mark.parametrize("keys", [["key"], []])
def test_running_total(rows, keys):
    args = (keys, ["at", "id"], "id", "total")
    same(ordered.with_running_total(rows, *args, HOT), ordered.with_running_total(rows, *args))


def test_hot_groups_span_slices(rows):
    slices = []

    def count(part, attach):
        slices.append(part.groupBy("key").agg(F.count_distinct("_slice").alias("n")).where("key = 'hot'").first()["n"])
        return part

    ordered._by_size(rows, ["key"], ["at", "id"], lambda part: part, count, HOT)
    assert slices[0] > 1


def test_first_per_group_limits_before_the_shuffle(rows):
    plan = ordered.first_per_group(rows, ["key"], ["at", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("hot_rows", [HOT, ordered.HOT_ROWS])
def test_pages_hold_every_item_in_order(rows, hot_rows):
    pages = ordered.paged_lists(rows, ["key"], ["at", "id"], {"ids": "id"}, 7, hot_rows).collect()
    joined: dict = {}
    for page in sorted(pages, key=lambda p: p["page"]):
        assert len(page["ids"]) <= 7
        joined.setdefault(page["key"], []).extend(page["ids"])
    expected: dict = {}
    for row in sorted(rows.collect(), key=lambda r: (r["at"], r["id"])):
        expected.setdefault(row["key"], []).append(row["id"])
    assert joined == expected
