"""Rollups against the raw rows, batch by batch."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pulse.operators import rollup

ROWS = "at timestamp, theme string, labels array<string>, who string, facebook_interactions long"


def make(rng, n):
    names = ["a", "b", "c", None]
    rows = []
    for _ in range(n):
        day = rng.choice([None, *(dt.datetime(2024, 1, d, rng.randrange(24)) for d in range(1, 9))])
        labels = rng.choice([None, [], ["x"], ["x", "y"], ["y", None], ["x", "x"]])
        rows.append((day, rng.choice(names), labels, rng.choice([None, *(f"w{i}" for i in range(40))]), rng.choice([None, 0, 5, 17])))
    return rows


def build(spark, path, batches):
    for name, rows in batches:
        frame = spark.createDataFrame(rows, ROWS)
        table = rollup.add(spark, path, frame, name, "at", {"theme": "theme", "labels": "labels"}, {"": ["who", "labels"], "labels": ["who"]}, buckets=4)
    return table


@pytest.mark.parametrize("first, last", [(None, None), ("2024-01-02", "2024-01-05"), ("2024-01-08", None), ("2025-01-01", None)])
def test_ranges_equal_the_raw_rows(spark, tmp_path, first, last):
    rng = random.Random(1)
    batches = [("one", make(rng, 80)), ("two", make(rng, 60)), ("none", []), ("three", make(rng, 1))]
    table = build(spark, str(tmp_path / "r"), [*batches, batches[1]])
    rows = [r for _, b in batches for r in b]
    kept = [r for r in rows if (first is None or r[0] and str(r[0].date()) >= first) and (last is None or r[0] and str(r[0].date()) <= last)]
    cells = rollup.between(table.read(), first, last)
    got = rollup.kpis(cells, {"n_who": "who", "n_labels": "labels"}).first()
    known = [r[4] for r in kept if r[4] is not None]
    assert got.n_articles == len(kept) and (got.sum_interactions or 0) == sum(known)
    assert got.n_who == len({r[3] for r in kept} - {None})
    assert got.n_labels == len({x for r in kept for x in r[2] or []} - {None})
    assert got.mean_interactions == (round(sum(known) / len(known), 2) if known else None)
    for r in rollup.label_stats(cells, "labels", "who").collect():
        mine = [x for x in kept if x[0] and x[0].date() == r.day for label in x[2] or [] if label == r.labels]
        counts = [x[4] for x in mine if x[4] is not None]
        assert r["count"] == len(counts) and r.n_who == len({x[3] for x in mine} - {None})
        assert r.facebook_interactions == (pytest.approx(sum(counts) / len(counts)) if counts else None)


def test_a_batch_touches_the_buckets_of_its_days(spark, tmp_path):
    path = str(tmp_path / "r")
    before = build(spark, path, [("one", [(dt.datetime(2024, 1, d), "a", ["x"], f"w{d}", 1) for d in range(1, 20)])])
    after = build(spark, path, [("two", [(dt.datetime(2024, 1, 3), "a", ["x"], "new", 1)])])
    changed = {b for b in after.held_by if after.held_by[b] != before.held_by.get(b)}
    assert len(changed) == 1 and after.version == before.version + 1
    assert build(spark, path, [("two", [(dt.datetime(2024, 1, 3), "a", ["x"], "new", 1)])]).version == after.version


def test_more_values_than_one_bitmap_holds(spark, tmp_path):
    rows = spark.range(70_000).selectExpr(
        "timestamp'2024-01-01 00:00:00' as at", "'a' as theme", "array('x') as labels", "cast(id % 66000 as string) as who", "1L as facebook_interactions"
    )
    table = rollup.add(spark, str(tmp_path / "r"), rows, "all", "at", {"labels": "labels"}, {"labels": ["who"]}, buckets=2)
    assert rollup.label_stats(table.read(), "labels", "who").first().n_who == 66_000
