"""Upserts against a row-by-row model of the stored tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulse import schemas
from pulse.operators import mutate

KEYS = ["facebook_link", "facebook_interactions", "source"]


def frame(spark, rows):
    table = [
        (dt.datetime(2024, 1, 1), "h", "s", f"l{key}", f"fb{key}", "p", "d", count, source) for key, count, source in rows
    ]
    return spark.createDataFrame(table, schemas.NEWS_DATA)


def state(df):
    return sorted(tuple(r) for r in df.select(*KEYS).collect())


def apply(stored: dict, batch: list, source: str) -> dict:
    """Load one file into ``{key: (count, source)}``."""
    kept = {k: v for k, v in stored.items() if v[1] != source}
    best: dict = {}
    for key, count, _ in batch:
        best[key] = max(count, best.get(key, count))
    for key, count in best.items():
        if key not in kept or count >= kept[key][0]:
            kept[key] = (count, source)
    return kept


def as_state(stored: dict):
    return sorted((f"fb{k}", count, source) for k, (count, source) in stored.items())


@pytest.mark.parametrize("seed, batch_rows", [(0, 1000), (1, 1000), (2, 2)])
def test_files_one_by_one(spark, seed, batch_rows):
    chance = random.Random(seed)
    stored: dict = {}
    table = spark.createDataFrame([], schemas.NEWS_DATA)
    for name in ("a.csv", "b.csv", "a.csv", "c.csv"):
        batch = [(chance.randrange(12), chance.randrange(5), name) for _ in range(10)]
        table = mutate.upsert_scan(table, frame(spark, batch).drop("source"), name, batch_rows)
        stored = apply(stored, batch, name)
        assert state(table) == as_state(stored)


@pytest.mark.parametrize("batch_rows", [1000, 8, 5, 1])
def test_any_bound_merges_alike(spark, batch_rows):
    """Stored and batch keys that repeat or are null, with bounds that take every way of the merge."""
    chance = random.Random(5)
    pick = lambda n, name: [(chance.choice([None, *range(9)]), chance.randrange(4), name) for _ in range(n)]
    keyed = lambda rows: frame(spark, rows).withColumn("facebook_link", F.expr("nullif(facebook_link, 'fbNone')"))
    for held, new in ((pick(20, "a"), pick(12, "b")), (pick(20, "a"), [(k, 9, "b") for k in range(9)]), (pick(9, "a"), [(k, -1, "b") for k in range(9)])):
        done = mutate.upsert_new_scans(keyed(held), keyed(new), batch_rows)
        best: dict = {}
        for key, count, _ in new:
            best[key] = max(count, best.get(key, count))
        kept = [r for r in held if r[0] is None or r[0] not in best or r[1] > best[r[0]]]
        beaten = {r[0] for r in held if r[0] in best and r[1] > best[r[0]]} - {None}
        wanted = kept + [(k, c, "b") for k, c in best.items() if k not in beaten]
        found = [(r["facebook_link"] or "fbNone", r["facebook_interactions"], r["source"]) for r in done.collect()]
        assert sorted(found) == sorted((f"fb{k}", c, s) for k, c, s in wanted)


@pytest.mark.parametrize("batch_rows", [1000, 5, 1])
def test_new_rows_are_those_a_merge_puts_in(spark, batch_rows):
    chance = random.Random(9)
    pick = lambda n, name: [(chance.choice([None, *range(12)]), chance.randrange(5), name) for _ in range(n)]
    keyed = lambda rows: frame(spark, rows).withColumn("facebook_link", F.expr("nullif(facebook_link, 'fbNone')"))
    for held, new in ((pick(14, "a"), pick(14, "b")), ([], pick(14, "b")), (pick(14, "a"), [(k, -1, "b") for k in range(12)])):
        target, batch = keyed(held), keyed(new)
        merged = mutate.upsert_new_scans(target, batch, batch_rows).where("source = 'b'")
        found = mutate.new_rows(target, batch, mutate.batch_keys(batch), batch_rows)
        assert found.columns == schemas.NEWS_DATA.names
        assert sorted(map(str, found.collect())) == sorted(map(str, merged.collect()))


def test_loading_twice_changes_nothing(spark):
    target = frame(spark, [(1, 5, "a"), (2, 9, "a")])
    batch = frame(spark, [(1, 5, "b"), (2, 3, "b"), (3, 1, "b"), (3, 4, "b")]).drop("source")
    once = mutate.upsert_scan(target, batch, "b")
    assert state(once) == [("fb1", 5, "b"), ("fb2", 9, "a"), ("fb3", 4, "b")]
    assert state(mutate.upsert_scan(once, batch, "b")) == state(once)


def test_new_files_in_one_pass_equal_one_by_one(spark):
    chance = random.Random(3)
    target = frame(spark, [(k, chance.randrange(5), "old") for k in range(8)])
    files = {n: [(chance.randrange(12), chance.randrange(5), n) for _ in range(9)] for n in ("a", "b", "c")}
    together = mutate.upsert_new_scans(target, frame(spark, [r for rows in files.values() for r in rows]))
    apart = target
    for name, rows in files.items():
        apart = mutate.upsert_scan(apart, frame(spark, rows).drop("source"), name)
    assert state(together) == state(apart)


def test_deleting_a_file_leaves_keys_a_newer_file_won(spark):
    table = frame(spark, [(1, 5, "a"), (2, 5, "a")])
    table = mutate.upsert_scan(table, frame(spark, [(1, 6, "b")]).drop("source"), "b")
    table = mutate.delete_sources(table, ["a"])
    assert state(table) == [("fb1", 6, "b")]
    again = mutate.upsert_scan(table, frame(spark, [(1, 2, "b")]).drop("source"), "b")
    assert state(again) == [("fb1", 2, "b")]


def test_unknown_source_is_never_deleted(spark):
    assert state(mutate.delete_sources(frame(spark, [(1, 1, None)]), ["a"])) == [("fb1", 1, None)]


def test_replace_by_key_keeps_keys_unique(spark):
    def labels(rows):
        return spark.createDataFrame([(f"l{k}", f"fb{k}", ["t"], ["i"], s) for k, s in rows], schemas.NEWS_LABELS)

    done = mutate.replace_by_key(labels([(1, "old"), (2, "old")]), labels([(2, "new"), (3, "new")]))
    assert sorted((r["facebook_link"], r["subindex"]) for r in done.collect()) == [
        ("fb1", "old"),
        ("fb2", "new"),
        ("fb3", "new"),
    ]
    fresh = spark.createDataFrame([("fb1", None), ("fb9", "x")], "facebook_link string, subindex string")
    updated = mutate.update_from(done, fresh)
    assert sorted((r["facebook_link"], r["subindex"]) for r in updated.collect()) == [
        ("fb1", None),
        ("fb2", "new"),
        ("fb3", "new"),
    ]
