"""Readers, writers and the stream over real files."""

from __future__ import annotations

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from pulse import schemas
from pulse.plans.checks import adapters
from pulse.sources import files, sinks, sql
from pulse.sources.store import Store
from pulse.streaming import ingest

HEADER = "Domain,Published,Headline,Summary,Link,Link URL,Facebook Page Name,Total Interactions"


def scan(path, *rows, header=HEADER):
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return str(path)


def test_scan_columns_are_found_by_name(spark, tmp_path):
    path = scan(
        tmp_path / "a.csv",
        ',2024-01-01 23:30:00,"two\nlines, ""quoted""",,fb1,l1,page,12',
        "x.com,2024-01-01 00:00:00,h,s,fb2,,page,5",
    )
    row = files.read_scan(spark, path).collect()
    assert len(row) == 1
    assert row[0]["domain"] == "facebook.com"
    assert row[0]["headline"] == 'two\nlines, "quoted"'
    assert row[0]["published"] == dt.datetime(2024, 1, 2, 7, 30)
    assert (row[0]["facebook_link"], row[0]["link"], row[0]["facebook_interactions"]) == ("fb1", "l1", 12)


def test_scan_without_a_column_is_refused(spark, tmp_path):
    path = scan(tmp_path / "a.csv", "x", header="Domain")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_scan(spark, path)


@pytest.mark.parametrize("count", ["", "12.5", "abc"])
def test_malformed_count_fails_the_file(spark, tmp_path, count):
    path = scan(tmp_path / "a.csv", f"x.com,2024-01-01 00:00:00,h,s,fb1,l1,page,{count}")
    with pytest.raises(PySparkException):
        files.read_scan(spark, path).collect()
    good, bad = files.split_malformed_counts(files.read_text_csv(spark, path))
    assert (good.count(), bad.count()) == (0, 1)


def test_scans_keep_their_file_name(spark, tmp_path):
    for name in ("a", "b"):
        scan(tmp_path / f"{name}.csv", f"x.com,2024-01-01 00:00:00,h,s,fb{name},l1,page,1")
    rows = files.read_scan_sources(spark, str(tmp_path)).collect()
    assert {(r["facebook_link"], r["source"]) for r in rows} == {("fba", "a.csv"), ("fbb", "b.csv")}


def test_missing_table_is_empty(spark, tmp_path):
    table = files.read_table(spark, str(tmp_path / "none"), schemas.NEWS_DATA)
    assert table.schema == schemas.NEWS_DATA and table.count() == 0


def test_ledger_and_new_files(spark, tmp_path):
    for name in ("a.csv", "b c.csv"):
        (tmp_path / name).write_text("x")
    loaded = files.ledger(spark, str(tmp_path))
    assert {r["filename"] for r in loaded.collect()} == {"a.csv", "b c.csv"}
    arrived = spark.createDataFrame([("a.csv",), ("new.csv",)], "filename string")
    assert [r["filename"] for r in files.new_files(arrived, loaded).collect()] == ["new.csv"]


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame(
        [("l1", "fb1", "a,b", None, "<&> é"), ("l2", "fb2", None, " x", "line\nbreak")],
        "link string, facebook_link string, themes string, indexes string, subindex string",
    )
    for place, book in enumerate(sinks.to_workbooks(rows, 1).collect()):
        (tmp_path / f"{place}.xlsx").write_bytes(book["content"])
    read = files.read_indexed_xlsx(spark, str(tmp_path))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(PySparkException, match="missing columns"):
        files.read_indexed_xlsx(spark, str(tmp_path), ["absent"]).collect()


def test_labelled_workbook(spark, tmp_path):
    values = ["2024-01-01", "h", "s", "l", "p", "d", "12", "sub", "a.csv"]
    rows = spark.createDataFrame([tuple(values)], ", ".join(f"{c} string" for c in schemas.LABELLED_COLUMNS))
    (tmp_path / "a.xlsx").write_bytes(sinks.to_workbooks(rows).first()["content"])
    row = files.read_labelled_xlsx(spark, str(tmp_path)).first()
    assert row["facebook_interactions"] == 12 and row["subindex"] == "sub"


def test_csv_of_lists_and_run_date(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b"], " edge ")], "themes array<string>, t string")
    path = sinks.write_csv(rows, str(tmp_path / "out"), dt.date(2024, 1, 2))
    assert path.endswith("2024-01-02")
    assert tuple(files.read_text_csv(spark, path).first()) == ("a,b", " edge ")


def test_sql_binds_its_values(spark):
    rows = spark.createDataFrame([("it's",), ("x",)], "t string")
    assert sql.query(spark, "SELECT * FROM {rows} WHERE t = :t", {"rows": rows}, t="it's").count() == 1


def stored(spark, store):
    rows = ingest.stored_table(spark, store).collect()
    return {(r["facebook_link"], r["facebook_interactions"], r["source"]) for r in rows}


def line(key, count):
    return f"x.com,2024-01-01 00:00:00,h,s,fb{key},l{key},page,{count}"


def ingested(spark, tmp_path, progress="progress", **more):
    landing, store = tmp_path / "landing", tmp_path / "store"
    ingest.ingest_scans(spark, str(landing), str(store), str(tmp_path / progress), buckets=8, **more).awaitTermination()
    return stored(spark, str(store))


def bucket_files(store):
    return {p.relative_to(store): p.stat().st_mtime_ns for p in store.rglob("version=*/bucket=*/*.parquet") if "manifest" not in p.parts}


def test_files_arrive_over_time(spark, tmp_path):
    landing, store = tmp_path / "landing", tmp_path / "store"
    landing.mkdir()
    scan(landing / "a.csv", line(1, 5), line(2, 5))
    assert ingested(spark, tmp_path) == {("fb1", 5, "a.csv"), ("fb2", 5, "a.csv")}
    assert ingested(spark, tmp_path) == {("fb1", 5, "a.csv"), ("fb2", 5, "a.csv")}
    scan(landing / "b.csv", line(1, 4), line(2, 6))
    scan(landing / "c.csv", line(3, 1))
    want = {("fb1", 5, "a.csv"), ("fb2", 6, "b.csv"), ("fb3", 1, "c.csv")}
    assert ingested(spark, tmp_path) == want
    # A new progress folder lists all files again; the store knows them.
    before = bucket_files(store)
    assert ingested(spark, tmp_path, "other progress") == want and bucket_files(store) == before
    # So does a batch that runs again.
    table = Store(spark, str(store), schemas.NEWS_DATA, "facebook_link")
    files_there = [(f"file:{p}", dt.datetime.fromtimestamp(p.stat().st_mtime_ns // 10**6 / 1000, dt.UTC), p.stat().st_size) for p in sorted(landing.iterdir())]
    listing = spark.createDataFrame(files_there, "path string, modified timestamp, length long")
    assert ingest.load_files(table, listing.where("path not like '%c.csv'")).version == table.version


def test_a_file_loaded_again_replaces_its_rows(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    scan(landing / "a.csv", line(1, 5), line(2, 5))
    scan(landing / "b.csv", line(7, 1))
    ingested(spark, tmp_path)
    scan(landing / "a.csv", line(1, 2), line(3, 22))
    assert ingested(spark, tmp_path, "fresh") == {("fb1", 2, "a.csv"), ("fb3", 22, "a.csv"), ("fb7", 1, "b.csv")}


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    landing, store = tmp_path / "landing", tmp_path / "store"
    landing.mkdir()
    scan(landing / "a.csv", *(line(k, 5) for k in range(60)))
    ingested(spark, tmp_path)
    before = bucket_files(store)
    table = Store(spark, str(store), schemas.NEWS_DATA, "facebook_link")
    assert table.buckets == 8 and len(table.held_by) == 8
    scan(landing / "b.csv", line(3, 9))
    assert ("fb3", 9, "b.csv") in ingested(spark, tmp_path)
    later = Store(spark, str(store), schemas.NEWS_DATA, "facebook_link")
    changed = table.touched(spark.createDataFrame([("fb3",)], "facebook_link string"))
    assert len(changed) == 1 and {b for b in range(8) if later.held_by[b] != table.held_by[b]} == set(changed)
    assert all(f"/bucket={changed[0]}/" in f for f in table.read(changed).inputFiles())
    assert {f: t for f, t in bucket_files(store).items() if f in before} == before
    assert {f.parts[1] for f in set(bucket_files(store)) - set(before)} == {f"bucket={changed[0]}"}


def rows_written(spark, store):
    """Rows of every version, old ones included."""
    return spark.read.option("basePath", str(store)).parquet(*[str(p) for p in store.glob("version=*")]).count()


def test_a_load_in_batches_writes_each_row_once(spark, tmp_path):
    landing, store = tmp_path / "landing", tmp_path / "store"
    landing.mkdir()
    for n in range(6):
        scan(landing / f"first{n}.csv", *(line(k, 5) for k in range(n, 60, 6)))
    assert ingested(spark, tmp_path, files_per_batch=2) == {(f"fb{k}", 5, f"first{k % 6}.csv") for k in range(60)}
    assert rows_written(spark, store) == 60 and len(list(store.glob("version=*"))) == 3
    for n in range(6):
        scan(landing / f"second{n}.csv", *(line(k, 5 - k % 2) for k in range(n, 60, 6)))
    want = {(f"fb{k}", 5, f"{'first' if k % 2 else 'second'}{k % 6}.csv") for k in range(60)}
    assert ingested(spark, tmp_path, files_per_batch=2) == want
    assert rows_written(spark, store) == 90
    # Batches without a row that goes in write none.
    scan(landing / "third.csv", *(line(k, 1) for k in range(60)))
    assert ingested(spark, tmp_path) == want and rows_written(spark, store) == 90


def test_layers_stay_few_and_equal_one_table(spark, tmp_path, monkeypatch):
    """Keys that repeat, are null or lose, more loads than layers, and at the end a file that came again."""
    monkeypatch.setattr("pulse.sources.store.LAYERS", 3)
    chance, landing, store = random.Random(3), tmp_path / "landing", tmp_path / "store"
    landing.mkdir()
    held, without = {}, []
    for n in range(11):
        name, rows = f"{n:02}.csv", [(chance.choice([None, *range(14)]), chance.randrange(9)) for _ in range(chance.choice([3, 12]))]
        scan(landing / name, *(line(k, c) if k is not None else line("", c).replace(",fb,", ",,") for k, c in rows))
        os.utime(landing / name, (1_700_000_000 + n, 1_700_000_000 + n))
        best = {}
        for key, count in rows:
            best[key] = max(count, best.get(key, count))
        if None in best:
            without.append((None, best.pop(None), name))
        held |= {k: (c, name) for k, c in best.items() if k not in held or c >= held[k][0]}
    rows = ingested(spark, tmp_path, files_per_batch=1)
    assert rows == {(f"fb{k}", c, name) for k, (c, name) in held.items()} | set(without)
    assert ingest.stored_table(spark, str(store)).count() == len(held) + len(without)
    table = Store(spark, str(store), schemas.NEWS_DATA, "facebook_link")
    assert table.version == 10 and max(map(len, table.held_by.values())) <= 2 + 2 + 2
    assert any(len(layers) > 1 for layers in table.held_by.values()) and max(step for layers in table.held_by.values() for _, step in layers) >= 1
    scan(landing / "03.csv", line(20, 1))
    wanted = {r for r in rows if r[2] != "03.csv"} | {("fb20", 1, "03.csv")}
    assert ingested(spark, tmp_path, "fresh") == wanted


def test_gzipped_scans_are_loaded(spark, tmp_path):
    landing = tmp_path / "landing"
    rows = spark.createDataFrame([("x.com", "2024-01-01 00:00:00", 'h "1"\n2', " s ", "fb1", "l1", "page", 7)], [*HEADER.split(",")])
    sinks.write_csv(rows.coalesce(1), str(landing), compression="gzip")
    scan(landing / "plain.csv", line(1, 3), line(2, 4))
    name = next(landing.glob("*.csv.gz")).name
    assert ingested(spark, tmp_path) == {("fb1", 7, name), ("fb2", 4, "plain.csv")}
    row = ingest.stored_table(spark, str(tmp_path / "store")).where("facebook_link = 'fb1'").first()
    assert (row["headline"], row["summary"]) == ('h "1"\n2', " s ")


def test_a_version_without_manifest_does_not_count(spark, tmp_path):
    landing, store = tmp_path / "landing", tmp_path / "store"
    landing.mkdir()
    scan(landing / "a.csv", line(1, 5))
    want = ingested(spark, tmp_path)
    rows = spark.createDataFrame([("fb9",)], "facebook_link string").withColumn("bucket", F.lit(0))
    rows.write.partitionBy("bucket").parquet(str(store / "version=1"))
    assert stored(spark, str(store)) == want
    scan(landing / "b.csv", line(2, 6))
    assert ingested(spark, tmp_path) == want | {("fb2", 6, "b.csv")}


def test_lost_folders_raise(spark, tmp_path):
    landing, store = tmp_path / "landing", tmp_path / "store"
    landing.mkdir()
    scan(landing / "a.csv", line(1, 5))
    ingested(spark, tmp_path)
    shutil.copytree(store, tmp_path / "no rows", ignore=lambda d, names: [n for n in names if n.startswith("bucket=")])
    with pytest.raises(AnalysisException):
        ingest.stored_table(spark, str(tmp_path / "no rows")).collect()
    shutil.copytree(store, tmp_path / "no manifest", ignore=lambda d, names: [n for n in names if n == "manifest"])
    with pytest.raises(FileNotFoundError):
        ingest.stored_table(spark, str(tmp_path / "no manifest"))
    assert ingest.stored_table(spark, str(tmp_path / "nothing yet")).count() == 0


def test_closed_days_only_with_a_watermark(spark, data, tmp_path):
    shutil.copy(f"{data}/events.parquet", tmp_path / "events.parquet")
    events = adapters.snapshots(spark, data)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    source = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).option(
        "pathGlobFilter", "events.parquet"
    )
    stream = source.parquet(str(tmp_path)).select(
        F.col("ts").alias("published"),
        F.col("event_type").alias("theme"),
        F.round(F.col("value") * 100).cast("long").alias("facebook_interactions"),
    )
    ingest.daily_theme_totals(stream).writeStream.format("parquet").option("checkpointLocation", progress).trigger(
        availableNow=True
    ).start(out).awaitTermination()
    totals = {tuple(r) for r in spark.read.parquet(out).select("day", "theme", "facebook_interactions").collect()}
    batch = events.groupBy(F.to_date("published").alias("day"), "theme").agg(F.sum("facebook_interactions"))
    assert totals < {tuple(r) for r in batch.collect()}
    assert len({day for day, _, _ in totals}) == 28


def test_late_rows_are_left_out_and_days_come_once(spark, tmp_path):
    schema = "published timestamp, theme string, facebook_interactions long"
    landing, out, progress = (str(tmp_path / n) for n in ("landing", "out", "progress"))

    def arrive(*rows):
        frame = spark.createDataFrame([(dt.datetime.fromisoformat(t), x, n) for t, x, n in rows], schema)
        frame.repartition(3).write.mode("append").parquet(landing)
        ingest.append_closed_days(spark.readStream.schema(schema).parquet(landing), out, progress).awaitTermination()
        return sorted((str(r["day"]), r["theme"], r["facebook_interactions"], r["count"]) for r in spark.read.schema("day date, theme string, facebook_interactions long, count long").parquet(out).collect())

    # 3 January is a day behind neither 1 nor 2 January's end.
    assert arrive(("2024-01-01 10:00", "a", 5), ("2024-01-01 23:59", "a", 1), ("2024-01-02 00:00", "b", 2)) == []
    assert arrive(("2024-01-03 00:30", "a", 7), ("2024-01-01 12:00", "a", 4)) == [("2024-01-01", "a", 10, 3)]
    # 1 January is closed: its late row is left out and the day is not written again.
    assert arrive(("2024-01-01 09:00", "a", 100), ("2024-01-02 09:00", "b", 3), ("2024-01-09 00:00", "a", 1)) == [
        ("2024-01-01", "a", 10, 3),
        ("2024-01-02", "b", 5, 2),
        ("2024-01-03", "a", 7, 1),
    ]


def test_closed_days_of_a_table_in_several_files(spark, data, tmp_path):
    from pulse.plans.checks.registry import QUERIES

    spark.read.parquet(f"{data}/events.parquet").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("z02_closed_days", "z02_daily_theme_totals"):
        whole, cut = (sorted(map(tuple, QUERIES[name](spark, f).collect())) for f in (data, str(tmp_path)))
        assert whole == cut and whole
