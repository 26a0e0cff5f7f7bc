"""Incremental loading of scan files and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulse import schemas
from pulse.operators.mutate import batch_keys, new_rows, upsert_new_scans, upsert_scan
from pulse.sources.files import read_scan_sources
from pulse.sources.store import Store

_FILE_LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def ingest_scans(
    spark: SparkSession, landing: str, store: str, progress: str, files_per_batch: int = 100, buckets: int = 64
) -> StreamingQuery:
    """Load every scan file, plain or gzipped, that arrived in ``landing`` since the last run.

    The stream carries file names only, so each file is read by header name like any other scan. A batch
    writes its own rows, on top of the buckets of the stored table that its keys fall into. What was loaded is part of the table's
    version: a batch that runs again, or a new progress folder, finds its files there and changes nothing, and a
    file that came again with other content replaces its rows.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_LISTING)
        .option("pathGlobFilter", "*.{csv,csv.gz}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
        .select("path", F.col("modificationTime").alias("modified"), "length")
    )

    def load(batch: DataFrame, number: int) -> None:
        # Shuffle files go when their job is done, not when the driver happens to collect its garbage. The session is the stream's own.
        batch.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        load_files(Store(batch.sparkSession, store, schemas.NEWS_DATA, "facebook_link", buckets), batch)

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def load_files(table: Store, files: DataFrame) -> Store:
    """Load the files listed in ``path``, ``modified`` and ``length`` that the store does not hold yet."""
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    fresh = named.join(table.files(), ["file", "modified", "length"], "left_anti")
    earlier = table.files().select("file").distinct().withColumn("again", F.lit(True))
    # At most ``files_per_batch`` names.
    listed = fresh.join(earlier, "file", "left").select("path", "file", "modified", "length", "again").collect()
    if not listed:
        return table
    new = sorted(r["path"] for r in listed if not r["again"])
    again = {r["file"]: r["path"] for r in listed if r["again"]}
    spark = table.spark
    loaded = spark.createDataFrame([(r["file"], r["modified"], r["length"]) for r in listed], "file string, modified timestamp, length long")
    scans = read_scan_sources(spark, sorted(r["path"] for r in listed))
    if not again:
        keys = batch_keys(scans)
        changed = table.touched(keys)
        return table.append(new_rows(table.read(changed), scans, keys), changed, loaded)
    # Rows of an earlier load can lie in other buckets.
    changed = set(table.touched(scans)) | set(table.touched(table.read().where(F.col("source").isin(*again))))
    rows = table.read(sorted(changed))
    if new:
        rows = upsert_new_scans(rows, read_scan_sources(spark, new))
    for name in sorted(again):
        rows = upsert_scan(rows, read_scan_sources(spark, [again[name]]).drop("source"), name)
    return table.commit(rows, sorted(changed), loaded)


def stored_table(spark: SparkSession, store: str) -> DataFrame:
    """Table of the last complete version."""
    return Store(spark, store, schemas.NEWS_DATA, "facebook_link").read()


def daily_theme_totals(stream: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """Interactions and articles per theme and day of a stream.

    With ``lateness`` a day closes once it is that far behind the newest row and
    later rows are dropped; without, every day stays open.
    """
    timed = stream.withColumn("published", F.col("published").cast("timestamp"))
    if lateness:
        timed = timed.withWatermark("published", lateness)
    days = timed.groupBy(F.window("published", "1 day").alias("window"), "theme").agg(
        F.sum("facebook_interactions").alias("facebook_interactions"), F.count("*").alias("count")
    )
    return days.select(F.to_date("window.start").alias("day"), "theme", "facebook_interactions", "count")


def append_closed_days(stream: DataFrame, path: str, progress: str, lateness: str = "1 day") -> StreamingQuery:
    """Write the totals of every day once, when ``lateness`` has passed since its end; later rows of it are left out.

    The state holds open days only, so it is bounded by themes times open days, whatever the length of the stream.
    """
    return (
        daily_theme_totals(stream, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(path)
    )
