"""A keyed table in hash buckets, with versions.

Rows lie in ``version=<n>/bucket=<b>`` by the hash of their key. A version writes the buckets it changes
and nothing else; its manifest says for every bucket which versions hold it, and which files were loaded. The
manifest is one small file written last, so a version is there whole or not at all, and readers of an
older version are never disturbed. A folder that a manifest names and that is gone raises an error when it is read;
it never counts as empty.

A version either replaces whole buckets (``commit``) or lies on top of them as one more layer (``append``), which writes
the new rows only. Of a key in several layers the last one counts.

One writer at a time. Buckets are fixed when the store is made: choose them so that a bucket is one to a few files
of the usual size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.sources.sinks import write_parquet

_MANIFEST = "bucket int, held_by long, step int, buckets int, file string, modified timestamp, length long"

# So many layers of a bucket on one step become one layer on the next step.
LAYERS = 16


class Store:
    """The table below ``path`` with rows of ``schema``, in buckets of ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        held = self._manifests()
        top = held.agg(F.max("version").alias("version"), F.max("buckets").alias("buckets")).first()
        self.version = -1 if top["version"] is None else int(top["version"])
        self.buckets = int(top["buckets"] or buckets)
        # Few rows per bucket, by LAYERS; their number is fixed for the store.
        now = held.where((F.col("version") == self.version) & F.col("bucket").isNotNull())
        layers = defaultdict(list)
        for r in now.select("bucket", "held_by", "step").collect():
            layers[r["bucket"]].append((r["held_by"], r["step"] or 0))
        # Version and step of every layer, the last one on top.
        self.held_by = {b: tuple(sorted(found)) for b, found in layers.items()}

    def _manifests(self) -> DataFrame:
        folder = f"{self.path}/manifest"
        try:
            return self.spark.read.schema(_MANIFEST + ", version long").parquet(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        if self._anything():
            raise FileNotFoundError(f"{folder} is gone, though {self.path} holds rows")
        return self.spark.createDataFrame([], _MANIFEST + ", version long")

    def _anything(self) -> bool:
        rows = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        return bool(rows.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(rows))

    def bucket(self) -> Column:
        """Bucket of a row; rows without a key share one."""
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """Rows of all buckets, or of some; folders of other buckets are not listed."""
        chosen = None if only is None else set(only)
        return self._live({b: [v for v, _ in layers] for b, layers in self.held_by.items() if chosen is None or b in chosen})

    def _live(self, layers: Mapping[int, Sequence[int]]) -> DataFrame:
        """Rows of some layers of buckets: those of a key from its last layer, and all without a key."""
        if not layers:
            return self.spark.createDataFrame([], self.schema)
        single = {b: versions for b, versions in layers.items() if len(versions) == 1}
        several = {b: versions for b, versions in layers.items() if len(versions) > 1}
        parts = [self._folders(single)] if single else []
        if several:
            layer = F.regexp_extract("_metadata.file_path", r".*/version=(\d+)/bucket=", 1).cast("long")
            rows = self._folders(several).withColumn("_layer", layer)
            last = rows.groupBy(self.key).agg(F.max("_layer").alias("_last"))
            live = rows.join(last, self.key, "left").where(F.col("_layer") == F.coalesce("_last", "_layer"))
            parts.append(live.select(*self.schema.names))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _folders(self, layers: Mapping[int, Sequence[int]]) -> DataFrame:
        folders = [f"{self.path}/version={v}/bucket={b}" for b, versions in sorted(layers.items()) for v in versions]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def files(self) -> DataFrame:
        """Name, modification time and length of every file loaded, once per load."""
        return self._manifests().where("file is not null").select("file", "modified", "length", "version")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that have a row among ``rows``: at most as many numbers as there are buckets."""
        return sorted(r["bucket"] for r in rows.select(self.bucket()).distinct().collect())

    def commit(self, rows: DataFrame, changed: Sequence[int], files: DataFrame | None = None) -> Store:
        """The next version: ``rows`` are all rows of the ``changed`` buckets, the others stay where they are."""
        number, there = self._write(rows)
        held = {b: layers for b, layers in self.held_by.items() if b not in set(changed)}
        steps = {b: max((step for _, step in self.held_by.get(b, ())), default=0) for b in there}
        return self._publish(number, held | {b: ((number, steps[b]),) for b in there}, files)

    def append(self, rows: DataFrame, changed: Sequence[int], files: DataFrame | None = None) -> Store:
        """The next version: ``rows``, of ``changed`` buckets and one per key, hide the stored rows of their keys; rows without a key are added.

        Stored rows stay where they are, unless a bucket has ``LAYERS`` layers on a step: these become one. So a load writes about
        as much as it brings, and a row is written again once in ``LAYERS`` loads, then once in as many times as many.
        """
        steps = {b: self._step(b) for b in changed}
        taken = {b: [v for v, step in self.held_by[b] if step < steps[b]] for b in changed if steps[b]}
        if taken:
            older = self._live(taken).join(rows.select(self.key), self.key, "left_anti")
            rows = older.select(*self.schema.names).unionByName(rows.select(*self.schema.names))
        number, there = self._write(rows)
        tops = {b: tuple(x for x in self.held_by.get(b, ()) if x[1] >= steps[b]) + ((number, steps[b]),) for b in there}
        return self._publish(number, self.held_by | tops, files)

    def _step(self, bucket: int) -> int:
        """Step of the bucket's next layer, which takes in all layers of lower steps."""
        taken, step = [s for _, s in self.held_by.get(bucket, ())], 0
        while taken.count(step) >= LAYERS - 1:
            step += 1
        return step

    def _write(self, rows: DataFrame) -> tuple[int, set[int]]:
        """Write the folder of the next version; its number and the buckets that have rows in it."""
        number = self.version + 1
        target = f"{self.path}/version={number}"
        write_parquet(rows.select(*self.schema.names, self.bucket()), target, ["bucket"], "zstd")
        there = self.spark.read.schema("bucket int").parquet(target).distinct().collect()
        return number, {r["bucket"] for r in there}

    def _publish(self, number: int, held: Mapping[int, Iterable[tuple[int, int]]], files: DataFrame | None) -> Store:
        """Write the manifest of a version whose rows are there."""
        files = self.spark.createDataFrame([], "file string, modified timestamp, length long") if files is None else files
        layers = [(b, v, step, self.buckets, None, None, None) for b, found in sorted(held.items()) for v, step in found]
        entries = self.spark.createDataFrame(layers or [(None, None, None, self.buckets, None, None, None)], _MANIFEST)
        loaded = files.select(
            F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("held_by"), F.lit(None).cast("int").alias("step"),
            F.lit(self.buckets).alias("buckets"), "file", "modified", "length",
        )
        write_parquet(entries.unionByName(loaded).coalesce(1), f"{self.path}/manifest/version={number}")
        return Store(self.spark, self.path, self.schema, self.key, self.buckets)
