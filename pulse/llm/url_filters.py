"""URL rules by a sort-merge range join over reversed-host keys.

Hosts become keys such as ``com.example.www.``, so that a rule's host and all subdomains are one
interval of sorted keys. Rules and urls are sorted together and swept once; the sweep carries the stack
of rules whose interval is open. A second sweep of the same kind, over the paths below each open rule
host, finds the longest path prefix.

Null urls and urls without ``://`` have an empty host and path and fit no rule. A url that fits no rule
is allowed. Repeated rows of pages stay repeated. Of rules with the same host and path, a block wins.
Columns of the input other than the id and the url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.session import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` gives ``com.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _sweep(points: DataFrame, events: DataFrame, tie: list[str]) -> DataFrame:
    """Give every point the state after the last event at or before its key.

    ``events`` has ``key``, ``kind`` (0 closes, 1 opens) and ``state``; ``points`` has ``key`` and more
    columns, of which ``tie`` splits hot keys over several slices. Slices of the sorted rows are written
    to the shared folder; one row per slice carries the state into the next.
    """
    spark = points.sparkSession
    extra = [c for c in points.columns if c != "key"]
    types = dict(points.dtypes)
    kind = events.schema["state"].dataType.simpleString()
    both = events.select(
        "key", "kind", "state", *(F.lit(None).cast(types[c]).alias(c) for c in extra)
    ).unionByName(points.select("key", F.lit(2).alias("kind"), F.lit(None).cast(kind).alias("state"), *extra))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = settle(both.repartitionByRange(n, "key", "kind", *tie).withColumn("_slice", F.spark_partition_id()))
    ordered = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by("state", F.struct("key", "kind"))
    # One row per slice, which is as many as there are partitions.
    carry = (
        sliced.where("kind < 2")
        .groupBy("_slice")
        .agg(last.alias("_last"))
        .unionByName(spark.range(n).select(F.col("id").cast("int").alias("_slice"), F.lit(None).cast(kind).alias("_last")))
        .groupBy("_slice")
        .agg(F.max_by("_last", F.col("_last").isNotNull()).alias("_last"))
        .select("_slice", F.last("_last", ignorenulls=True).over(ordered).alias("_carry"))
    )
    # Inside a slice the events between two points are joined as intervals of the slice's own sorted rows.
    inside = Window.partitionBy("_slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = sliced.withColumn("_here", F.last("state", ignorenulls=True).over(inside)).where("kind = 2")
    return swept.join(F.broadcast(carry), "_slice").select(
        *extra, F.coalesce("_here", "_carry").alias("state")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per page: id, host, path, the longest rule that fits and its verdict."""
    rules = (
        rules.groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .withColumn("hkey", host_key(F.col("host")))
    )
    hosts = rules.select("hkey").distinct()
    # The stack below each rule host: the rule hosts among its own label prefixes.
    labels = F.split(F.expr("left(hkey, length(hkey) - 1)"), r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("."))
    )
    stacks = (
        hosts.select("hkey", F.explode(prefixes).alias("open"))
        .join(hosts.select(F.col("hkey").alias("open")), "open")
        .groupBy("hkey")
        .agg(F.sort_array(F.collect_list("open")).alias("stack"))
    )
    parent = F.filter(F.col("stack"), lambda h: h != F.col("hkey"))
    top = F.lit(b"\xff")  # no UTF-8 text holds this byte
    start = F.col("hkey").cast("binary")
    opens = stacks.select(start.alias("key"), F.lit(1).alias("kind"), F.col("stack").alias("state"))
    closes = stacks.select(F.concat(start, top).alias("key"), F.lit(0).alias("kind"), parent.alias("state"))

    seen = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    points = seen.groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    points = points.withColumn("key", host_key(F.col("host")).cast("binary"))
    hosted = _sweep(points, opens.unionByName(closes), ["page_id", "path"])

    # Second sweep: below each open rule host, the rules' paths.
    cuts = F.transform(
        F.sequence(F.lit(0), F.length("path") - 1), lambda i: F.substring(F.col("path"), F.lit(1), i)
    )
    outer = (
        rules.where(F.length("path") > 0)
        .select("hkey", "path", F.explode(cuts).alias("outer"))
        .join(
            rules.select("hkey", F.col("path").alias("outer"), F.struct("host", "path", "verdict").alias("rule")),
            ["hkey", "outer"],
        )
        .groupBy("hkey", "path")
        .agg(F.max_by("rule", F.length("outer")).alias("below"))
    )
    whole = rules.join(outer, ["hkey", "path"], "left")
    # No host holds a slash, so a rule without a path stays on its own host.
    begin = F.concat(F.col("hkey"), F.lit("/"), F.col("path")).cast("binary")
    # An empty struct field tells a closed stack from no event at all.
    opened = whole.select(begin.alias("key"), F.lit(1).alias("kind"), F.struct(F.struct("host", "path", "verdict").alias("rule")).alias("state"))
    closed = whole.select(F.concat(begin, top).alias("key"), F.lit(0).alias("kind"), F.struct(F.col("below").alias("rule")).alias("state"))
    paths = hosted.select(
        "page_id", "host", "path", "n", F.explode_outer("state").alias("open")
    ).withColumn("key", F.concat(F.coalesce("open", F.lit("")), F.lit("/"), F.col("path")).cast("binary"))
    found = _sweep(paths, opened.unionByName(closed), ["page_id", "host"])
    rule = F.when(F.col("open").isNotNull(), F.col("state.rule"))
    best = found.groupBy("page_id", "host", "path", "n").agg(
        # Of rules of the same length the one of the longer host counts.
        F.max_by(rule, F.when(rule.isNotNull(), F.struct(F.length("open") + F.length(rule["path"]), F.length("open")))).alias("rule")
    )
    return best.select(
        F.explode(F.expr("sequence(1L, n)")).alias("_copy"),
        "page_id",
        "host",
        "path",
        F.concat("rule.host", "rule.path").alias("rule"),
        F.coalesce("rule.verdict", F.lit("allow")).alias("verdict"),
    ).drop("_copy")
