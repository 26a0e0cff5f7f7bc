"""Changes to keyed tables: each takes the stored rows and a batch and gives the new rows.

Nothing is written here. The caller writes the result to a new path (or merges it
into a table format that can), so a lost executor can always recompute it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse import schemas
from pulse.functions import text
from pulse.operators.ordered import broadcast_if_small, first_per_group
from pulse.session import settle


# Most rows of a batch whose keys every task may hold: about 100 MB.
BATCH_ROWS = 500_000


def delete_sources(target: DataFrame, names: Sequence[str]) -> DataFrame:
    """Remove rows loaded from the named files; rows of unknown origin stay."""
    if not names:
        return target
    return target.where(F.coalesce(~F.col("source").isin(*names), F.lit(True)))


def upsert_scan(target: DataFrame, batch: DataFrame, source: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Load one scan file: replace its earlier load, then insert or update by key.

    A stored article is overwritten only when the batch has at least as many
    interactions. When the batch repeats a key its most engaging row counts.
    """
    return _merge(delete_sources(target, [source]), batch.withColumn("source", F.lit(source)), batch_rows)


def upsert_new_scans(target: DataFrame, batch: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Load many scan files that were never loaded before in one pass.

    For new file names this equals loading them one by one in name order: the row
    with most interactions wins and the later file wins a tie.
    """
    return _merge(target, batch, batch_rows)


def batch_keys(batch: DataFrame) -> DataFrame:
    """Keys of a batch with their number of rows and most interactions, gathered once."""
    seen = F.max("facebook_interactions").alias("_new")
    return settle(batch.groupBy("facebook_link").agg(F.count("*").alias("_rows"), seen))


def new_rows(target: DataFrame, batch: DataFrame, keys: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """What ``upsert_new_scans`` puts in: the best row of every key of the batch that no stored row beats.

    ``keys`` are the ``batch_keys``. Of the stored rows only keys and counts are read.
    """
    best = _best(batch.select(*schemas.NEWS_DATA.names), keys.where("_rows > 1").select("facebook_link"), batch_rows)
    stored, counts = target.select("facebook_link", "facebook_interactions"), keys.select("facebook_link", "_new")
    few = _few(counts, batch_rows)
    beaten = stored.join(F.broadcast(counts) if few else counts, "facebook_link").where(F.col("facebook_interactions") > F.col("_new"))
    beaten = beaten.select("facebook_link").distinct()
    # No more keys than the batch has.
    beaten = F.broadcast(beaten) if few else broadcast_if_small(settle(beaten), batch_rows)
    return best.join(beaten, "facebook_link", "left_anti").select(*schemas.NEWS_DATA.names)


def _merge(target: DataFrame, batch: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Stored rows that no batch row replaces, and the best batch row of every other key.

    Keys and counts decide; they are brought together first, once. Whole rows are only filtered
    by broadcasts of checked size, whatever the batch: shuffled are rows of keys that the batch repeats, and stored
    or batch rows only where neither side of a decision is small.
    """
    columns = schemas.NEWS_DATA.names
    batch, stored = batch.select(*columns), target.select(*columns)
    keys = batch_keys(batch)
    best = _best(batch, keys.where("_rows > 1").select("facebook_link"), batch_rows)
    counts = keys.select("facebook_link", "_new")
    stays = F.col("_new").isNull() | (F.col("facebook_interactions") > F.col("_new"))
    if _few(counts, batch_rows):
        counts = F.broadcast(counts)
        kept = stored.join(counts, "facebook_link", "left").where(stays)
        beaten = stored.join(counts, "facebook_link").where(F.col("facebook_interactions") > F.col("_new"))
        # No more keys than the batch has.
        beaten = F.broadcast(beaten.select("facebook_link").distinct())
    else:
        marks = stored.select("facebook_link", "facebook_interactions").join(counts, "facebook_link", "left")
        marks = settle(marks.select("facebook_link", "_new", F.coalesce(stays, F.lit(False)).alias("_stays")).distinct())
        gone, held = (marks.where(c).select("facebook_link", "_new") for c in ("not _stays", "_stays and facebook_link is not null"))
        if _few(gone, batch_rows):
            kept = stored.join(F.broadcast(gone), "facebook_link", "left").where(stays)
        elif _few(held, batch_rows):
            kept = stored.join(F.broadcast(held), "facebook_link").where(stays).select(*columns)
            kept = kept.unionByName(stored.where(F.col("facebook_link").isNull()))
        else:
            kept = stored.join(counts, "facebook_link", "left").where(stays)
        beaten = broadcast_if_small(held.where("_new is not null").select("facebook_link"), batch_rows)
    fresh = best.join(beaten, "facebook_link", "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns))


def _best(batch: DataFrame, repeated: DataFrame, batch_rows: int) -> DataFrame:
    """The best row of every key; only rows of ``repeated`` keys need a comparison."""
    # With several new files the later name must win a tie before the time does.
    order = ["-facebook_interactions", "-source", "-published", "link"]
    if repeated.isEmpty():
        return batch
    if not _few(repeated, batch_rows):
        return first_per_group(batch, ["facebook_link"], order)
    again = F.broadcast(repeated.withColumnRenamed("facebook_link", "_again"))
    same = F.col("facebook_link").eqNullSafe(F.col("_again"))
    once, more = batch.join(again, same, "left_anti"), batch.join(again, same, "left_semi")
    return once.unionByName(first_per_group(more, ["facebook_link"], order))


def _few(rows: DataFrame, bound: int) -> bool:
    return rows.limit(bound + 1).count() <= bound


def replace_by_key(
    target: DataFrame, batch: DataFrame, key: str = "facebook_link", batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Remove rows whose key is in the batch, then add the batch."""
    fresh = batch.select(*target.columns)
    keys = broadcast_if_small(fresh.select(key), batch_rows)
    return target.join(keys, key, "left_anti").select(*target.columns).unionByName(fresh)


def load_labels(target: DataFrame, batch: DataFrame, include_themes: bool = False) -> DataFrame:
    """Store indexed data: split the label texts and replace by key.

    A row needs a subindex or indexes to count; with ``include_themes`` themes
    alone are enough. A repeated key keeps its first row by link and labels.
    """
    needed = ["subindex", "indexes", *(["themes"] if include_themes else [])]
    rows = first_per_group(
        batch.dropna("all", subset=needed), ["facebook_link"], ["link", "subindex", "themes", "indexes"]
    )
    lists = rows.withColumns({c: text.split_list(c) for c in ("themes", "indexes")})
    return replace_by_key(target, lists)


def update_from(
    target: DataFrame,
    batch: DataFrame,
    key: str = "facebook_link",
    columns: Sequence[str] = ("subindex",),
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Overwrite columns of the rows whose key is in the batch, also by null.

    A key that the batch repeats takes the row that sorts first.
    """
    fresh = first_per_group(batch.select(key, *columns), [key], list(columns))
    fresh = fresh.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_matched"))
    joined = target.join(broadcast_if_small(fresh, batch_rows), key, "left")
    return joined.withColumns(
        {c: F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    ).select(*target.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
