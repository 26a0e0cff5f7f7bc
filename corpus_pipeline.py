"""From raw documents to encoded text: language, quality, near copies, benchmark passages, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.llm import byte_bpe, decontamination, language_id, minhash_dedup, quality_rules
from pulse.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row_key() -> Column:
    """The same bytes for rows alike in every column; in order of ``doc_id``, rows without one last."""
    value = lambda c: F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("null"))
    digest = F.md5(F.concat_ws(" ", *(value(c) for c in COLUMNS)).cast("binary"))
    place = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")
    return F.unhex(F.coalesce(F.concat(F.lit("00"), place, F.substring(digest, 1, 16)), F.concat(F.lit("01"), digest)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go; ``lang`` becomes the predicted language, ``und`` if no row is labelled."""
    model = language_id.fit(docs)
    said = language_id.predict(docs, model, keep=COLUMNS)
    return said.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failed lines."""
    judged = quality_rules.judge(docs).where("kept")
    return judged.select(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars")
    )


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows without an id stay if their group has no row with one; rows alike in every column count once.
    """
    rows = docs.select(*COLUMNS).withColumn("_row", _row_key())
    keep = minhash_dedup.classes(rows, doc_id="_row", repeated=True).where("doc_id = class_id").select(F.col("doc_id").alias("_row"))
    once = Window.partitionBy("_row").orderBy("_row")
    kept = rows.join(keep, "_row", "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return kept.select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.select(*COLUMNS).withColumn("_row", _row_key())
    found = decontamination.leaks(rows, items, doc_id="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(found, "_row", "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document left."""
    return byte_bpe.digests(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near copies", near_copies),
    ("benchmark", benchmark),
    ("encoding", encoding),
]

#: Language models and signatures have no SQL; small tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
