"""Readers of uploaded files. Columns are found by header name, never by position."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse import schemas
from pulse.functions import dates, text


def sanitise_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names with underscores for spaces."""
    return df.toDF(*[name.lower().replace(" ", "_") for name in df.columns])


def read_text_csv(spark: SparkSession, path: str | Sequence[str], null_value: str = "") -> DataFrame:
    """CSV with a header, every column as text; quoted fields may hold line breaks."""
    return spark.read.csv(
        path if isinstance(path, str) else list(path),
        header=True,
        multiLine=True,
        quote='"',
        escape='"',
        nullValue=null_value,
        enforceSchema=False,
    )


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def clean_scan(raw: DataFrame, *extra: str) -> DataFrame:
    """Turn the text columns of a weekly scan into the stored article columns.

    A missing or malformed count fails the job. Rows without an article URL go.
    Columns named in ``extra`` pass through.
    """
    if schemas.SCAN_COUNT_ALIAS in raw.columns:
        raw = raw.withColumnRenamed(schemas.SCAN_COUNT_ALIAS, "Facebook Interactions")
    df = require(raw, [*schemas.SCAN_COLUMNS, *extra]).toDF(*schemas.SCAN_COLUMNS.values(), *extra)
    count = F.col("facebook_interactions").cast("long")
    checked = F.coalesce(count, F.raise_error(F.lit("a scan row has no interaction count")).cast("long"))
    return df.where(F.col("link").isNotNull() | count.isNull()).select(
        dates.to_local("published").alias("published"),
        "headline",
        "summary",
        "link",
        "facebook_link",
        "facebook_page_name",
        F.coalesce("domain", F.lit("facebook.com")).alias("domain"),
        checked.alias("facebook_interactions"),
        *extra,
    )


def read_scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Weekly scan files, checked and cleaned."""
    return clean_scan(read_text_csv(spark, path))


def read_scan_sources(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Weekly scan files with the name of the file each row came from in ``source``."""
    raw = read_text_csv(spark, path)
    return clean_scan(raw.withColumn("source", F.col("_metadata.file_name")), "source")


def split_malformed_counts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan rows with a whole-number count, and the rest for quarantine."""
    name = schemas.SCAN_COUNT_ALIAS if schemas.SCAN_COUNT_ALIAS in raw.columns else "Facebook Interactions"
    good = F.col(f"`{name}`").try_cast("long").isNotNull()
    return raw.where(good), raw.where(~good)


def read_indexed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Indexed-data CSV: links and comma-separated labels."""
    return require(read_text_csv(spark, path), schemas.INDEXED_COLUMNS)


def load_taxonomy(source: DataFrame, column: str) -> DataFrame:
    """Sorted distinct labels of one taxonomy column in lower case."""
    return source.select(text.fold(column).alias(column)).dropna().distinct().orderBy(column)


def read_taxonomy(spark: SparkSession, path: str, column: str) -> DataFrame:
    return load_taxonomy(read_text_csv(spark, path), column)


def read_snapshots(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Snapshot CSV with its columns cast to the contract types."""
    raw = require(read_text_csv(spark, path), schemas.SNAPSHOTS.names)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SNAPSHOTS])


def read_snapshots_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Snapshots as JSON lines; dates may be in any form a cast accepts."""
    times = (T.TimestampNTZType, T.DateType)
    raw = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, times) else f.dataType) for f in schemas.SNAPSHOTS]
    )
    rows = spark.read.schema(raw).json(path if isinstance(path, str) else list(path))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SNAPSHOTS])


def read_training(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Training rows from every Parquet file of a folder; unused columns are not read."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schemas.TRAINING).parquet(*paths)


def prepare_base_training(raw: DataFrame) -> DataFrame:
    """Hand-tagged articles as training rows with a joined ``theme > index`` label."""
    df = sanitise_columns(require(raw, schemas.TRAINING_COLUMNS))
    return df.select(
        F.col("published").cast("timestamp_ntz").alias("published"),
        "headline",
        text.join_label(F.col("theme"), F.col("new_index")).alias("label"),
    )


def read_base_training(spark: SparkSession, path: str) -> DataFrame:
    """Hand-tagged articles; a dash stands for null."""
    raw = read_text_csv(spark, path, null_value="-")
    return prepare_base_training(raw.replace("", None))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one with the same columns when the path is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Name and modification time of every loaded file."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.url_decode(name).alias("filename"), F.col("modificationTime").alias("modified"))


def new_files(incoming: DataFrame, loaded: DataFrame) -> DataFrame:
    """Files of ``incoming`` whose name is not in ``loaded``."""
    return incoming.join(loaded.select("filename"), "filename", "left_anti")


def read_indexed_xlsx(
    spark: SparkSession, path: str, columns: Sequence[str] = tuple(schemas.INDEXED_COLUMNS)
) -> DataFrame:
    """Named columns from the first sheet of every workbook of a folder, as text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return read_workbooks(files.select("path", "content"), columns)


def read_labelled_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Labelled articles from the first sheet of every workbook; the count must be a whole number."""
    rows = read_indexed_xlsx(spark, path, schemas.LABELLED_COLUMNS)
    return rows.withColumn("facebook_interactions", F.col("facebook_interactions").cast("long"))


def read_workbooks(books: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of workbooks given as ``path`` and ``content``.

    A workbook holds at most 1,048,576 rows by its format, which bounds a task.
    """
    wanted = list(columns)

    def sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = _first_sheet(content)
                header = next(rows, [])
                missing = [c for c in wanted if c not in header]
                if missing:
                    raise ValueError(f"{name}: missing columns: {', '.join(missing)}")
                places = [header.index(c) for c in wanted]
                while table := [
                    [row[p] if p < len(row) else None for p in places] for row in itertools.islice(rows, 10_000)
                ]:
                    yield pd.DataFrame(table, columns=wanted, dtype="object")

    schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted])
    return books.mapInPandas(sheets, schema)


def _first_sheet(content: bytes) -> Iterator[list[str | None]]:
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = sorted(
            (n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)),
            key=lambda n: int(re.search(r"\d+", n).group()),
        )
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{space}t")) for item in root.iter(f"{space}si")]
        with book.open(names[0]) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{space}row":
                    continue
                cells: list[str | None] = []
                for cell in row.iter(f"{space}c"):
                    letters = re.match(r"[A-Z]+", cell.get("r", "")) if cell.get("r") else None
                    place = _column_number(letters.group()) if letters else len(cells)
                    cells.extend([None] * (place + 1 - len(cells)))
                    value = cell.find(f"{space}v")
                    if cell.get("t") == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in cell.iter(f"{space}t"))
                    elif value is not None:
                        cells[place] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield cells
                row.clear()


def _column_number(letters: str) -> int:
    number = 0
    for letter in letters:
        number = number * 26 + ord(letter) - 64
    return number - 1
