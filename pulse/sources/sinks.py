"""Writers. Each call writes one new path; nothing is read and overwritten in the same job."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Spark's default keeps milliseconds only.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str | None = None) -> str:
    """Parquet files, split into folders by ``partition_by`` when given.

    Rows of one folder are brought together first, so that it gets few files;
    adaptive execution splits a folder with too many rows over several tasks.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path, compression=compression)
    return path


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "facebook_link", buckets: int = 200) -> str:
    """A keyed table in buckets of its key.

    Joins and upserts between tables with the same buckets need no shuffle. Reads
    go through the catalog: ``spark.table(table)``.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)
    return table


def write_csv(
    df: DataFrame, path: str, run_date: dt.date | None = None, mode: str = "overwrite", compression: str | None = None
) -> str:
    """CSV files with a header, in a folder per run date when one is given.

    List columns become comma-separated text, so that a spreadsheet can open them.
    """
    target = f"{path}/{run_date.isoformat()}" if run_date else path
    flat = df.select(
        *[
            F.concat_ws(",", F.col(name)).alias(name) if kind.startswith("array<string") else F.col(name)
            for name, kind in df.dtypes
        ]
    )
    # Of gzip's levels the fourth: about as small as the sixth, its default, in less than half the time.
    flat.write.mode(mode).option("timestampNTZFormat", _TIME).option("zlib.compress.level", "FOUR").csv(
        target,
        compression=compression,
        header=True,
        quote='"',
        escape='"',
        # Line breaks and edge spaces must survive, so that a reader sees the same text.
        quoteAll=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return target


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("timestampNTZFormat", _TIME).json(path)
    return path


def to_workbooks(df: DataFrame, sheet_rows: int = 100_000) -> DataFrame:
    """Spreadsheet files as ``path`` and ``content``: each task packs its rows into books of bounded size.

    Values are written as text; a cell must stay below the format's 32,767 characters.
    """
    columns = df.columns
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[list] = []
        for batch in batches:
            waiting += batch.astype("object").where(batch.notna(), None).values.tolist()
            while len(waiting) >= sheet_rows:
                yield _book(columns, waiting[:sheet_rows])
                waiting = waiting[sheet_rows:]
        if waiting:
            yield _book(columns, waiting)

    books = text.mapInPandas(pack, "content binary")
    return books.select(F.concat(F.lit("part-"), F.monotonically_increasing_id(), F.lit(".xlsx")).alias("path"), "content")


def _book(columns: list[str], rows: list[list]) -> pd.DataFrame:
    def line(cells: Sequence[str | None]) -> str:
        filled = (
            "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in cells
        )
        return f"<row>{''.join(filled)}</row>"

    body = "".join(line(cells) for cells in [columns, *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    related = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types">'
        f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" '
        f'Type="{related}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{related}"><sheets>'
        f'<sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" '
        f'Type="{related}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        for name, content in parts.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{content}')
    return pd.DataFrame({"content": [file.getvalue()]})
