"""File scans.  Workbooks and word files are landed as parquet, CSV or text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.scans import skip_first_rows


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Plain scan; a declared schema saves the inference pass over the data."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_csv(
    spark: SparkSession, path: str, schema=None, sep: str = ",", header: bool = True, multi_line: bool = False
) -> DataFrame:
    """``multi_line`` allows line breaks in quoted cells; such a file cannot be split, so one task reads it."""
    reader = spark.read.option("sep", sep).option("header", header).option("multiLine", multi_line)
    reader = reader.option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_tab_separated(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path, schema=schema)


def parse_numbered_lines(lines: DataFrame, columns: list[str], skip: int, sep: str = ",") -> DataFrame:
    """Landed ``(line_no, text)`` after ``skip`` preamble lines, as text columns.

    The header is line ``skip + 1``; it is dropped, ``columns`` name the cells.
    ``line_no`` stays as the row order.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    body = skip_first_rows(lines, "line_no", skip + 1)
    return body.select("line_no", F.from_csv("text", schema, {"sep": sep}).alias("_r")).select("line_no", "_r.*")


def cells_of(df: DataFrame, sheet: str, row: str) -> DataFrame:
    """A headerless positional table as cells ``(sheet, row, col, value)``.

    Empty cells are left out.  Columns other than ``sheet`` and ``row`` are taken
    in order as columns 0, 1, 2, ...
    """
    names = [c for c in df.columns if c not in (sheet, row)]
    cells = F.array(
        *[F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)]
    )
    return (
        df.select(F.col(sheet).alias("sheet"), F.col(row).cast("bigint").alias("row"), F.explode(cells).alias("_c"))
        .select("sheet", "row", "_c.col", "_c.value")
        .where("value is not null")
    )
