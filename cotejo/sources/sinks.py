"""Sinks.  Every report goes to a new directory; nothing is overwritten."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Extract kinds by report number.
EXTRACT_DIRS = {15: "incidents", 18: "clock_stops", 4: "general"}
TICKET = "nro_incidencia"


def stamped(base: str, name: str, at: datetime | None = None, between: tuple[str, str] | None = None) -> str:
    """``base/name[_from_to_until]_YYYYmmdd_HHMMSS``; slashes in the range become dashes."""
    when = (at or datetime.now()).strftime("%Y%m%d_%H%M%S")
    span = f"_{between[0].replace('/', '-')}_to_{between[1].replace('/', '-')}" if between else ""
    return f"{base.rstrip('/')}/{name}{span}_{when}"


def write(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = (), **options) -> str:
    writer = df.write.mode("errorifexists").format(fmt).options(**options)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
    return path


def write_report(df: DataFrame, base: str, at: datetime | None = None, fmt: str = "parquet") -> str:
    """Final findings report, in ticket order over its files; a table without tickets stays as it is."""
    if TICKET in df.columns:
        df = df.orderBy(F.col(TICKET).asc_nulls_last())
    return write(df, stamped(base, "validator_report", at), fmt)


def write_sla(df: DataFrame, base: str, start: str, end: str, at: datetime | None = None, fmt: str = "parquet") -> str:
    return write(df, stamped(base, "sla_report", at, (start, end)), fmt)


def write_extract(
    df: DataFrame, base: str, report: int, start: str, end: str, at: datetime | None = None, fmt: str = "parquet"
) -> str:
    """Extract routed by its report number."""
    if report not in EXTRACT_DIRS:
        raise ValueError(f"unknown report number {report}")
    return write(df, stamped(f"{base.rstrip('/')}/{EXTRACT_DIRS[report]}", "extract", at, (start, end)), fmt)


def write_with_rejects(
    clean: DataFrame, rejects: DataFrame, base: str, name: str, at: datetime | None = None, fmt: str = "parquet"
) -> tuple[str, str]:
    """A cleaned table and the rows set aside for review."""
    return (
        write(clean, stamped(base, name, at), fmt),
        write(rejects, stamped(base, f"{name}_duplicates", at), fmt),
    )


def records(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time, for a caller that needs records."""
    return df.toLocalIterator()
