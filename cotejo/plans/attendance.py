"""Attendance: call-centre presence, logged presence and two rosters on one spine."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import short_name, surname_first
from cotejo.functions.times import check_range, clock, parse, parse_strict
from cotejo.operators.dedupe import first_per_key, split_duplicates
from cotejo.operators.joins import gathered, join_on_spine, tagged_source
from cotejo.operators.rosters import (
    DESK,
    DESK_BODY_ROW,
    GENERAL,
    LABEL_ROWS,
    body_start,
    roster_rows,
    unpivot,
    unpivot_layouts,
)

KEYS = ["UsuarioC", "FechaC"]
HOURS = {"LOGUEO/INGRESO": "Hora_SEMAFORO", "HoraEntrada": "Hora_NCC"}


def _typed(df: DataFrame, name: str, fmt: str):
    col = F.col(f"`{name}`")
    if dict(df.dtypes)[name] == "string":
        return parse_strict(col, fmt)
    return col.cast("timestamp_ntz")


def call_centre_presence(events: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Earliest event per user and day, and the events of days with several.

    ``order`` breaks ties between events of one moment by source order.
    """
    df = events.withColumn("Fecha", _typed(events, "Fecha", "dd/MM/yyyy HH:mm:ss"))
    df = df.withColumn("Día", F.to_date("Fecha"))
    first, several = split_duplicates(df, ["Usuario", "Día"], ["Fecha", order])
    clean = first.where(F.col("Usuario").isNotNull()).select(
        *[c for c in first.columns if c not in ("Fecha", "Día")],
        F.col("Día").alias("Fecha"),
        clock(F.col("Fecha")).alias("HoraEntrada"),
        F.col("Día").alias("Fecha_NCC"),
        short_name(F.col("Usuario")).alias("Usuario_NCC"),
    )
    return clean, several


def logged_presence(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """First row per short name and day, and every row of repeated ones."""
    date = F.to_date(_typed(df, "FECHA", "yyyy-MM-dd"))
    rows = df.withColumnRenamed("ANALISTA", "Usuario").withColumns(
        {
            "FECHA": date,
            "LOGUEO/INGRESO": clock(parse(F.col("`LOGUEO/INGRESO`"), "H:mm:ss")),
            "Fecha_Semaforo": date,
            "Usuario_Semaforo": short_name(F.col("Usuario")),
        }
    )
    return split_duplicates(rows, ["Usuario_Semaforo", "Fecha_Semaforo"], [order])


def _roster(unpivoted: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    rows = roster_rows(unpivoted)
    first, several = split_duplicates(rows, ["user", "date"], ["sheet", "row", "day"])
    shape = lambda df: df.select(
        F.col("date").alias(f"Fecha_{name}"),
        F.col("user").alias(f"Usuario_{name}"),
        F.col("shift").alias(f"Turno_{name}"),
        F.col("shift_start").alias(f"Hora_Inicial_{name}"),
    )
    return shape(first), shape(several)


def desk_roster(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _roster(unpivot(cells, **DESK, body=DESK_BODY_ROW), "Mesa")


def general_roster(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _roster(unpivot(cells, **GENERAL, body=body_start(cells), exclude=LABEL_ROWS), "General")


def rosters(cells: DataFrame) -> DataFrame:
    """First shift per roster, user and day of both rosters' cells together: (roster, user, date, shift, shift_start)."""
    first = first_per_key(roster_rows(unpivot_layouts(cells)), ["roster", "user", "date"], ["sheet", "row", "day"])
    return first.select("roster", "user", "date", "shift", "shift_start")


def _keyed(df: DataFrame, suffix: str) -> DataFrame:
    df = df.drop("Fecha").withColumnsRenamed({f"Usuario_{suffix}": "UsuarioC", f"Fecha_{suffix}": "FechaC", **HOURS})
    return df.withColumns({"UsuarioC": F.trim("UsuarioC"), "FechaC": F.to_date("FechaC")}).withColumnsRenamed({"Usuario": f"Usuario_{suffix}"})


def _formatted(out: DataFrame) -> DataFrame:
    return out.withColumns(
        {
            "UsuarioC_formato": surname_first(F.col("Usuario_Semaforo")),
            "FechaC_formato": F.date_format("FechaC", "dd/MM/yyyy"),
        }
    )


def combined_rows(
    logged: DataFrame,
    call_centre: DataFrame,
    both_rosters: DataFrame,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """As ``combined``, with both rosters in one frame (``rosters``), each of them once a user and day.

    All sources are one union, told apart by their struct column, and meet in one grouping; so every table is
    read for its own work only.  A repeated user and day of any source raises.
    """
    check_range(start, end)
    frames = {"logged": _keyed(logged, "Semaforo"), "call_centre": _keyed(call_centre, "NCC")}
    sources = {n: [c for c in df.columns if c not in KEYS] for n, df in frames.items()}
    parts = [tagged_source(df, KEYS, n) for n, df in frames.items()]
    shapes = {name: F.struct(F.col("shift").alias(f"Turno_{name}"), F.col("shift_start").alias(f"Hora_Inicial_{name}")) for name in ("General", "Mesa")}
    values = [F.when(F.col("roster") == name, shape).alias(name) for name, shape in shapes.items()]
    parts.append(both_rosters.select(F.trim("user").alias("UsuarioC"), F.to_date("date").alias("FechaC"), *values))
    sources |= {name: [f"Turno_{name}", f"Hora_Inicial_{name}"] for name in shapes}
    tagged = parts[0]
    for part in parts[1:]:
        tagged = tagged.unionByName(part, allowMissingColumns=True)
    return _formatted(gathered(tagged, KEYS, sources))


def combined(
    logged: DataFrame,
    call_centre: DataFrame,
    general: DataFrame,
    desk: DataFrame,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """All four sources per user and day.

    The first three must have one row per user and day; a repeated one raises.
    Rows without a day belong together by user.  ``start`` and ``end`` are the days
    asked for; a range that ends before it starts raises.
    """
    check_range(start, end)
    sources = {
        "logged": (logged, "Semaforo"),
        "call_centre": (call_centre, "NCC"),
        "general": (general, "General"),
        "desk": (desk, "Mesa"),
    }
    keyed = {name: _keyed(df, suffix) for name, (df, suffix) in sources.items()}
    return _formatted(join_on_spine(keyed, KEYS))
