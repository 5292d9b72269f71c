"""Prepared inputs of the ticket validator.

Prepared frames use short lower-case names, because several inputs differ only
in the case of their headers.  Missing text carries the spelling ``nan`` from
the contract on, so two missing texts are equal and show as such in messages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.numbers import number_or_zero
from cotejo.functions.text import as_text, integer_part, or_unknown, phrase_count, strip, stripped_or_unknown
from cotejo.functions.times import (
    DAY_FIRST,
    drop_zero_seconds,
    duration_hhmm,
    duration_hours,
    expected_start,
    floor_minute,
    hhmm,
    minute_text,
    minutes_of,
    parse,
    seconds_between,
)
from cotejo.sources.contracts import INCIDENTS, OUTAGE_CUT, Contract, ContractError, conform

MEASURES = "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS"
CAUSE = "DETERMINACIÓN DE LA CAUSA"
FAULT_COLUMNS = (
    "Número de ticket",
    "Fecha y Hora Inicio",
    "Fecha y Hora Fin",
    "CUISMP",
    "Avería reportada",
    "Causa",
    "Tiempo real de afectación (HH:MM)",
    "Distrito Fiscal",
    "Tiempo Total (HH:MM)",
)


def _time(df: DataFrame, name: str, *formats: str) -> Column:
    col = F.col(f"`{name}`")
    if dict(df.dtypes)[name].startswith("timestamp"):
        return col.cast("timestamp_ntz")
    return parse(strip(col), *formats)


def _text(df: DataFrame, name: str) -> Column:
    """A cell of a cleaned input, ``No disponible`` where empty; text was stripped and its nulls spelt by the contract."""
    col = F.col(f"`{name}`")
    return stripped_or_unknown(col) if dict(df.dtypes)[name] == "string" else or_unknown(as_text(col))


def _integer(name: str) -> Column:
    return stripped_or_unknown(integer_part(F.col(name)))


def _label(component: str | Column) -> Column:
    return F.lit(component) if isinstance(component, str) else component


def _row(df: DataFrame, row: str | None) -> Column:
    return (F.lit(0) if row is None else F.col(f"`{row}`")).cast("bigint").alias("row")


def _minutes(seconds: Column) -> Column:
    return F.floor(F.coalesce(seconds, F.lit(0)) / 60)


@dataclass(frozen=True)
class Late:
    """An input whose cells are cleaned where its rows are used, behind the join on its key.

    ``keyed`` has the cleaned key and the raw cells in one struct; ``fields`` turns the struct of a frame that holds it into the
    prepared columns and leaves all others.  So a join moves raw cells once, and text work
    is done by the tasks behind it, however few files there are.
    """

    keyed: DataFrame
    fields: Callable[[DataFrame], DataFrame]

    def frame(self) -> DataFrame:
        return self.fields(self.keyed)


def _keyed(df: DataFrame, contract: Contract, key: str, cells: str, carry: list[str], keep_newlines: bool) -> DataFrame:
    """(nro_incidencia, cells): the key cleaned as the contract asks, the contract's columns as they are."""
    raw = conform(df, contract, carry=carry, clean=False)
    held = raw.select(F.col(f"`{key}`"), F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias(cells))
    held = conform(held, Contract(contract.name, (key,)), carry=[cells], keep_newlines=keep_newlines, null_text="nan")
    return held.select(_text(held, key).alias("nro_incidencia"), cells)


def _opened(df: DataFrame, contract: Contract, cells: str, carry: list[str], keep_newlines: bool) -> tuple[DataFrame, list[str]]:
    """The cells under the contract, beside the other columns, and the names of these."""
    others = [c for c in df.columns if c != cells]
    inner = [f.name for f in df.schema[cells].dataType.fields]
    flat = df.select(*[F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(others)], *[F.col(cells)[c].alias(c) for c in inner])
    kept = [f"_kept_{i}" for i in range(len(others))]
    return conform(flat, contract, carry=[*carry, *kept], keep_newlines=keep_newlines, null_text="nan"), others


def late_cut(df: DataFrame, row: str | None = None, keep_newlines: bool = False) -> Late:
    """The monthly outage cut, cleaned behind its joins.  ``row`` names a column with the source row order."""
    carry = [row] if row else []
    keyed = _keyed(df, OUTAGE_CUT, "TICKET", "_cut", carry, keep_newlines)
    return Late(keyed, lambda rows: _cut_fields(rows, row, keep_newlines))


def prepare_cut(df: DataFrame, row: str | None = None, keep_newlines: bool = False) -> DataFrame:
    """The monthly outage cut.  ``row`` names a column with the source row order."""
    return late_cut(df, row, keep_newlines).frame()


def _cut_fields(rows: DataFrame, row: str | None, keep_newlines: bool) -> DataFrame:
    df, others = _opened(rows, OUTAGE_CUT, "_cut", [row] if row else [], keep_newlines)
    text = lambda c: _text(df, c)
    cell = lambda c: F.col(f"`{c}`").cast("string")
    start, end = _time(df, "FECHA Y HORA INICIO", "yyyy-MM-dd"), _time(df, "FECHA Y HORA FIN", "yyyy-MM-dd")
    hours = F.col("`Duracion entero`")
    if dict(df.dtypes)["Duracion entero"] != "string":
        hours = F.coalesce(hours, F.lit(0))
    out = df.select(
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(others)],
        start.alias("cut_start"),
        end.alias("cut_end"),
        _integer("CUISMP").alias("cut_service"),
        text("TIPO CASO").alias("cut_case"),
        cell("AVERÍA").alias("cut_fault"),
        drop_zero_seconds(cell("TIEMPO (HH:MM)")).alias("cut_time"),
        duration_hours(cell("TIEMPO (HH:MM)")).alias("_hours"),
        cell("COMPONENTE").alias("cut_component"),
        text("DF").alias("cut_district"),
        cell("OBSERVACIÓN").alias("cut_note"),
        text("CID").alias("cut_cid"),
        duration_hhmm(cell("FIN-INICIO (HH:MM)")).alias("cut_span"),
        text(CAUSE).alias("cut_cause"),
        cell("RESPONSABILIDAD").alias("cut_owner"),
        cell("TIPO REPORTE").alias("tipo_reporte"),
        number_or_zero(hours).alias("cut_hours"),
        hours.cast("string").alias("cut_hours_text"),
        cell("Agrupación entero").alias("cut_band"),
        _integer("CODINCIDENCEPADRE").alias("cut_parent"),
        cell("MASIVO").alias("cut_mass"),
        text(MEASURES).alias("cut_measures"),
        cell("INDISPONIBILIDAD").alias("cut_block"),
        _row(df, row),
    )
    span = seconds_between(F.col("cut_start"), F.col("cut_end"))
    return out.withColumns(
        {
            "cut_phrases": phrase_count(F.col("cut_measures")),
            "cut_start_text": minute_text(F.col("cut_start")),
            "cut_end_text": minute_text(F.col("cut_end")),
            "cut_diff_sec": span,
            "cut_diff_hhmm": hhmm(F.coalesce(span, F.lit(0))),
            "cut_diff_min": _minutes(span),
            "cut_span_min": minutes_of(F.col("cut_span")),
            "cut_time_hours": F.coalesce(F.col("_hours"), F.lit(0)),
        }
    ).drop("_hours")


def late_incidents(df: DataFrame, keep_newlines: bool = False) -> Late:
    """The incident extract, cleaned behind its joins."""
    return Late(_keyed(df, INCIDENTS, "nro_incidencia", "_inc", [], keep_newlines), lambda rows: _incident_fields(rows, keep_newlines))


def prepare_incidents(df: DataFrame, keep_newlines: bool = False) -> DataFrame:
    """The incident extract, with the expected start of the outage."""
    return late_incidents(df, keep_newlines).frame()


def _incident_fields(rows: DataFrame, keep_newlines: bool) -> DataFrame:
    df, others = _opened(rows, INCIDENTS, "_inc", [], keep_newlines)
    text = lambda c: _text(df, c)
    out = df.select(
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(others)],
        text("cid").alias("inc_cid"),
        text("tipo_caso").alias("inc_case"),
        text("it_determinacion_de_la_causa").alias("inc_cause"),
        _integer("codincidencepadre").alias("inc_parent"),
        F.col("masivo").cast("string").alias("inc_mass"),
        F.col("tipificacion_problema").cast("string").alias("inc_problem"),
        F.col("tipificacion_tipo").cast("string").alias("inc_class"),
        F.col("it_medidas_tomadas").cast("string").alias("inc_measures"),
        _time(df, "interrupcion_inicio", *DAY_FIRST).alias("inc_start"),
        _time(df, "interrupcion_fin", *DAY_FIRST).alias("inc_end"),
        floor_minute(_time(df, "fecha_generacion", *DAY_FIRST)).alias("_generated"),
    )
    out = out.withColumns(
        {"_started": floor_minute(F.col("inc_start")), "inc_end_min": floor_minute(F.col("inc_end"))}
    )
    start = expected_start(F.col("inc_mass") == "Si", F.col("_generated"), F.col("_started"), F.col("inc_end_min"))
    out = out.withColumn("exp_start", start).drop("_generated", "_started")
    span = seconds_between(F.col("exp_start"), F.col("inc_end_min"))
    whole = F.coalesce(span, F.lit(0))
    return out.withColumns(
        {
            "exp_start_text": minute_text(F.col("exp_start")),
            "inc_end_text": minute_text(F.col("inc_end_min")),
            "inc_sec": whole,
            "inc_hhmm": hhmm(whole),
            "inc_min": _minutes(whole),
            "inc_span_min": span / F.lit(60.0),
        }
    )


def prepare_stops(df: DataFrame) -> DataFrame:
    """Clock stops: ticket, startdate, enddate (null while open) and any extra columns."""
    return df.withColumns(
        {
            "nro_incidencia": strip(F.col("nro_incidencia").cast("string")),
            "startdate": _time(df, "startdate", *DAY_FIRST),
            "enddate": _time(df, "enddate", *DAY_FIRST),
        }
    )


def prepare_circuits(df: DataFrame) -> DataFrame:
    """Circuit to service id, district and site."""
    text = lambda c: as_text(F.col(f"`{c}`"))
    return df.select(
        F.coalesce(F.col("CID").cast("string"), F.lit("nan")).alias("inc_cid"),
        integer_part(F.col("CUISMP")).alias("map_service"),
        text("Distrito Fiscal").alias("map_district"),
        text("SEDE").alias("map_site"),
    )


def prepare_faults(df: DataFrame, component: str | Column) -> DataFrame:
    """Fault table rows labelled with the component of their document."""
    df = df.withColumnsRenamed({"Tiempo\nTotal (HH:MM)": "Tiempo Total (HH:MM)"})
    missing = [c for c in (*FAULT_COLUMNS, "responsable") if c not in df.columns]
    if missing:
        raise ContractError(f"fault table: missing columns {missing}")
    cell = lambda c: F.col(f"`{c}`").cast("string")
    return df.select(
        F.coalesce(cell("Número de ticket"), F.lit("nan")).alias("nro_incidencia"),
        _label(component).alias("word_component"),
        _time(df, "Fecha y Hora Inicio", "d/M/yyyy H:mm").alias("word_start"),
        _time(df, "Fecha y Hora Fin", "d/M/yyyy H:mm").alias("word_end"),
        cell("CUISMP").alias("word_service"),
        cell("Avería reportada").alias("word_case"),
        cell("Causa").alias("word_fault"),
        cell("Tiempo real de afectación (HH:MM)").alias("word_time"),
        cell("Distrito Fiscal").alias("word_district"),
        cell("Tiempo Total (HH:MM)").alias("word_span"),
        cell("responsable").alias("word_owner"),
    )


def prepare_reports(df: DataFrame, component: str | Column) -> DataFrame:
    """Technical reports labelled with the component of their document."""
    cell = lambda c: F.col(f"`{c}`").cast("string")
    return df.select(
        F.coalesce(cell("nro_incidencia"), F.lit("nan")).alias("nro_incidencia"),
        _label(component).alias("word_component"),
        cell("CUISMP").alias("word_service"),
        cell("Tipo Caso").alias("word_case"),
        cell("Observación").alias("word_note"),
        cell(CAUSE).alias("word_cause"),
        cell(MEASURES).alias("word_measures"),
        cell("Fecha y hora inicio").alias("word_start_text"),
        cell("Fecha y hora fin").alias("word_end_text"),
    )


def prepare_annexes(df: DataFrame, component: str | Column) -> DataFrame:
    """Outage annexes labelled with the component of their document."""
    return df.select(
        F.coalesce(F.col("ticket").cast("string"), F.lit("nan")).alias("nro_incidencia"),
        _label(component).alias("annex_component"),
        F.col("indisponibilidad_header").alias("annex_header"),
        F.col("indisponibilidad_periodos").alias("annex_periods"),
        F.col("indisponibilidad_total").alias("annex_total"),
    )
