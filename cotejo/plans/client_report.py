"""Rows of the client's incident report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import (
    drop_trailing_date_lines,
    label_if_contains,
    leading_token,
    replace_values,
    split_narrative,
)
from cotejo.functions.times import DAY_FIRST, minute_text, parse
from cotejo.operators.joins import lookup
from cotejo.sources.contracts import CLIENT_REPORT, conform_text

# Replacements and constant cells.
CHANNELS = {
    "e-mail": "Reportado por el usuario",
    "Telefono": "Reportado por el usuario",
    "Interno": "Reportado por el usuario",
}
ATTRIBUTION = {"CLARO - DEGRADACION": "CLARO", "TERCEROS - CORTE": "TERCEROS"}
POWER_PROBLEM = "PROBLEMA DE ENERGIA COMERCIAL EN SITE/POP"
PROBLEM_TEXT = "Se detectó la pérdida de gestión del servicio en los Sistemas de Monitoreo de Claro."
PROACTIVE = "Proactivo"
TIMES = ("interrupcion_inicio", "fecha_generacion", "interrupcion_fin", "fecha_comunicacion_cliente")


def client_rows(
    report: DataFrame,
    sites: DataFrame,
    formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd H:mm", "yyyy-MM-dd", *DAY_FIRST),
    carry: Sequence[str] = (),
) -> DataFrame:
    """The contracted report with derived columns and site attributes.

    ``interrupcion_inicio_ts`` keeps the start as a time; sort by it at the sink
    with ``in_report_order``.
    """
    df = conform_text(report, CLIENT_REPORT, carry=carry)
    moment = {t: parse(F.col(t), *formats) for t in TIMES}
    channel = replace_values(F.col("canal_ingreso"), CHANNELS)
    parts = split_narrative(F.col("it_conclusiones"))
    contact = minute_text(moment["fecha_comunicacion_cliente"], None)
    df = df.withColumns(
        {
            "canal_ingreso": channel,
            "fecha_hora_llegada_personal": F.lit("-"),
            "tiempo_llegada_personal": F.lit("-"),
            "horas_excedidas_plazo_reparacion_bases": F.lit(0),
            "descripcion_problema": F.lit(PROBLEM_TEXT),
            "interrupcion_inicio_ts": moment["interrupcion_inicio"],
            **{t: minute_text(moment[t], None) for t in TIMES[:3]},
            "fecha_comunicacion_cliente": F.when(channel == PROACTIVE, F.lit("-")).otherwise(contact),
            "tipificacion_problema": label_if_contains(leading_token(F.col("tipificacion_problema")), POWER_PROBLEM),
            "tipificacion_tipo": replace_values(F.col("tipificacion_tipo"), ATTRIBUTION),
            "mejoras": parts["before"],
            "recomendaciones": parts["after"],
            "it_medidas_tomadas": drop_trailing_date_lines(F.col("it_medidas_tomadas")),
        }
    )
    return lookup(df, sites, "cid", as_text=True)


def in_report_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Ascending outage start, unknown starts last."""
    return rows.orderBy(F.asc_nulls_last("interrupcion_inicio_ts"), *ties)
