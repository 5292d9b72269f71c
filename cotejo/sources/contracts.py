"""Contracted scans: required columns, cleaned text, nothing else read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.text import clean_cell
from cotejo.operators.scans import drop_last_rows


class ContractError(ValueError):
    """An input lacks required columns."""


@dataclass(frozen=True)
class Contract:
    """Required columns in output order."""

    name: str
    columns: Sequence[str]

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.columns)

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema())


# The columns each input must have.
OUTAGE_CUT = Contract(
    "outage cut",
    (
        "TICKET",
        "FECHA Y HORA INICIO",
        "FECHA Y HORA FIN",
        "CUISMP",
        "TIPO CASO",
        "AVERÍA",
        "TIEMPO (HH:MM)",
        "COMPONENTE",
        "DF",
        "OBSERVACIÓN",
        "CID",
        "FIN-INICIO (HH:MM)",
        "DETERMINACIÓN DE LA CAUSA",
        "RESPONSABILIDAD",
        "TIPO REPORTE",
        "Duracion entero",
        "Agrupación entero",
        "CODINCIDENCEPADRE",
        "MASIVO",
        "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS",
        "TIPO DE INCIDENCIA",
        "TIEMPO INTERRUPCION",
        "INDISPONIBILIDAD",
    ),
)
CLIENT_REPORT = Contract(
    "client report",
    (
        "nro_incidencia",
        "canal_ingreso",
        "interrupcion_inicio",
        "fecha_generacion",
        "interrupcion_fin",
        "cid",
        "tipo_caso",
        "tipificacion_problema",
        "it_determinacion_de_la_causa",
        "it_medidas_tomadas",
        "it_conclusiones",
        "tiempo_interrupcion",
        "tipificacion_interrupcion",
        "tipificacion_tipo",
        "fecha_comunicacion_cliente",
    ),
)
INCIDENTS = Contract("incident extract", (*CLIENT_REPORT.columns, "masivo", "codincidencepadre"))


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def conform(
    df: DataFrame,
    contract: Contract,
    footer_rows: int = 0,
    order: str | None = None,
    carry: Sequence[str] = (),
    keep_newlines: bool = True,
    null_text: str | None = None,
    on_error: str = "raise",
    clean: bool = True,
) -> DataFrame:
    """Apply a contract: strip headers, require, select, clean text columns.

    ``footer_rows`` drops the last rows by the ``order`` column.  ``carry``
    keeps extra columns such as a line number.  ``null_text`` gives missing text
    a spelling.  ``on_error='empty'`` returns an empty frame with the contract's
    columns instead of raising.  Without ``clean`` cells stay as they are.
    """
    df = strip_headers(df)
    missing = [c for c in contract.columns if c not in df.columns]
    if missing:
        if on_error == "empty":
            return contract.empty(df.sparkSession)
        raise ContractError(f"{contract.name}: missing columns {missing}")
    if footer_rows:
        if order is None:
            raise ValueError("dropping footer rows needs an order column")
        df = drop_last_rows(df, order, footer_rows)
    kinds = dict(df.dtypes)
    extra = [c for c in carry if c not in contract.columns]
    out = []
    for c in (*contract.columns, *extra):
        col = F.col(f"`{c}`")
        if clean and kinds[c] == "string" and c in contract.columns:
            col = clean_cell(col, keep_newlines)
            if null_text is not None:
                col = F.coalesce(col, F.lit(null_text))
        out.append(col.alias(c))
    return df.select(*out)


def conform_text(df: DataFrame, contract: Contract, missing: str = "-", carry: Sequence[str] = ()) -> DataFrame:
    """Contract over an all-text input; missing cells read ``missing``."""
    df = strip_headers(df)
    df = df.select(
        *[F.col(f"`{c}`").cast("string").alias(c) if c not in carry else F.col(f"`{c}`") for c in df.columns]
    )
    return conform(df, contract, carry=carry).fillna(missing, subset=list(contract.columns))
