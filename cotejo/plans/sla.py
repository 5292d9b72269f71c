"""Service-level report: medium, allowances, filtered hours, compliance, dispatch."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.numbers import holds, number_or_zero
from cotejo.functions.text import field, plus_flags, replace_values
from cotejo.functions.times import check_range
from cotejo.operators.joins import lookup

# Hours allowed per client, for fibre and for radio.  The last
# name is spelled differently in the two tables.
FIBRE_HOURS = {
    "UNIVERSIDAD NACIONAL MAYOR DE SAN MARCOS": 0.25,
    "ASOCIACION DE BANCOS DEL PERU": 2.0,
    "SUPERINT. NAC. DE LOS REGISTROS PUBLICOS": 1.0,
    "REGISTRO NACIONAL DE IDENTIFICACION Y ESTADO CIVIL": 0.5,
    "CAJA MUNICIPAL DE CREDITO POPULAR DE LIM A": 0.72,
}
RADIO_HOURS = {
    "UNIVERSIDAD NACIONAL MAYOR DE SAN MARCOS": 0.25,
    "ASOCIACION DE BANCOS DEL PERU": 2.0,
    "SUPERINT. NAC. DE LOS REGISTROS PUBLICOS": 1.0,
    "REGISTRO NACIONAL DE IDENTIFICACION Y ESTADO CIVIL": 0.5,
    "CAJA MUNICIPAL DE CREDITO POPULAR DE LIMA": 0.72,
}
# Clients that are exempt; a list of its own, apart from the allowances.
EXEMPT_CLIENTS = (
    "UNIVERSIDAD NACIONAL MAYOR DE SAN MARCOS",
    "ASOCIACION DE BANCOS DEL PERU",
    "SUPERINT. NAC. DE LOS REGISTROS PUBLICOS",
    "REGISTRO NACIONAL DE IDENTIFICACION Y ESTADO CIVIL",
    "CAJA MUNICIPAL DE CREDITO POPULAR DE LIM A",
)
FIBRE_CUTS = (
    "CORTE DE FIBRA",
    "CORTE DE FIBRA OPTICA / COBRE- CASO FORTUITO",
    "CORTE DE FIBRA OPTICA / COBRE DE ULTIMA MILLA - CASO FORTUITO",
    "CORTE DE FIBRA OPTICA TRONCAL DE RED - CASO FORTUITO",
)
FIBRE_CUT_HOURS = 8
NOT_MEASURED = ("SOLICITUD", "FT")
MEDIA = ("Fibra", "Microondas", "Cobre")
WIRED = ("Fibra", "Cobre")
RADIO = "Microondas"
MEASURED_CASES = ("SIN SERVICIO", "Sin Servicio-Monitoreo", "DEGRADACION", "Degradacion-Monitoreo")
UNTYPED = "SinTip"
SPECIAL_CLOSERS = ("NLEONARDO", "FROSALES", "LDELACRUZ", "WGARCIA", "WGAMERO")
DISPATCH = {
    "ATCORP+SOTPEXT": "ATCORP+SOTPINTCORP+SOTPEXT",
    "ATCORP+SOTPEXT+REMEDY": "ATCORP+SOTPINTCORP+SOTPEXT",
    "ATCORP+SOTPINTCORP+SOTPEXT+REMEDY": "ATCORP+SOTPINTCORP+SOTPEXT",
    "ATCORP+SOTPINTCORP+REMEDY": "ATCORP+SOTPINTCORP",
}


def add_medium(df: DataFrame, media: DataFrame) -> DataFrame:
    """``mediotx`` by circuit; ``media`` has ``cid`` and ``medio``."""
    return lookup(df, media.select("cid", F.col("medio").alias("mediotx")), "cid")


def _client_hours(hours: dict[str, float], pipe_field: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in hours.items() for x in pair])
    by_client = F.try_element_at(table, F.col("nombre_cliente"))
    return number_or_zero(
        F.coalesce(by_client.cast("string"), F.trim(field(F.col("compute_0044"), pipe_field)))
    )


def fibre_allowance() -> Column:
    hours = _client_hours(FIBRE_HOURS, 1)
    cut = holds(F.col("tipificacion_problema").isin(*FIBRE_CUTS))
    return F.when(cut, hours + FIBRE_CUT_HOURS).otherwise(hours)


def radio_allowance() -> Column:
    return _client_hours(RADIO_HOURS, 2)


def filtered_hours() -> Column:
    """At least one hour, except for exempt clients and blank client names."""
    client = F.col("nombre_cliente")
    hours = number_or_zero(F.col("tiempo_interrupcion"))
    floored = ~holds(client.isin(*EXEMPT_CLIENTS)) & ~holds(client == "")
    return F.when(floored & (hours < 1), F.lit(1.0)).otherwise(hours)


def compliance() -> Column:
    """``1``/``0``, or the case or medium text where compliance is not measured."""
    case, medium = F.col("caso"), F.col("mediotx")
    measured = holds(case.isin(*MEASURED_CASES))
    wired_ok = holds(medium.isin(*WIRED)) & (F.col("tip_interr_filtrado") <= F.col("fo"))
    return (
        F.when(measured & (wired_ok | holds(medium == RADIO)), F.lit("1"))
        .when(holds(case.isin(*NOT_MEASURED)), case)
        .when(~holds(medium.isin(*MEDIA)) & medium.isNotNull(), medium)
        .otherwise(F.lit("0"))
    )


def compliance_by_row(previous: Column | None = None) -> Column:
    """The row-wise variant: unmeasured media give ``SinTip`` or nothing.

    ``previous`` is an earlier compliance value; a row that has one and matches
    no branch stays empty.
    """
    case, medium = F.col("caso"), F.col("mediotx")
    known = holds(medium.isin(*MEDIA))
    measured = holds(case.isin(*MEASURED_CASES))
    wired_ok = holds(medium.isin(*WIRED)) & (F.col("tip_interr_filtrado") <= F.col("fo"))
    untyped = F.coalesce(F.col("tipificacion_tipo"), F.lit("")) == ""
    if previous is not None:
        untyped = untyped & previous.isNull()
    return (
        F.when(holds(case.isin(*NOT_MEASURED)), case)
        .when(known & measured & (wired_ok | holds(medium == RADIO)), F.lit("1"))
        .when(known & measured, F.lit("0"))
        .when(untyped, F.lit(UNTYPED))
    )


def closer_type() -> Column:
    user = F.col("usuario_cierra")
    first = F.substring(user, 1, 1)
    special = holds(user.isin(*SPECIAL_CLOSERS)) | holds(first == "T")
    return F.when(holds(F.substring(user, 1, 2) == "C2"), "P").when(special, "C").otherwise(first)


def dispatch() -> Column:
    has = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()
    return plus_flags(
        "ATCORP",
        [
            (has("otpint", "sotpint"), "SOTPINTCORP"),
            (has("sotwimax"), "PINTWIMAX"),
            (has("otpext", "sotpext"), "SOTPEXT"),
            (has("remedy"), "REMEDY"),
        ],
    )


def fill_sla(extract: DataFrame, media: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """The extract with every service-level column, in one projection per step.

    ``start`` and ``end`` are the days asked for; a range that ends before it starts raises.
    """
    check_range(start, end)
    return (
        add_medium(extract, media)
        .withColumns(
            {
                "fo": fibre_allowance(),
                "mo": radio_allowance(),
                "tip_interr_filtrado": filtered_hours(),
                "tiempo_interrupcion": number_or_zero(F.col("tiempo_interrupcion")),
                "tipificacion_tipo": F.coalesce("tipificacion_tipo", F.lit("")),
                "tipo_usuario_cierra": closer_type(),
                "desp": dispatch(),
            }
        )
        .withColumns(
            {"slacomp": compliance(), "desplazamiento": replace_values(F.col("desp"), DISPATCH)}
        )
    )
