"""Report inputs derived from the given tables, row for row.

The given tables are orders, lines, customers and events; the reports the
engine works on are built from them with plain expressions, written once for
both engines.  Every row of the source table takes part.  Priorities and
statuses decide how a row disagrees with its counterpart, so every check both
holds and fails somewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession



URGENT, HIGH, MEDIUM, OTHER, LOW = "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"
OPENING = (
    "A través de los Sistemas de Monitoreo de Claro, de manera proactiva se identificó"
)
STOPS_HEADER = "Se tuvo indisponibilidad por parte del cliente para continuar los trabajos el/los día(s)"
DATA_NOTE = "Se generó ticket para la revisión del servicio de datos de la sede "
VOICE_NOTE = "Se generó ticket para la revisión del servicio de telefonía de la sede "

# Orders whose ticket is known to the incidents, and to the word documents; the other rows bear a changed one.
INCIDENT_ROWS = f"not (o_orderstatus = 'P' and o_orderpriority in ('{URGENT}', '{LOW}'))"
FAULT_ROWS = f"o_orderstatus <> 'O' and o_orderpriority in ('{URGENT}', '{HIGH}', '{MEDIUM}') and o_totalprice > 100000"


def _ticket(d, known: str) -> str:
    return f"case when {known} then {d.text('o_orderkey')} else concat('9', lpad({d.text('o_orderkey')}, 12, '0')) end"


MINUTES = "(o_orderkey * 53 % 9000)"


def _start(d) -> str:
    return d.plus_seconds(d.ntz("o_orderdate"), "(o_orderkey * 37 % 1440) * 60")


def _end(d) -> str:
    return d.plus_seconds(_start(d), f"{MINUTES} * 60")


def _site(d) -> str:
    return f"concat('Customer#', lpad({d.text('o_custkey')}, 9, '0'))"


def _measures(d) -> str:
    """Narrative of the cut: opening, two dates, a repeated phrase, a typing slip."""
    return f"""concat(
        case o_orderstatus when 'O' then '{OPENING}' when 'F' then 'Se revisó el servicio' else '  A través de los sistemas' end,
        ' el día ', {d.minute_text(_start(d))}, ' horas, el corte del servicio con código ',
        {d.text('o_custkey * 7 + 1000')},
        case o_orderpriority when '{HIGH}' then ' A   través de personal, A través de un cliente / debido a corte' else ' de la sede' end,
        ' hasta el día ', {d.loose_minute_text(_end(d))}, ' horas.', {d.newline}, 'Fin del informe.  ')"""


def cut_columns(d) -> dict[str, str]:
    start, end = _start(d), _end(d)
    service = d.text("o_custkey * 7 + 1000")
    hours = d.div(MINUTES, 60)
    return {
        "TICKET": d.text("o_orderkey"),
        "FECHA Y HORA INICIO": start,
        "FECHA Y HORA FIN": f"case when o_orderpriority = '{OTHER}' and o_orderstatus = 'O' then null else {end} end",
        "CUISMP": f"case when o_orderpriority = '{LOW}' then 'S/N' else concat({service}, '.0') end",
        "TIPO CASO": f"case o_orderpriority when '{URGENT}' then 'SIN SERVICIO' when '{HIGH}' then 'ENLACE LENTO' when '{MEDIUM}' then ' SIN SERVICIO-MONITOREO ' when '{OTHER}' then 'DEGRADACION' else '   ' end",
        "AVERÍA": f"case when o_orderpriority = '{LOW}' then 'CORTE DE FIBRA' else concat('PROBLEMA EN LA ULTIMA MILLA DEL CLIENTE ', o_orderpriority) end",
        "TIEMPO (HH:MM)": f"case when o_orderpriority = '{MEDIUM}' then concat('1 day, ', {d.hhmm(MINUTES + ' % 1440')}, ':20') else concat({d.hhmm(MINUTES)}, ':00') end",
        "COMPONENTE": f"case o_orderpriority when '{URGENT}' then 'COMPONENTE II' when '{HIGH}' then 'COMPONENTE IV' when '{MEDIUM}' then 'COMPONENTE III' when '{OTHER}' then 'COMPONENTE V' else 'COMPONENTE I' end",
        "DF": f"case when o_orderpriority = '{URGENT}' then concat('DISTRITO ', {d.text('o_custkey % 25')}) else concat('Distrito ', {d.text('o_custkey % 24')}) end",
        "OBSERVACIÓN": f"concat(case when o_orderpriority = '{HIGH}' and o_orderstatus = 'O' then '{VOICE_NOTE}' else '{DATA_NOTE}' end, {_site(d)})",
        "CID": f"concat('C', {d.text('o_custkey')})",
        "FIN-INICIO (HH:MM)": f"case o_orderpriority when '{LOW}' then 'sin dato' when '{MEDIUM}' then concat({d.hhmm(MINUTES)}, ':30') else {d.hhmm(MINUTES)} end",
        "DETERMINACIÓN DE LA CAUSA": "concat('Falla de equipo ', o_orderstatus)",
        "RESPONSABILIDAD": "case o_orderstatus when 'F' then 'CLARO' when 'O' then 'TERCEROS' else ' CLIENTE ' end",
        "TIPO REPORTE": "case o_orderstatus when 'F' then 'RECLAMO' when 'O' then 'PROACTIVO' else 'OTRO' end",
        "Duracion entero": f"cast(case when o_orderpriority = '{LOW}' then {hours} + 1 else {hours} end as bigint)",
        "Agrupación entero": f"case when {hours} = 0 then ' Menor a 1h' when {hours} <= 3 then 'Entre 1h a 4h' when {hours} <= 7 then 'Entre 4h a 8h' when {hours} <= 23 then 'Entre 8h a 24h' else 'Mayor a 24h ' end",
        "CODINCIDENCEPADRE": f"case when o_orderstatus = 'F' then null else concat({d.text('o_custkey')}, '.0') end",
        "MASIVO": f"case when o_orderpriority = '{URGENT}' then 'Si' else 'No' end",
        "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS": _measures(d),
        "TIPO DE INCIDENCIA": "o_orderpriority",
        "TIEMPO INTERRUPCION": d.text("o_totalprice"),
        "INDISPONIBILIDAD": f"""case when o_orderstatus = 'O' then '' else concat(
            '{STOPS_HEADER}', {d.newline},
            ' ', {d.loose_text(start)}, ' hasta el día ', {d.loose_text(end)}, {d.newline},
            '(Total de horas sin acceso a la sede: ', {d.text(hours + ' % 10')}, ':05 horas)') end""",
        "source_row": "o_orderkey",
    }


def _closing(d) -> str:
    return f"concat(' Fecha y hora inicio: ', {d.minute_text(_start(d))}, ' Fecha y hora fin: ', {d.minute_text(_end(d))})"


def incident_columns(d) -> dict[str, str]:
    late = d.plus_seconds(_start(d), "40")
    made = d.plus_seconds(_start(d), "605")
    over = d.plus_seconds(_end(d), f"case when o_orderpriority = '{OTHER}' then 125 else 20 end")
    return {
        "nro_incidencia": _ticket(d, INCIDENT_ROWS),
        "canal_ingreso": "case o_orderstatus when 'F' then 'e-mail' when 'O' then 'Proactivo' else 'Telefono' end",
        "interrupcion_inicio": d.loose_text(late),
        "fecha_generacion": d.second_text(made),
        "interrupcion_fin": f"case when o_orderpriority = '{LOW}' and o_orderstatus = 'O' then 'pendiente' else {d.second_text(over)} end",
        "cid": f"case when o_orderpriority = '{LOW}' then concat('X', {d.text('o_custkey')}) else concat('C', {d.text('o_custkey')}) end",
        "tipo_caso": f"case o_orderpriority when '{URGENT}' then 'SIN SERVICIO' when '{HIGH}' then 'ENLACE LENTO' when '{MEDIUM}' then 'SIN SERVICIO-MONITOREO' else 'OTROS CALIDAD' end",
        "tipificacion_problema": f"case when o_orderpriority = '{LOW}' then 'CORTE DE COBRE' else 'PROBLEMA EN LA ULTIMA MILLA DEL CLIENTE' end",
        "it_determinacion_de_la_causa": f"concat(case o_orderpriority when '{URGENT}' then 'Componente IV - ' when '{HIGH}' then 'COMONENTE II .- ' when '{MEDIUM}' then 'COMPONENTE III ' else '' end, 'Falla de equipo ', o_orderstatus)",
        "it_medidas_tomadas": f"concat(case when o_orderstatus = 'P' then 'Sin fechas' else concat('Inicio ', {d.loose_minute_text(_start(d))}, ' y trabajos hasta ', {d.minute_text(_end(d))}, ' con pruebas de servicio durante la ventana') end, case when o_orderpriority = '{MEDIUM}' then '' else {_closing(d)} end)",
        "it_conclusiones": f"concat('Servicio repuesto', {d.newline}, 'Se Recomienda revisar energía', {d.newline}, 'y respaldo')",
        "tiempo_interrupcion": d.text("o_totalprice"),
        "tipificacion_interrupcion": "o_orderpriority",
        "tipificacion_tipo": "case o_orderstatus when 'F' then 'CLARO - DEGRADACION' when 'O' then 'TERCEROS - CORTE' else 'CLARO' end",
        "fecha_comunicacion_cliente": d.second_text(made),
        "masivo": f"case when o_orderpriority = '{URGENT}' then 'Si' else 'No' end",
        "codincidencepadre": f"case when o_orderstatus = 'F' then null when o_orderpriority = '{HIGH}' then concat({d.text('o_custkey')}, '.5') else {d.text('o_custkey + 0')} end",
    }


def stop_columns(d) -> dict[str, str]:
    start = d.plus_seconds(d.ntz("l_shipdate"), "(l_partkey * 61 % 1440) * 60 + l_suppkey % 60")
    end = d.plus_seconds(start, "cast(l_quantity as bigint) * 4 * 3600 + l_partkey % 50")
    return {
        "nro_incidencia": d.text("l_orderkey"),
        "startdate": start,
        "enddate": f"case when l_returnflag = 'A' and l_linestatus = 'O' then null else {end} end",
    }


def long_incident_columns(d) -> dict[str, str]:
    """Incidents long enough to hold the line items' stops."""
    cols = incident_columns(d)
    end = d.plus_seconds(d.ntz("o_orderdate"), "(40 + o_custkey % 60) * 86400")
    cols["interrupcion_fin"] = (
        f"case when o_orderpriority = '{LOW}' and o_orderstatus = 'O' then 'pendiente' else {d.second_text(end)} end"
    )
    return cols


def circuit_columns(d) -> dict[str, str]:
    return {
        "CID": f"concat('C', {d.text('c_custkey')})",
        "CUISMP": f"case when c_mktsegment = 'MACHINERY' then null else concat({d.text('c_custkey * 7 + 1000')}, '.0') end",
        "Distrito Fiscal": f"concat(' Distrito ', {d.text('c_custkey % 25')})",
        "SEDE": "case when c_mktsegment = 'FURNITURE' then null else c_name end",
    }


def fault_columns(d) -> dict[str, str]:
    """Fault table rows; those of some orders bear tickets that no cut has."""
    start, end = _start(d), _end(d)
    return {
        "Número de ticket": _ticket(d, FAULT_ROWS),
        "Fecha y Hora Inicio": d.loose_minute_text(start),
        "Fecha y Hora Fin": f"case when o_orderstatus = 'P' then 'por definir' else {d.minute_text(end)} end",
        "CUISMP": d.text("o_custkey * 7 + 1000"),
        "Avería reportada": "case when o_orderstatus = 'P' then 'OTRO' else 'SIN SERVICIO' end",
        "Causa": "concat('PROBLEMA EN LA ULTIMA MILLA DEL CLIENTE ', o_orderpriority)",
        "Tiempo real de afectación (HH:MM)": d.hhmm(MINUTES),
        "Distrito Fiscal": f"concat('DISTRITO ', {d.text('o_custkey % 25')})",
        "Tiempo Total (HH:MM)": d.hhmm(MINUTES),
        "responsable": "case when o_totalprice > 300000 then 'CLARO' else 'CLIENTE' end",
    }


def report_columns(d) -> dict[str, str]:
    """Technical reports of the same orders."""
    start, end = _start(d), _end(d)
    return {
        "nro_incidencia": _ticket(d, FAULT_ROWS),
        "CUISMP": d.text("o_custkey * 7 + 1000"),
        "Tipo Caso": "case when o_orderstatus = 'P' then '' else 'SIN SERVICIO' end",
        "Observación": f"concat('{DATA_NOTE}', {_site(d)})",
        "DETERMINACIÓN DE LA CAUSA": "concat('Falla de equipo ', o_orderstatus)",
        "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS": f"replace({_measures(d)}, ' el día ', case when o_orderstatus = 'P' then ' el  día ' else ' en el día ' end)",
        "Fecha y hora inicio": d.loose_minute_text(start),
        "Fecha y hora fin": d.minute_text(end),
    }


def annex_columns(d) -> dict[str, str]:
    """Outage annexes of the same orders; the first stop is the order's own."""
    start, end = _start(d), _end(d)
    return {
        "ticket": _ticket(d, FAULT_ROWS),
        "indisponibilidad_header": f"case when o_orderstatus = 'P' then 'Se tuvo indisponibilidad' else ' {STOPS_HEADER}' end",
        "indisponibilidad_periodos": f"concat({d.second_text(start)}, ' hasta el día ', {d.second_text(end)})",
        "indisponibilidad_footer": "''",
        "indisponibilidad_total": d.hhmm(MINUTES),
    }


def select_list(columns: dict[str, str], quote: str = '"') -> str:
    return ",\n  ".join(f"{e} as {quote}{n}{quote}" for n, e in columns.items())


def spark_frame(spark: SparkSession, sf: str, table: str, columns: dict[str, str], where: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    if where:
        df = df.where(where)
    return df.selectExpr(*[f"{e} as `{n}`" for n, e in columns.items()])


def duck_cte(name: str, table: str, columns: dict[str, str], where: str | None = None) -> str:
    tail = f" where {where}" if where else ""
    return f"{name} as (select {select_list(columns)} from {table}{tail})"


