"""Service-level, attendance and client-report pipelines over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.dialect import Duck, Spark
from catalog.inputs import duck_cte, incident_columns, select_list, spark_frame
from cotejo.plans import attendance, client_report, sla

# --- service level ---------------------------------------------------------

CLIENT = (
    "case o_custkey % 9 when 0 then 'UNIVERSIDAD NACIONAL MAYOR DE SAN MARCOS' when 1 then 'ASOCIACION DE BANCOS DEL PERU' "
    "when 2 then 'SUPERINT. NAC. DE LOS REGISTROS PUBLICOS' when 3 then 'REGISTRO NACIONAL DE IDENTIFICACION Y ESTADO CIVIL' "
    "when 4 then 'CAJA MUNICIPAL DE CREDITO POPULAR DE LIM A' when 5 then 'CAJA MUNICIPAL DE CREDITO POPULAR DE LIMA' "
    "when 6 then '' when 7 then null else 'OTRO CLIENTE' end"
)


def sla_columns(d) -> dict[str, str]:
    return {
        "ticket": "o_orderkey",
        "cid": f"concat('C', {d.text('o_custkey')})",
        "nombre_cliente": CLIENT,
        "compute_0044": f"case o_orderpriority when '5-LOW' then null when '2-HIGH' then 'solo' else concat('x| ', {d.text('o_orderkey % 30')}, ' |', {d.text('o_custkey % 12')}, '.5') end",
        "tipificacion_problema": "case o_orderpriority when '1-URGENT' then 'CORTE DE FIBRA' when '2-HIGH' then 'CORTE DE FIBRA OPTICA TRONCAL DE RED - CASO FORTUITO' when '3-MEDIUM' then null else 'OTRO' end",
        "tiempo_interrupcion": f"case when o_orderkey % 13 = 0 then 'sin dato' else {d.text('cast(o_orderkey % 80 as double) / 4')} end",
        "caso": "case o_orderkey % 7 when 0 then 'SOLICITUD' when 1 then 'FT' when 2 then 'SIN SERVICIO' when 3 then 'Sin Servicio-Monitoreo' when 4 then 'DEGRADACION' when 5 then 'Degradacion-Monitoreo' else null end",
        "tipificacion_tipo": "case when o_orderstatus = 'P' then null else o_orderstatus end",
        "usuario_cierra": f"case o_orderpriority when '1-URGENT' then concat('C2', {d.text('o_custkey')}) when '2-HIGH' then 'WGARCIA' when '3-MEDIUM' then concat('T', {d.text('o_custkey')}) when '5-LOW' then null else concat('E', {d.text('o_custkey')}) end",
        "otpint": "case when o_orderstatus = 'F' then o_custkey end",
        "sotpint": "case when o_orderkey % 4 = 0 then 'x' end",
        "sotwimax": "case when o_orderkey % 10 = 0 then 1 end",
        "otpext": "case when o_orderpriority = '1-URGENT' then 2 end",
        "sotpext": "case when o_orderstatus = 'O' then '' end",
        "remedy": "case when o_custkey % 2 = 0 then 'r' end",
    }


MEDIA = {
    "cid": "concat('C', {key})",
    "medio": "case c_mktsegment when 'BUILDING' then 'Fibra' when 'MACHINERY' then 'Microondas' when 'FURNITURE' then 'Cobre' when 'HOUSEHOLD' then 'Satelital' else null end",
}


def _media(d) -> dict[str, str]:
    return {n: e.format(key=d.text("c_custkey")) for n, e in MEDIA.items()}


def _sla(spark: SparkSession, sf: str) -> DataFrame:
    extract = spark_frame(spark, sf, "orders", sla_columns(Spark))
    return sla.fill_sla(extract, spark_frame(spark, sf, "customer", _media(Spark)))


SLA_OUT = ("ticket", "mediotx", "fo", "mo", "tip_interr_filtrado", "slacomp", "tipo_usuario_cierra", "desp", "desplazamiento")


def sla_fill(spark: SparkSession, sf: str) -> DataFrame:
    return _sla(spark, sf).select(*SLA_OUT)


def sla_compliance_by_row(spark: SparkSession, sf: str) -> DataFrame:
    return _sla(spark, sf).select("ticket", sla.compliance_by_row().alias("slacomp"))


_MAP = (
    "case nombre_cliente when 'UNIVERSIDAD NACIONAL MAYOR DE SAN MARCOS' then 0.25 when 'ASOCIACION DE BANCOS DEL PERU' then 2 "
    "when 'SUPERINT. NAC. DE LOS REGISTROS PUBLICOS' then 1 when 'REGISTRO NACIONAL DE IDENTIFICACION Y ESTADO CIVIL' then 0.5 "
    "when 'CAJA MUNICIPAL DE CREDITO POPULAR DE {last}' then 0.72 end"
)
_EXEMPT = (
    "nombre_cliente in ('UNIVERSIDAD NACIONAL MAYOR DE SAN MARCOS', 'ASOCIACION DE BANCOS DEL PERU', 'SUPERINT. NAC. DE LOS REGISTROS PUBLICOS', "
    "'REGISTRO NACIONAL DE IDENTIFICACION Y ESTADO CIVIL', 'CAJA MUNICIPAL DE CREDITO POPULAR DE LIM A')"
)
SLA_CTES = f"""with e as (select {select_list(sla_columns(Duck))} from orders), media as (select {select_list(_media(Duck))} from customer),
a as (select e.*, medio as mediotx,
  cast(coalesce({_MAP.format(last='LIM A')}, try_cast(trim(split_part(compute_0044, '|', 2)) as double), 0) as double)
    + case when tipificacion_problema in ('CORTE DE FIBRA', 'CORTE DE FIBRA OPTICA TRONCAL DE RED - CASO FORTUITO') then 8 else 0 end as fo,
  cast(coalesce({_MAP.format(last='LIMA')}, try_cast(trim(split_part(compute_0044, '|', 3)) as double), 0) as double) as mo,
  coalesce(try_cast(tiempo_interrupcion as double), 0) as hours,
  concat('ATCORP', case when otpint is not null or sotpint is not null then '+SOTPINTCORP' else '' end, case when sotwimax is not null then '+PINTWIMAX' else '' end,
    case when otpext is not null or sotpext is not null then '+SOTPEXT' else '' end, case when remedy is not null then '+REMEDY' else '' end) as desp
  from e left join media using (cid)),
b as (select *, case when hours < 1 and not coalesce({_EXEMPT}, false) and coalesce(nombre_cliente, 'x') <> '' then 1.0 else hours end as tip_interr_filtrado from a),
c as (select *, caso in ('SIN SERVICIO', 'Sin Servicio-Monitoreo', 'DEGRADACION', 'Degradacion-Monitoreo') as measured,
  (mediotx in ('Fibra', 'Cobre') and tip_interr_filtrado <= fo) or mediotx = 'Microondas' as within from b)"""
SLA_SQL = f"""{SLA_CTES}
select ticket, mediotx, fo, mo, tip_interr_filtrado,
  case when measured and within then '1' when caso in ('SOLICITUD', 'FT') then caso
    when mediotx = 'Satelital' then mediotx else '0' end as slacomp,
  case when left(usuario_cierra, 2) = 'C2' then 'P' when usuario_cierra = 'WGARCIA' or left(usuario_cierra, 1) = 'T' then 'C' else left(usuario_cierra, 1) end as tipo_usuario_cierra,
  desp, case desp when 'ATCORP+SOTPEXT' then 'ATCORP+SOTPINTCORP+SOTPEXT' when 'ATCORP+SOTPEXT+REMEDY' then 'ATCORP+SOTPINTCORP+SOTPEXT'
    when 'ATCORP+SOTPINTCORP+SOTPEXT+REMEDY' then 'ATCORP+SOTPINTCORP+SOTPEXT' when 'ATCORP+SOTPINTCORP+REMEDY' then 'ATCORP+SOTPINTCORP' else desp end as desplazamiento
from c"""
SLA_ROW_SQL = f"""{SLA_CTES}
select ticket, case when caso in ('SOLICITUD', 'FT') then caso when mediotx in ('Fibra', 'Cobre', 'Microondas') and measured then case when within then '1' else '0' end
  when coalesce(tipificacion_tipo, '') = '' then 'SinTip' end as slacomp from c"""

# --- attendance ------------------------------------------------------------

# One name per user with four words, so its short form is unique.
AGENT = "concat('Ana', {user}, ' María Núñez', {user}, ' Ríos')"


def agent_columns(d) -> dict[str, str]:
    user = d.text("user_id")
    return {
        "source_row": "event_id",
        "Fecha": d.second_text("ts"),
        "Anexo": user,
        "Usuario": f"concat(' ', {AGENT.format(user=user)})",
        "Evento": "event_type",
        "Motivo": "'-'",
    }


def logged_columns(d) -> dict[str, str]:
    user = d.text("user_id")
    day = "date_format(ts, 'yyyy-MM-dd')" if d is Spark else "strftime(ts, '%Y-%m-%d')"
    clock = "date_format(ts, 'H:mm:ss')" if d is Spark else "strftime(ts, '%-H:%M:%S')"
    return {
        "source_row": "event_id",
        "ANALISTA": AGENT.format(user=user),
        "MODALIDAD": "event_type",
        "FECHA": day,
        "LOGUEO/INGRESO": f"case when event_type = 'error' then 'falta' else {clock} end",
    }


def _agents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = spark_frame(spark, sf, "events", agent_columns(Spark))
    return attendance.call_centre_presence(rows, "source_row")


def _logged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = spark_frame(spark, sf, "events", logged_columns(Spark))
    return attendance.logged_presence(rows, "source_row")


def _days_as_text(df: DataFrame) -> DataFrame:
    dates = [n for n, t in df.dtypes if t == "date"]
    return df.withColumns({n: F.col(n).cast("string") for n in dates}) if dates else df


def call_centre_presence(spark: SparkSession, sf: str) -> DataFrame:
    return _days_as_text(_agents(spark, sf)[0])


def call_centre_review(spark: SparkSession, sf: str) -> DataFrame:
    return _days_as_text(_agents(spark, sf)[1])


def logged_presence(spark: SparkSession, sf: str) -> DataFrame:
    return _days_as_text(_logged(spark, sf)[0])


AGENT_CTES = f"""{duck_cte('ncc', 'events', agent_columns(Duck))},
ncc_t as (select *, strptime("Fecha", '%d/%m/%Y %H:%M:%S') as t, left(strptime("Fecha", '%d/%m/%Y %H:%M:%S')::varchar, 10) as d from ncc),
ncc_first as (select source_row, "Anexo", "Usuario", "Evento", "Motivo", d as "Fecha", strftime(t, '%H:%M:%S') as "HoraEntrada", d as "Fecha_NCC",
  split_part(trim("Usuario"), ' ', 1) || ' ' || split_part(trim("Usuario"), ' ', 3) as "Usuario_NCC"
  from ncc_t qualify row_number() over (partition by "Usuario", d order by t, source_row) = 1)"""
LOGGED_CTES = f"""{duck_cte('sem', 'events', logged_columns(Duck))},
sem_first as (select source_row, "ANALISTA" as "Usuario", "MODALIDAD", "FECHA",
  case when "LOGUEO/INGRESO" = 'falta' then null else lpad("LOGUEO/INGRESO", 8, '0') end as "LOGUEO/INGRESO", "FECHA" as "Fecha_Semaforo",
  split_part("ANALISTA", ' ', 1) || ' ' || split_part("ANALISTA", ' ', 3) as "Usuario_Semaforo"
  from sem qualify row_number() over (partition by "ANALISTA", "FECHA" order by source_row) = 1)"""


# Rosters: one sheet per nation, one row per customer, one label per day.
DESK_DAYS, GENERAL_DAYS = 5, 3
ROSTER_NAME = "concat('José ', {key}, ' Peña')"
ROSTER_SHIFT = "case when (c_custkey + {i}) % 4 = 0 then null when (c_custkey + {i}) % 4 = 1 then 'DESCANSO' else concat('0', {key5}, ':30 - 17:00') end"


def _cells(spark: SparkSession, sf: str, name_col: int, first_col: int, stride: int, days: int, first_row: int) -> DataFrame:
    cell = lambda col, value: F.struct(F.lit(col).alias("col"), F.expr(value).alias("value"))
    key = Spark.text("c_custkey")
    names = cell(name_col, f"case when c_custkey % 10 = 3 then 'Turno' else {ROSTER_NAME.format(key=key)} end")
    shifts = [
        cell(first_col + i * stride, ROSTER_SHIFT.format(i=i, key5=Spark.text("c_custkey % 10"))) for i in range(days)
    ]
    body = read_customer(spark, sf).select(
        F.col("c_nationkey").alias("sheet"), (F.col("c_custkey") + first_row).alias("row"), F.explode(F.array(names, *shifts)).alias("c")
    )
    labels = [cell(first_col + i * stride, f"'Lunes {i + 6}/1/2025'") for i in range(days)]
    tops = F.array(*labels)
    head = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.col("n_nationkey").alias("sheet"), F.lit(0).cast("bigint").alias("row"), F.explode(tops).alias("c")
    )
    return head.unionByName(body).select("sheet", "row", "c.col", "c.value").where("value is not null")


def read_customer(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet")


def _desk(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return attendance.desk_roster(_cells(spark, sf, 0, 3, 2, DESK_DAYS, 1))


def _general(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Column 0 is filled from row 0 to row 3, so bodies begin at row 6."""
    top = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.col("n_nationkey").alias("sheet"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("row"),
        F.lit(0).alias("col"), F.lit("Mesa").alias("value"),
    )
    return attendance.general_roster(_cells(spark, sf, 1, 2, 3, GENERAL_DAYS, 1).unionByName(top))


def desk_roster(spark: SparkSession, sf: str) -> DataFrame:
    return _days_as_text(_desk(spark, sf)[0])


def general_roster(spark: SparkSession, sf: str) -> DataFrame:
    return _days_as_text(_general(spark, sf)[0])


def desk_roster_review(spark: SparkSession, sf: str) -> DataFrame:
    return _days_as_text(_desk(spark, sf)[1])


def _roster_cte(name: str, days: int, where: str) -> str:
    key = Duck.text("c_custkey")
    user = f"case when c_custkey % 10 = 3 then 'TURNO' else 'JOSE ' || {key} || ' PENA' end"
    parts = "\nunion all ".join(
        f"select c_nationkey, c_custkey, {i} as i, '2025-01-{i + 6:02d}' as d, {user} as u, {ROSTER_SHIFT.format(i=i, key5=Duck.text('c_custkey % 10'))} as t from customer"
        for i in range(days)
    )
    return f"""{name}_all as ({parts}), {name}_kept as (select *, case when strpos(t, ':') > 0 then trim(split_part(t, ' - ', 1)) else t end as h
  from {name}_all where t is not null and {where}),
{name} as (select * from {name}_kept qualify row_number() over (partition by u, d order by c_nationkey, c_custkey, i) = 1)"""


def _roster_out(name: str, source: str) -> str:
    return f'select d as "Fecha_{name}", u as "Usuario_{name}", t as "Turno_{name}", h as "Hora_Inicial_{name}" from {source}'


DESK_CTE = _roster_cte("desk", DESK_DAYS, "c_custkey + 1 >= 2")
GENERAL_CTE = _roster_cte("gen", GENERAL_DAYS, "c_custkey + 1 >= 6 and c_custkey % 10 <> 3")


def _both_rosters(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of both rosters, from one pass over nations and one over customers."""

    def cells(roster: str, row: str, col, value: str):
        return F.struct(F.lit(roster).alias("roster"), F.expr(row).cast("bigint").alias("row"), F.lit(col).alias("col"), F.expr(value).alias("value"))

    key, key5 = Spark.text("c_custkey"), Spark.text("c_custkey % 10")
    name = f"case when c_custkey % 10 = 3 then 'Turno' else {ROSTER_NAME.format(key=key)} end"
    body, head = [], [cells("General", str(i), 0, "'Mesa'") for i in range(4)]
    for roster, (name_col, first, stride, days) in {"Mesa": (0, 3, 2, DESK_DAYS), "General": (1, 2, 3, GENERAL_DAYS)}.items():
        body.append(cells(roster, "c_custkey + 1", name_col, name))
        for i in range(days):
            body.append(cells(roster, "c_custkey + 1", first + i * stride, ROSTER_SHIFT.format(i=i, key5=key5)))
            head.append(cells(roster, "0", first + i * stride, f"'Lunes {i + 6}/1/2025'"))
    customers = read_customer(spark, sf).select(F.col("c_nationkey").alias("sheet"), F.inline(F.array(*body)))
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("sheet"), F.inline(F.array(*head)))
    return nations.unionByName(customers).where("value is not null")


def attendance_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Both presences with both rosters, which are put on the agents' names and days."""
    ncc, sem = _agents(spark, sf)[0], _logged(spark, sf)[0]
    shifts = attendance.rosters(_both_rosters(spark, sf)).withColumns({"user": _roster_user(F.col("user")), "date": F.date_sub("date", 366)})
    out = attendance.combined_rows(sem, ncc, shifts, date(2000, 1, 1), date(2100, 1, 1))
    return out.select(
        "UsuarioC", F.col("FechaC").cast("string").alias("FechaC"), "Hora_SEMAFORO", "Hora_NCC", "Turno_General", "Hora_Inicial_General",
        "Turno_Mesa", "Hora_Inicial_Mesa", "UsuarioC_formato", "FechaC_formato",
    )


def attendance_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same from four frames of their own, where the last may have a user and day more than once."""
    ncc, sem = _agents(spark, sf)[0], _logged(spark, sf)[0]
    desk, general = _desk(spark, sf)[0], _general(spark, sf)[0]
    shift = lambda df, n: df.withColumns(
        {f"Usuario_{n}": _roster_user(F.col(f"Usuario_{n}")), f"Fecha_{n}": F.date_sub(f"Fecha_{n}", 366)}
    )
    out = attendance.combined(sem, ncc, shift(general, "General"), shift(desk, "Mesa"))
    return out.select("UsuarioC", F.col("FechaC").cast("string").alias("FechaC"), "Hora_SEMAFORO", "Hora_NCC", "Turno_General", "Turno_Mesa")


def _roster_user(c):
    """Roster names in the spelling of the short agent names."""
    return F.regexp_replace(c, r"^JOSE (\d+) PENA$", "Ana$1 Núñez$1")


COMBINED_SQL = f"""with {AGENT_CTES}, {LOGGED_CTES}, {DESK_CTE}, {GENERAL_CTE},
n as (select "Usuario_NCC" as u, "Fecha_NCC" as d, "HoraEntrada" as h from ncc_first),
s as (select "Usuario_Semaforo" as u, "Fecha_Semaforo" as d, "LOGUEO/INGRESO" as h, "Usuario" as name from sem_first),
g as (select regexp_replace(u, '^JOSE (\\d+) PENA$', 'Ana\\1 Núñez\\1') as u, strftime(d::date - 366, '%Y-%m-%d') as d, t, h from gen),
k as (select regexp_replace(u, '^JOSE (\\d+) PENA$', 'Ana\\1 Núñez\\1') as u, strftime(d::date - 366, '%Y-%m-%d') as d, t, h from desk),
sp as (select u, d from n union select u, d from s union select u, d from g union select u, d from k)
select sp.u as "UsuarioC", sp.d as "FechaC", s.h as "Hora_SEMAFORO", n.h as "Hora_NCC", g.t as "Turno_General", g.h as "Hora_Inicial_General",
  k.t as "Turno_Mesa", k.h as "Hora_Inicial_Mesa",
  split_part(name, ' ', 3) || ' ' || split_part(name, ' ', 4) || ' ' || split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) as "UsuarioC_formato",
  strftime(sp.d::date, '%d/%m/%Y') as "FechaC_formato"
from sp left join s using (u, d) left join n using (u, d) left join g using (u, d) left join k using (u, d)"""

# --- client report ---------------------------------------------------------


def client_rows(spark: SparkSession, sf: str) -> DataFrame:
    report = spark_frame(
        spark, sf, "orders", {**incident_columns(Spark), "tipificacion_problema": _problem(Spark)}
    )
    sites = spark_frame(spark, sf, "customer", {"cid": f"concat('C', {Spark.text('c_custkey')})", "sede": "c_name"})
    return client_report.in_report_order(client_report.client_rows(report, sites), "nro_incidencia")


def _problem(d) -> str:
    return (
        "case o_orderpriority when '1-URGENT' then ' PROBLEMA DE ENERGIA COMERCIAL EN SITE/POP NORTE - X' "
        "when '5-LOW' then null else concat('FALLA ', o_orderstatus, ' - ', o_orderpriority) end"
    )


_TS = lambda c: f"try_strptime(coalesce({c}, '-'), ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M'])"
_FM = lambda c: f"strftime({_TS(c)}, '%d/%m/%Y %H:%M')"
CLIENT_SQL = f"""with {duck_cte('r', 'orders', {**incident_columns(Duck), 'tipificacion_problema': _problem(Duck)})},
site as (select concat('C', {Duck.text('c_custkey')}) as cid, c_name as sede from customer),
x as (select r.* replace (trim(it_medidas_tomadas) as it_medidas_tomadas, trim(it_determinacion_de_la_causa) as it_determinacion_de_la_causa,
    case canal_ingreso when 'e-mail' then 'Reportado por el usuario' when 'Telefono' then 'Reportado por el usuario' else canal_ingreso end as canal_ingreso),
  string_split(it_conclusiones, chr(10)) as ls from r)
select nro_incidencia, canal_ingreso, {_FM('interrupcion_inicio')} as interrupcion_inicio, {_FM('fecha_generacion')} as fecha_generacion,
  {_FM('interrupcion_fin')} as interrupcion_fin, cid, tipo_caso,
  case when tipificacion_problema like '%PROBLEMA DE ENERGIA COMERCIAL EN SITE/POP%' then 'PROBLEMA DE ENERGIA COMERCIAL EN SITE/POP'
    when tipificacion_problema is null then '' else trim(split_part(tipificacion_problema, '-', 1)) end as tipificacion_problema,
  it_determinacion_de_la_causa, it_medidas_tomadas, it_conclusiones, tiempo_interrupcion, tipificacion_interrupcion,
  case tipificacion_tipo when 'CLARO - DEGRADACION' then 'CLARO' when 'TERCEROS - CORTE' then 'TERCEROS' else tipificacion_tipo end as tipificacion_tipo,
  case when canal_ingreso = 'Proactivo' then '-' else {_FM('fecha_comunicacion_cliente')} end as fecha_comunicacion_cliente,
  '-' as fecha_hora_llegada_personal, '-' as tiempo_llegada_personal, cast(0 as integer) as horas_excedidas_plazo_reparacion_bases,
  'Se detectó la pérdida de gestión del servicio en los Sistemas de Monitoreo de Claro.' as descripcion_problema,
  {_TS('interrupcion_inicio')} as interrupcion_inicio_ts, ls[1] as mejoras, ls[2] || chr(10) || ls[3] as recomendaciones, sede
from x left join site using (cid)"""

QUERIES = {
    "sla_fill": sla_fill,
    "sla_compliance_by_row": sla_compliance_by_row,
    "call_centre_presence": call_centre_presence,
    "call_centre_review": call_centre_review,
    "logged_presence": logged_presence,
    "desk_roster": desk_roster,
    "general_roster": general_roster,
    "desk_roster_review": desk_roster_review,
    "attendance_combined": attendance_combined,
    "attendance_joined": attendance_joined,
    "client_rows": client_rows,
}

SQL = {
    "sla_fill": SLA_SQL,
    "sla_compliance_by_row": SLA_ROW_SQL,
    "call_centre_presence": f"with {AGENT_CTES}\nselect * from ncc_first",
    "call_centre_review": f"""with {AGENT_CTES}
select source_row, t as "Fecha", "Anexo", "Usuario", "Evento", "Motivo", d as "Día" from ncc_t qualify count(*) over (partition by "Usuario", d) > 1""",
    "logged_presence": f"with {LOGGED_CTES}\nselect * from sem_first",
    "desk_roster": f"with {DESK_CTE}\n{_roster_out('Mesa', 'desk')}",
    "general_roster": f"with {GENERAL_CTE}\n{_roster_out('General', 'gen')}",
    "desk_roster_review": f"with {DESK_CTE}\n{_roster_out('Mesa', 'desk_kept qualify count(*) over (partition by u, d) > 1')}",
    "attendance_combined": COMBINED_SQL,
    "attendance_joined": f'select "UsuarioC", "FechaC", "Hora_SEMAFORO", "Hora_NCC", "Turno_General", "Turno_Mesa" from ({COMBINED_SQL})',
    "client_rows": CLIENT_SQL,
}
