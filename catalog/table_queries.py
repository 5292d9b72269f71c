"""Joins, duplicates, intervals, numbering, landed documents and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.dialect import Duck, Spark
from catalog.inputs import STOPS_HEADER
from catalog.validator_sql import hhmm, strip
from cotejo.operators import batches, dedupe, findings, intervals, joins, scans, sections
from cotejo.operators.rules import Check, Rule, evaluate
from cotejo.plans import extract
from cotejo.sources import files, landed


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# --- joins -----------------------------------------------------------------


def recon_matched(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    pages = read(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), "url"
    )
    return joins.matched(docs, pages, ["doc_id"], ("_document", "_page"))


def recon_left_only(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source")
    return joins.only_left(docs, read(spark, sf, "labels"), ["doc_id"])


def recon_right_only(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    return joins.only_right(pages, read(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"])


def enrich_defaults(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels").withColumn("verdict", F.expr("case when quality = 1 then 'bueno' else 'malo' end"))
    docs = read(spark, sf, "documents").select("doc_id", "source")
    return joins.enrich(docs, labels.select("doc_id", "verdict"), ["doc_id"], {"verdict": "no encontrado"})


def lookup_as_text(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("cid"), "n_name")
    cust = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("cid"))
    return joins.lookup(cust, nation, "cid", as_text=True)


def key_spine(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the events' days and of the days after, two frames over all rows."""
    ev = read(spark, sf, "events").select("user_id", "ts")
    days = [F.col("ts"), F.col("ts") + F.expr("interval 1 day")]
    return joins.spine([ev.select("user_id", F.date_format(t, "yyyy-MM-dd").alias("day")) for t in days], ["user_id", "day"])


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return joins.repeated_keys(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- duplicates ------------------------------------------------------------


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts"
    )


def duplicate_review(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.duplicates(_days(spark, sf), ["user_id", "day", "event_type"])


def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.first_per_key(_days(spark, sf), ["user_id", "day", "event_type"], ["event_id"])


def first_event_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.first_per_key(_days(spark, sf), ["user_id", "day"], ["ts", "event_id"])


def distinct_keys(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag").distinct()


# --- intervals -------------------------------------------------------------

STOP_END = "case when event_type = 'error' then null else ts + {iv} end"


def _stops(spark: SparkSession, sf: str) -> DataFrame:
    iv = "make_dt_interval(0, 0, cast(value * 10 as int), 0)"
    return read(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp_ntz").alias("start"),
        F.expr(STOP_END.format(iv=iv)).cast("timestamp_ntz").alias("end"),
    )


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    ev = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return ev.groupBy("user_id").agg(
        F.expr("min(ts) + make_dt_interval(2, 0, 0, 0)").alias("lo"),
        F.expr("max(ts) - make_dt_interval(1, 0, 0, 0)").alias("hi"),
    )


def clipped_stops(spark: SparkSession, sf: str) -> DataFrame:
    clipped = intervals.clip_stops(_stops(spark, sf), _bounds(spark, sf), "user_id")
    return clipped.select("event_id", "user_id", "start", "end")


def merged_stops(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_overlaps(_stops(spark, sf), ["user_id"], slice_days=3)


def stop_totals(spark: SparkSession, sf: str) -> DataFrame:
    clipped = intervals.clip_stops(_stops(spark, sf), _bounds(spark, sf), "user_id")
    return intervals.stop_totals(intervals.merge_overlaps(clipped, ["user_id"]), ["user_id"])


def stop_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    clipped = intervals.clip_stops(_stops(spark, sf), _bounds(spark, sf), "user_id")
    lists = intervals.stop_lists(intervals.merge_overlaps(clipped, ["user_id"]), ["user_id"])
    return lists.select(
        "user_id", *[c.alias(n) for n, c in intervals.paragraph(F.col("stops"), F.col("stop_micros")).items()]
    )


STOP_CTES = f"""with stops as (select event_id, user_id as k, ts as s,
  {STOP_END.format(iv='to_minutes(cast(trunc(value * 10) as bigint))')} as e from events),
bounds as (select user_id as k, min(ts) + to_days(2) as lo, max(ts) - to_days(1) as hi from events group by 1),
clip as (select event_id, stops.k, greatest(s, lo) as s, case when e is not null then least(e, hi) end as e
  from stops join bounds using (k)),
kept as (select * from clip where e is null or s < e)"""


def _merge_ctes(source: str) -> str:
    return f"""numbered as (select *, row_number() over (order by k, s, e nulls last) as rn from {source}),
ends as (select *, coalesce(e, lead(s) over (partition by k order by rn)) as e2 from numbered),
flags as (select *, max(e2) over (partition by k order by rn rows between unbounded preceding and 1 preceding) as before
  from ends where e2 is not null),
grp as (select *, sum(case when before is null or s > before then 1 else 0 end)
  over (partition by k order by rn rows unbounded preceding) as g from flags),
merged as (select k, g, min(s) as s, max(e2) as e from grp group by k, g)"""


STOP_SUM = "cast(sum(epoch_us(e) - epoch_us(s)) as bigint)"

# --- numbering -------------------------------------------------------------


def ticket_batches(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("ticket"), (F.col("l_orderkey") * 3 + 1).alias("place")
    )
    return batches.key_batches(lines, "ticket", "place", slice_rows=4096)


def ticket_requests(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("ticket"), "o_orderkey")
    return extract.requests(orders, "ticket", "o_orderkey", slice_rows=4096)


def footer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A report without its first six line numbers and last two lines; four lines share a number."""
    lines = read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 4).alias("line_no"), "o_orderkey", "o_orderpriority")
    return scans.drop_last_rows(scans.skip_first_rows(lines, "line_no", 6), "line_no", 2, ["o_orderkey"])


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of numbered text lines after a six-line preamble and a header."""
    lines = read(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("line_no"),
        F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit('"a, '), "o_orderpriority", F.lit('"')), "o_orderstatus").alias("text"),
    )
    return files.parse_numbered_lines(lines, ["key", "priority", "status"], skip=6)


def tabbed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of numbered tab-separated lines after a header."""
    cells = F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
    lines = read(spark, sf, "customer").select((F.col("c_custkey") + 1).alias("line_no"), cells.alias("text"))
    return files.parse_numbered_lines(lines, ["key", "name", "segment"], skip=0, sep="\t")


def positional_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A headerless table of customers, a sheet per nation, as cells."""
    segment = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    table = read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name", segment.alias("c_mktsegment"))
    return files.cells_of(table, "c_nationkey", "c_custkey")


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the whole texts with the latest line that ends in a question or is short."""
    lines = sections.document_lines(read(spark, sf, "documents"))
    heading = F.when(F.length("text") < 60, F.col("line_no"))
    return scans.carry_forward(lines, ["doc_id"], "line_no", heading, "heading_line", 3).select(
        "doc_id", "line_no", F.coalesce("heading_line", F.lit(-1)).alias("heading_line"), F.length("text").alias("n")
    )


# --- sections --------------------------------------------------------------

REPORT_LINES = (
    "concat('REPORTE TÉCNICO Nº ', {key})",
    "'CUISMP : '",
    "concat({cust}, '. Sede')",
    "case when o_orderstatus = 'F' then 'Tipo caso: SIN SERVICIO' else 'Tipo Caso :' end",
    "case when o_orderstatus = 'F' then '' else 'ENLACE LENTO' end",
    "concat('  Observacion: ', o_orderpriority, '  ')",
    "'Determinación de la  causa :'",
    "case when o_orderstatus = 'O' then '' else concat('Corte en ', {cust}) end",
    "'MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS:'",
    "concat('Se revisó ', o_orderpriority)",
    "concat('Fecha y Hora de Inicio: ', {start}, ' horas.')",
    "case when o_orderstatus = 'P' then '' else concat('Hora Fin ', {end}) end",
    "'Se probó el enlace.'",
    "case when o_orderpriority = '1-URGENT' then 'DETALLE DE SOLICITUDES' else 'Solicitudes' end",
    "'Fecha y Hora Fin: 01/01/2000 10:00'",
)
ANNEX_LINES = (
    "concat('ANEXO ', {cust}, ' – TICKET ', {key})",
    "case when o_orderstatus = 'F' then 'Se tuvo indisponibilidad por parte del cliente' else 'Nota' end",
    f"'{STOPS_HEADER}'",
    "concat({start}, ':00 hasta el día ', {end}, ':00')",
    "concat({end}, ' aprox hasta el día ', {start})",
    "case when o_orderstatus = 'P' then '' else concat('(Total de horas sin acceso a la sede: ', {hours}, ':07 horas)') end",
    "case when o_orderpriority = '5-LOW' and {rank} = 3 then 'EVIDENCIA RESPONSABILIDAD DE TERCEROS' else 'Fin' end",
    "concat({start}, ' hasta el día ', {start})",
)


def _filled(line: str, d) -> str:
    ts = d.ntz("o_orderdate")
    start = d.plus_seconds(ts, "o_orderkey % 86400")
    end = d.plus_seconds(ts, "86400 + o_custkey % 86400")
    if d is Spark:
        start, end = (f"date_format({x}, 'd/M/yyyy H:mm')" for x in (start, end))
    else:
        start, end = (f"strftime({x}, '%-d/%-m/%Y %-H:%M')" for x in (start, end))
    return line.format(
        key=d.text("o_orderkey"), cust=d.text("o_custkey"), start=start, end=end, hours=d.text("o_custkey % 12"), rank="o_orderkey % 7"
    )


def _lines(spark: SparkSession, sf: str, lines: tuple[str, ...]) -> DataFrame:
    """One document per customer; each order adds its lines."""
    texts = F.array(*[F.expr(_filled(x, Spark)) for x in lines])
    return (
        read(spark, sf, "orders")
        .select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.posexplode(texts).alias("i", "text"))
        .select("doc_id", (F.col("o_orderkey") * 20 + F.col("i") + 1).alias("line_no"), "text")
    )


def technical_reports(spark: SparkSession, sf: str) -> DataFrame:
    return sections.technical_reports(_lines(spark, sf, REPORT_LINES), slice_rows=50_000)


def outage_annexes(spark: SparkSession, sf: str) -> DataFrame:
    return sections.outage_annexes(_lines(spark, sf, ANNEX_LINES), slice_rows=50_000)


REPORTS_SQL = f"""select o_custkey as doc_id, o_orderkey * 20 + 1 as section, cast(o_orderkey as varchar) as nro_incidencia,
  cast(o_custkey as varchar) as "CUISMP", case when o_orderstatus = 'F' then 'SIN SERVICIO' else 'ENLACE LENTO' end as "Tipo Caso",
  o_orderpriority as "Observación",
  case when o_orderstatus = 'O' then 'MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS:' else 'Corte en ' || cast(o_custkey as varchar) end as "DETERMINACIÓN DE LA CAUSA",
  'Se revisó ' || o_orderpriority || ' Se probó el enlace.' as "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS",
  {_filled('{start}', Duck)} as "Fecha y hora inicio",
  case when o_orderstatus = 'P' then '' else {_filled('{end}', Duck)} end as "Fecha y hora fin" from orders"""

_START, _END = _filled("{start}", Duck), _filled("{end}", Duck)


def _pad(x: str) -> str:
    """Padding written from the parts: day and hour to two digits."""
    return (
        f"lpad(split_part({x}, '/', 1), 2, '0') || '/' || split_part({x}, '/', 2) || '/' || left(split_part({x}, '/', 3), 5) || lpad(split_part({x}, ' ', 2), 5, '0')"
    )


ANNEXES_SQL = f"""with stop as (select o_custkey, min(o_orderkey) as last_key from orders
  where o_orderpriority = '5-LOW' and o_orderkey % 7 = 3 group by 1),
o as (select orders.*, last_key, {_START} as a, {_END} as b from orders left join stop using (o_custkey)),
k as (select * from o where last_key is null or o_orderkey <= last_key)
select o_custkey as doc_id, o_orderkey * 20 + 1 as section, cast(o_orderkey as varchar) as ticket,
  '{STOPS_HEADER}' as indisponibilidad_header,
  {_pad('a')} || ':00 hasta el día ' || {_pad('b')} || ':00' || chr(10) || {_pad('b')} || ' aprox hasta el día ' || {_pad('a')}
    || case when o_orderstatus = 'P' and (last_key is null or o_orderkey < last_key) then chr(10) || {_pad('a')} || ' hasta el día ' || {_pad('a')} else '' end as indisponibilidad_periodos,
  case when o_orderstatus = 'P' then '' else '(Total de horas sin acceso a la sede: ' || cast(o_custkey % 12 as varchar) || ':07 horas)' end as indisponibilidad_footer,
  case when o_orderstatus = 'P' then '' else lpad(cast(o_custkey % 12 as varchar), 2, '0') || ':07' end as indisponibilidad_total from k"""

# --- landed documents ------------------------------------------------------


def html_items(spark: SparkSession, sf: str) -> DataFrame:
    """List rows and their link cells over the whole pages."""
    rows = landed.html_rows(read(spark, sf, "pages"), "page_id", "html", "li", "a")
    return rows.select("page_id", "row", F.array_join("cells", "|").alias("cells"))


HTML_SQL = f"""with r as (select page_id, unnest(regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1)) as h,
  generate_subscripts(regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1), 1) - 1 as "row" from pages),
c as (select page_id, cast("row" as integer) as "row", regexp_extract_all(h, '(?is)<a(?:\\s[^>]*)?>(.*?)</a>', 1) as cells from r)
select page_id, "row", array_to_string(list_transform(cells, lambda x: {strip(
    "replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
)}), '|') as cells from c where len(cells) > 0"""

EVENT_PAGE = (
    "concat('<table class=\"t\"><thead><tr><td>Fecha</td></tr></thead><tbody><TR class=x><td> ', {when}, ' </td><td>', {user}, "
    "'</td><td><b>An&#225; &amp; Jos&eacute; ', {user}, '</b></td><td>A</td><td>', event_type, '</td><td>', {blank}, '</td><td>-</td>', {more}, '</TR>"
    "<tr><td>', {number}, '</td><td>2</td></tr><tr></tr></tbody><tfoot><tr><td>Total</td></tr></tfoot></table>')"
)


def _page(d) -> str:
    return EVENT_PAGE.format(
        when=d.second_text("ts"),
        user=d.text("user_id"),
        number=d.text("event_id"),
        blank="case when event_type = 'click' then '  ' else '&nbsp;7' end",
        more="case when event_type in ('view', 'click') then '<td> </td><td>9</td>' when event_type = 'error' then '<td></td>' else '' end",
    )


def _event_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.expr(_page(Spark)).alias("html"))


def agent_table(spark: SparkSession, sf: str) -> DataFrame:
    return landed.agent_table(_event_pages(spark, sf), "event_id")


def agent_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rows = landed.agent_rejects(_event_pages(spark, sf), "event_id")
    return rows.select("event_id", "row", F.array_join("cells", "|").alias("cells"))


def presence_table(spark: SparkSession, sf: str) -> DataFrame:
    return landed.presence_table(_event_pages(spark, sf), "event_id")


_NAMED = """'Aná & José ' || cast(user_id as varchar)"""
AGENT_SQL = f"""select event_id, cast(1 as integer) as "row", strftime(ts, '%d/%m/%Y %H:%M:%S') as "Fecha", cast(user_id as varchar) as "Anexo",
  {_NAMED} as "Usuario", 'A' as "Agente", event_type as "Evento",
  case when event_type = 'click' then '' else '7' end as "Duracion", '-' as "Motivo" from events where event_type not in ('view', 'click', 'error')
union all select event_id, 2, cast(event_id as varchar), '2', null, null, null, null, null from events"""
AGENT_REJECTS_SQL = f"""select event_id, cast(1 as integer) as "row", strftime(ts, '%d/%m/%Y %H:%M:%S') || '|' || user_id || '|' || {_NAMED} || '|A|' || event_type || '|'
  || case when event_type = 'click' then '' else '7' end || '|-' || case when event_type = 'error' then '|' else '||9' end as cells
from events where event_type in ('view', 'click', 'error')"""
PRESENCE_SQL = """select event_id, cast(1 as integer) as "row", 'A' as "ANALISTA", event_type as "HORARIO",
  case when event_type = 'click' then '-' else '7' end as "MODALIDAD", '-' as "FECHA", '-' as "HORA DE INGRESO"
from events where event_type in ('view', 'click', 'error')"""

FAULT_HEADERS = ("Número de ticket", "Causa", "responsable previo")


def _fault_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of one document per customer and one table per priority; one header is not declared."""
    orders = read(spark, sf, "orders").withColumn(
        "table_no", F.substring("o_orderpriority", 1, 1).cast("int") + 2
    )
    heads = orders.select("o_custkey", "table_no").distinct()
    names = F.array(F.lit(" Número de ticket"), F.lit("Causa "), F.lit("responsable previo"), F.lit("Nota"))
    head = heads.select("o_custkey", "table_no", F.lit(0).cast("bigint").alias("row"), F.posexplode(names).alias("col", "text"))
    values = F.array(
        F.col("o_orderkey").cast("string"),
        F.concat(F.lit(" "), "o_orderstatus", F.lit("  ")),
        F.when(F.col("o_orderstatus") == "F", F.lit("X")),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")),
    )
    body = orders.select("o_custkey", "table_no", (F.col("o_orderkey") + 1).alias("row"), F.posexplode(values).alias("col", "text"))
    cells = head.unionByName(body.where("text is not null")).withColumnRenamed("o_custkey", "doc_id")
    return cells


def fault_tables(spark: SparkSession, sf: str) -> DataFrame:
    return landed.fault_tables(_fault_cells(spark, sf), FAULT_HEADERS)


def undeclared_cells(spark: SparkSession, sf: str) -> DataFrame:
    return landed.undeclared_cells(_fault_cells(spark, sf), FAULT_HEADERS)


def _repeated_header_cells(spark: SparkSession, sf: str) -> DataFrame:
    """As ``_fault_cells`` with ``Causa`` once more in column 4, whose cells many rows lack."""
    orders = read(spark, sf, "orders").withColumn("table_no", F.substring("o_orderpriority", 1, 1).cast("int") + 2)
    four = F.lit(4).alias("col")
    head = orders.select(F.col("o_custkey").alias("doc_id"), "table_no").distinct().select("doc_id", "table_no", F.lit(0).cast("bigint").alias("row"), four, F.lit("Causa").alias("text"))
    body = orders.where("o_orderstatus <> 'P'").select(
        F.col("o_custkey").alias("doc_id"), "table_no", (F.col("o_orderkey") + 1).alias("row"), four, F.concat(F.lit("A "), "o_orderpriority").alias("text")
    )
    return _fault_cells(spark, sf).unionByName(head).unionByName(body)


def fault_tables_repeated_header(spark: SparkSession, sf: str) -> DataFrame:
    return landed.fault_tables(_repeated_header_cells(spark, sf), FAULT_HEADERS)


def undeclared_cells_repeated_header(spark: SparkSession, sf: str) -> DataFrame:
    return landed.undeclared_cells(_repeated_header_cells(spark, sf), FAULT_HEADERS)


FAULT_REPEATED_SQL = """select o_custkey as doc_id, cast(left(o_orderpriority, 1) as integer) + 2 as table_no, o_orderkey + 1 as "row",
  cast(o_orderkey as varchar) as "Número de ticket", case when o_orderstatus = 'P' then '' else 'A ' || o_orderpriority end as "Causa",
  case when o_orderstatus = 'F' then 'X' else '' end as "responsable previo",
  case left(o_orderpriority, 1) when '2' then 'CLARO' when '3' then 'CLIENTE' else 'TERCEROS' end as responsable
from orders where left(o_orderpriority, 1) in ('2', '3', '4')"""
UNDECLARED_REPEATED_SQL = """with o as (select *, cast(left(o_orderpriority, 1) as integer) + 2 as t from orders where left(o_orderpriority, 1) in ('2', '3', '4'))
select o_custkey as doc_id, t as table_no, cast(3 as integer) as col, o_orderkey + 1 as "row", o_orderpriority as text, 'Nota' as header from o where o_orderstatus = 'O'
union all select o_custkey, t, 1, o_orderkey + 1, o_orderstatus, 'Causa' from o"""
FAULT_SQL = """select o_custkey as doc_id, cast(left(o_orderpriority, 1) as integer) + 2 as table_no, o_orderkey + 1 as "row",
  cast(o_orderkey as varchar) as "Número de ticket", o_orderstatus as "Causa", case when o_orderstatus = 'F' then 'X' else '' end as "responsable previo",
  case left(o_orderpriority, 1) when '2' then 'CLARO' when '3' then 'CLIENTE' else 'TERCEROS' end as responsable
from orders where left(o_orderpriority, 1) in ('2', '3', '4')"""


UNDECLARED_SQL = """select o_custkey as doc_id, cast(left(o_orderpriority, 1) as integer) + 2 as table_no, cast(3 as integer) as col, o_orderkey + 1 as "row",
  o_orderpriority as text, 'Nota' as header from orders where o_orderstatus = 'O' and left(o_orderpriority, 1) in ('2', '3', '4')"""


def mail_ticket_flag(spark: SparkSession, sf: str) -> DataFrame:
    mail = read(spark, sf, "conversations").select(
        F.expr("timestamp_ntz '2024-03-01 08:00:00' + make_dt_interval(0, 0, cast(conv_id as int), cast(turn as decimal(18,6)))").alias("received"),
        F.expr("case when role = 'user' then concat('u', cast(conv_id as string)) end").alias("sender"),
        F.expr("case when turn > 0 then concat('Re: ', role) end").alias("subject"),
        F.expr("concat(text, case when turn = 1 then ' Ticket 12' when turn = 2 then ' tickets' else '' end)").alias("body"),
    )
    return landed.mail_table(mail)


MAIL_SQL = """with m as (select timestamp '2024-03-01 08:00:00' + to_minutes(conv_id) + to_seconds(turn) as received, role, conv_id, turn,
  text || case when turn = 1 then ' Ticket 12' when turn = 2 then ' tickets' else '' end as body from conversations)
select strftime(received, '%Y-%m-%d') as "Fecha", strftime(received, '%H:%M:%S') as "Hora",
  case when role = 'user' then 'u' || cast(conv_id as varchar) else 'Sin remitente' end as "Remitente",
  case when turn > 0 then 'Re: ' || role else 'Sin asunto' end as "Asunto",
  case when regexp_matches(body, '(?i)\\bticket\\b') then 'ok' else 'No encontrado' end as "Ticket", body as "Cuerpo Completo" from m"""

# --- findings and profiles -------------------------------------------------


def findings_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Order findings grouped by customer: messages in rule order, first known type."""
    orders = read(spark, sf, "orders").withColumns(
        {
            "nro_incidencia": F.col("o_custkey").cast("string"),
            "tipo_reporte": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        }
    )
    key = F.col("o_orderkey").cast("string")
    rules = [
        Rule("9.1", 1, [Check("price", F.col("o_totalprice") < 200000, F.concat(F.lit("precio "), key))]),
        Rule("9.2", 2, [
            Check("priority", F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("urgente "), key)),
            Check("status", F.col("o_orderstatus") != "F", F.lit(" cerrado")),
        ]),
    ]
    return findings.by_ticket(evaluate(orders, rules, row=F.col("o_orderkey")))


FINDINGS_SQL = """with f as (select cast(o_custkey as varchar) as k, 'precio ' || cast(o_orderkey as varchar) as m, '9.1' as c,
  case when o_orderstatus <> 'P' then o_orderstatus end as t, 1 as seq, o_orderkey as r from orders where not o_totalprice < 200000
union all select cast(o_custkey as varchar), case when o_orderpriority = '1-URGENT' then 'urgente ' || cast(o_orderkey as varchar) else '' end
  || case when o_orderstatus = 'F' then ' cerrado' else '' end, '9.2', case when o_orderstatus <> 'P' then o_orderstatus end, 2, o_orderkey
  from orders where o_orderpriority = '1-URGENT' or o_orderstatus = 'F')
select k as nro_incidencia, string_agg(m, ' | ' order by seq, r) as mensaje, string_agg(c, ' | ' order by seq, r) as objetivo,
  first(t order by seq, r) filter (where t is not null) as "TIPO REPORTE" from f group by k"""


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").withColumn("source", F.expr("case when lang <> 'en' then source end"))
    return findings.profile(docs)


def column_profile_nested(spark: SparkSession, sf: str) -> DataFrame:
    return findings.profile(read(spark, sf, "embeddings")).select(
        "column_name", "non_null", "nulls", "null_percent", "distinct_values"
    )


_PROFILED = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
PROFILE_SQL = "with d as (select doc_id, text, lang, case when lang <> 'en' then source end as source, n_chars from documents)\n" + "\nunion all ".join(
    f"select '{c}' as column_name, '{k}' as data_type, count({c}) as non_null, count(*) - count({c}) as nulls, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 2) as null_percent, count(distinct {c}) as distinct_values from d"
    for c, k in _PROFILED
)
NESTED_SQL = "\nunion all ".join(
    f"select '{c}' as column_name, count({c}) as non_null, count(*) - count({c}) as nulls, 0.0 as null_percent, count(distinct {c}) as distinct_values from embeddings"
    for c in ("vec_id", "embedding", "label")
)


def extract_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the returned parts, one of them without a narrative column."""
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("remedyobs"), F.col("source").alias("it_medidas_tomadas"))
    bench = read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("remedyobs"))
    return extract.assemble([docs, bench], extract.GENERAL_REPORT)


ASSEMBLY_SQL = """select doc_id, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') as remedyobs, regexp_replace(source, '[^a-zA-Z0-9 ]', '', 'g') as it_medidas_tomadas from documents
union all select item_id, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'), '' from benchmark"""

QUERIES = {
    "recon_matched": recon_matched,
    "recon_left_only": recon_left_only,
    "recon_right_only": recon_right_only,
    "enrich_defaults": enrich_defaults,
    "lookup_as_text": lookup_as_text,
    "key_spine": key_spine,
    "repeated_keys": repeated_keys,
    "duplicate_review": duplicate_review,
    "keep_first": keep_first,
    "first_event_per_day": first_event_per_day,
    "distinct_keys": distinct_keys,
    "clipped_stops": clipped_stops,
    "merged_stops": merged_stops,
    "stop_totals": stop_totals,
    "stop_paragraphs": stop_paragraphs,
    "ticket_batches": ticket_batches,
    "ticket_requests": ticket_requests,
    "footer_rows": footer_rows,
    "numbered_lines": numbered_lines,
    "tabbed_lines": tabbed_lines,
    "positional_cells": positional_cells,
    "carry_forward": carry_forward,
    "technical_reports": technical_reports,
    "outage_annexes": outage_annexes,
    "html_items": html_items,
    "agent_table": agent_table,
    "agent_rejects": agent_rejects,
    "undeclared_cells": undeclared_cells,
    "presence_table": presence_table,
    "fault_tables": fault_tables,
    "fault_tables_repeated_header": fault_tables_repeated_header,
    "undeclared_cells_repeated_header": undeclared_cells_repeated_header,
    "mail_ticket_flag": mail_ticket_flag,
    "findings_by_key": findings_by_key,
    "column_profile": column_profile,
    "column_profile_nested": column_profile_nested,
    "extract_assembly": extract_assembly,
}

_DAYS = "(select event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') as day, ts from events)"
SQL = {
    "recon_matched": """select doc_id, documents.lang as lang_document, n_chars, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang_page, url
from documents join pages on doc_id = page_id""",
    "recon_left_only": "select doc_id, lang, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "recon_right_only": "select doc_id, n_chars from documents d where not exists (select 1 from pages p where p.page_id = d.doc_id)",
    "enrich_defaults": "select d.doc_id, source, case quality when 1 then 'bueno' when 0 then 'malo' else 'no encontrado' end as verdict from documents d left join labels l on l.doc_id = d.doc_id",
    "lookup_as_text": "select c_custkey, cast(c_nationkey as varchar) as cid, n_name from customer left join nation on n_nationkey = c_nationkey",
    "key_spine": "select user_id, strftime(ts, '%Y-%m-%d') as day from events union select user_id, strftime(ts + interval 1 day, '%Y-%m-%d') from events",
    "repeated_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "duplicate_review": f"select * from {_DAYS} qualify count(*) over (partition by user_id, day, event_type) > 1",
    "keep_first": f"select * from {_DAYS} qualify row_number() over (partition by user_id, day, event_type order by event_id) = 1",
    "first_event_per_day": f"select * from {_DAYS} qualify row_number() over (partition by user_id, day order by ts, event_id) = 1",
    "distinct_keys": "select distinct l_orderkey, l_returnflag from lineitem",
    "clipped_stops": f'{STOP_CTES}\nselect event_id, k as user_id, s as "start", e as "end" from kept',
    "merged_stops": f'{STOP_CTES},\n{_merge_ctes("stops")}\nselect k as user_id, s as "start", e as "end" from merged',
    "stop_totals": f"""{STOP_CTES},\n{_merge_ctes("kept")}
select k as user_id, count(*) as n_stops, {STOP_SUM} as stop_micros, {STOP_SUM} / 60000000.0 as stop_minutes from merged group by k""",
    "stop_paragraphs": f"""{STOP_CTES},\n{_merge_ctes("kept")},
t as (select k, {STOP_SUM} // 1000000 as sec, string_agg(strftime(s, '%d/%m/%Y %H:%M:%S') || ' hasta el día ' || strftime(e, '%d/%m/%Y %H:%M:%S'), chr(10) order by s) as periods from merged group by k),
h as (select *, {hhmm('sec')} as total from t)
select k as user_id, '{STOPS_HEADER}' as stops_header, periods as stops_periods, total as stops_total,
  '(Total de horas sin acceso a la sede: ' || total || ' horas)' as stops_footer,
  '{STOPS_HEADER}' || chr(10) || periods || chr(10) || '(Total de horas sin acceso a la sede: ' || total || ' horas)' as stops_paragraph from h""",
    "ticket_batches": """with d as (select distinct l_orderkey as k from lineitem), n as (select k, row_number() over (order by k) - 1 as position from d)
select cast(k as varchar) as ticket, position, position // 990 as batch from n""",
    "ticket_requests": """with n as (select o_orderkey as k, row_number() over (order by o_orderkey) - 1 as p from orders)
select p // 990 as batch, count(*) as n_keys, string_agg(cast(k as varchar), chr(10) order by p) as request from n group by 1""",
    "footer_rows": "select o_orderkey // 4 as line_no, o_orderkey, o_orderpriority from orders where o_orderkey // 4 > 6 qualify row_number() over (order by o_orderkey // 4 desc, o_orderkey desc) > 2",
    "numbered_lines": "select o_orderkey + 1 as line_no, cast(o_orderkey as varchar) as key, 'a, ' || o_orderpriority as priority, o_orderstatus as status from orders where o_orderkey + 1 > 7",
    "tabbed_lines": "select c_custkey + 1 as line_no, cast(c_custkey as varchar) as key, c_name as name, c_mktsegment as segment from customer where c_custkey + 1 > 1",
    "positional_cells": """select c_nationkey as sheet, c_custkey as "row", 0 as col, c_name as value from customer
union all select c_nationkey, c_custkey, 1, c_mktsegment from customer where c_mktsegment <> 'MACHINERY'""",
    "carry_forward": f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents),
c as (select doc_id, cast(line_no as bigint) as line_no, length({strip('t')}) as n from l)
select doc_id, line_no, n, coalesce(last_value(case when n < 60 then line_no end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), -1) as heading_line from c""",
    "technical_reports": REPORTS_SQL,
    "outage_annexes": ANNEXES_SQL,
    "html_items": HTML_SQL,
    "agent_table": AGENT_SQL,
    "agent_rejects": AGENT_REJECTS_SQL,
    "undeclared_cells": UNDECLARED_SQL,
    "presence_table": PRESENCE_SQL,
    "fault_tables": FAULT_SQL,
    "fault_tables_repeated_header": FAULT_REPEATED_SQL,
    "undeclared_cells_repeated_header": UNDECLARED_REPEATED_SQL,
    "mail_ticket_flag": MAIL_SQL,
    "findings_by_key": FINDINGS_SQL,
    "column_profile": PROFILE_SQL,
    "column_profile_nested": NESTED_SQL,
    "extract_assembly": ASSEMBLY_SQL,
}
