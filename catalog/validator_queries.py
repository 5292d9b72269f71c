"""Queries over the derived validator inputs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import validator_sql as sql
from catalog.dialect import Spark
from catalog.inputs import (
    HIGH,
    annex_columns,
    circuit_columns,
    cut_columns,
    fault_columns,
    incident_columns,
    long_incident_columns,
    report_columns,
    spark_frame,
    stop_columns,
)
from cotejo.operators.findings import observation_count, union_all
from cotejo.operators.joins import cardinality, enrich, matched, only_left
from cotejo.operators.rules import evaluate
from cotejo.plans import cut_rules as cr
from cotejo.plans import validator as v
from cotejo.plans import word_rules as wr
from cotejo.plans.cut_rules import DATA, VOICE
from cotejo.plans.inputs import (
    late_cut,
    late_incidents,
    prepare_annexes,
    prepare_circuits,
    prepare_cut,
    prepare_faults,
    prepare_incidents,
    prepare_reports,
    prepare_stops,
)

COMPONENT = f"case when o_orderpriority = '{HIGH}' then '{VOICE}' else '{DATA}' end"


def _documents(spark: SparkSession, sf: str, columns, prepare) -> DataFrame:
    """Both documents in one frame; the priority says which one a row is in."""
    df = spark_frame(spark, sf, "orders", {**columns(Spark), "component": COMPONENT})
    return prepare(df, F.col("component"))


def _cut(spark: SparkSession, sf: str, newlines: bool = False) -> DataFrame:
    return prepare_cut(spark_frame(spark, sf, "orders", cut_columns(Spark)), "source_row", newlines)


def _incidents(spark: SparkSession, sf: str, long_incidents: bool = False, newlines: bool = False) -> DataFrame:
    columns = long_incident_columns if long_incidents else incident_columns
    return prepare_incidents(spark_frame(spark, sf, "orders", columns(Spark)), newlines)


def _circuits(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_circuits(spark_frame(spark, sf, "customer", circuit_columns(Spark)))


def _faults(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, fault_columns, prepare_faults)


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, report_columns, prepare_reports)


def _annexes(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, annex_columns, prepare_annexes)


def late_inputs(spark: SparkSession, sf: str, words: bool = False) -> v.Inputs:
    """The same with the cut and the incidents cleaned behind their joins, for the rule sets as a whole."""
    return replace(
        inputs(spark, sf, words=words),
        cut=late_cut(spark_frame(spark, sf, "orders", cut_columns(Spark)), "source_row"),
        incidents=late_incidents(spark_frame(spark, sf, "orders", incident_columns(Spark))),
    )


def inputs(
    spark: SparkSession, sf: str, long_incidents: bool = False, newlines: bool = False, words: bool = False
) -> v.Inputs:
    """Prepared inputs; the word documents only where they are needed."""
    return v.Inputs(
        cut=_cut(spark, sf, newlines),
        incidents=_incidents(spark, sf, long_incidents, newlines),
        stops=prepare_stops(spark_frame(spark, sf, "lineitem", stop_columns(Spark))),
        circuits=_circuits(spark, sf),
        faults=_faults(spark, sf) if words else None,
        reports=_reports(spark, sf) if words else None,
        annexes=_annexes(spark, sf) if words else None,
    )


def _cut_rule(rule, rows=v.compared):
    """One rule over the rows it needs; only net times need the stops."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows_of = cr.with_rule_columns(rows(inputs(spark, sf)))
        return evaluate(rows_of, [rule()], v.KEY, "tipo_reporte", F.col("row"))

    return run


def _rule_1_0(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.unmatched(inputs(spark, sf))
    return evaluate(rows, [cr.missing_incident()], v.KEY, "tipo_reporte", F.col("row"))


def _missing(documents, rule):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return v.missing_findings(_cut(spark, sf), documents(spark, sf), rule())

    return run


def _word(documents, rule):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = matched(documents(spark, sf), _cut(spark, sf), [v.KEY])
        return evaluate(rows, [rule()], v.KEY, "tipo_reporte", F.col("row"))

    return run


def _rule_3_1(spark: SparkSession, sf: str) -> DataFrame:
    return v.annex_findings(v.reconciled(inputs(spark, sf, long_incidents=True)), _annexes(spark, sf))


def _outage_block_rule(spark: SparkSession, sf: str) -> DataFrame:
    rows = cr.with_block(v.reconciled(inputs(spark, sf, newlines=True)))
    return evaluate(rows, [cr.outage_text()], v.KEY, "tipo_reporte", F.col("row"))


def _prepared_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf).withColumn("cut_diff_sec", F.col("cut_diff_sec").cast("double"))


def _ticket_stops(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.reconciled(inputs(spark, sf, long_incidents=True))
    minutes = F.col("sum_paradas").alias("sum_paradas")
    return rows.select("nro_incidencia", minutes, "stops_header", "stops_periods", "stops_total")


def _findings_cut(spark: SparkSession, sf: str) -> DataFrame:
    return v.by_ticket(v.cut_findings(v.reconciled_cut(late_inputs(spark, sf))))


def _findings_word(spark: SparkSession, sf: str) -> DataFrame:
    given = late_inputs(spark, sf, words=True)
    return v.by_ticket(v.word_findings(given.cut, given.faults, given.reports))


def _validator(spark: SparkSession, sf: str) -> DataFrame:
    return v.validate(late_inputs(spark, sf, words=True))


def _observation_count(spark: SparkSession, sf: str) -> DataFrame:
    return observation_count(v.validate(late_inputs(spark, sf, words=True)))


def _unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return v.unmatched(inputs(spark, sf)).select("nro_incidencia", "tipo_reporte", "cut_start", "cut_end")


#: Frames whose tickets and circuits occur once in the given tables.
ONCE = ("cut", "incidents", "circuits", "faults", "reports", "annexes")


def _three_way_unique(spark: SparkSession, sf: str) -> DataFrame:
    """As ``cut_incident_circuit``, with every key checked inside the plan."""
    i = replace(inputs(spark, sf), unique=("cut", "incidents", "circuits"))
    return v.compared(i).select("nro_incidencia", "inc_cid", "cut_service", "map_service", "map_district", F.coalesce("map_site", F.lit("no encontrado")).alias("map_site"))


def _validator_unique(spark: SparkSession, sf: str) -> DataFrame:
    return v.validate(replace(late_inputs(spark, sf, words=True), unique=ONCE))


def _input_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, keys, repeated keys and most rows of one key, for each input; the stops have many to a ticket."""
    i = inputs(spark, sf, words=True)
    keyed = {
        "cut": (i.cut, [v.KEY]), "incidents": (i.incidents, [v.KEY]), "circuits": (i.circuits, ["inc_cid"]), "stops": (i.stops, [v.KEY]),
        "faults": (i.faults, [v.KEY]), "reports": (i.reports, [v.KEY, "word_component"]), "sites": (i.circuits, ["map_district"]),
    }
    return union_all([cardinality(df, keys).select(F.lit(name).alias("frame"), "*") for name, (df, keys) in keyed.items()])


def _three_way(spark: SparkSession, sf: str) -> DataFrame:
    i = inputs(spark, sf)
    rows = enrich(matched(i.cut, i.incidents, [v.KEY]), i.circuits, ["inc_cid"], {"map_site": "no encontrado"})
    return rows.select("nro_incidencia", "inc_cid", "cut_service", "map_service", "map_district", "map_site")


def _annex_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return v.with_annex(_cut(spark, sf), _annexes(spark, sf)).select(
        "nro_incidencia", "cut_component", "annex_header", "annex_periods", "annex_total"
    )


def _union_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings whose type is left out on one side read empty there."""
    i = inputs(spark, sf)
    key, kind, place = v.KEY, "tipo_reporte", F.col("row")
    a = evaluate(v.unmatched(i), [cr.missing_incident()], key, kind, place)
    b = v.missing_findings(i.cut, _faults(spark, sf), wr.claim_not_in_faults())
    return union_all([a, b.drop("TIPO REPORTE")])


CUT = ["1.0", "1.1", "1.2", "1.3", "1.4", "1.5", "1.6", "1.7", "1.8", "1.9", "1.10"]
WORD = ["2.0.1", "2.0.2", "2.1", "2.2"]

QUERIES = {
    "prepared_cut": _prepared_cut,
    "prepared_incidents": _incidents,
    "prepared_circuits": _circuits,
    "prepared_faults": _faults,
    "cut_without_incident": _unmatched,
    "cut_incident_circuit": _three_way,
    "cut_incident_circuit_unique": _three_way_unique,
    "input_cardinality": _input_cardinality,
    "ticket_stops": _ticket_stops,
    "annex_defaults": _annex_defaults,
    "union_findings": _union_findings,
    "rule_1_0_missing_incident": _rule_1_0,
    "rule_1_1_service_district": _cut_rule(cr.service_and_district),
    "rule_1_2_start_end": _cut_rule(cr.start_and_end),
    "rule_1_3_stated_span": _cut_rule(cr.stated_span),
    "rule_1_4_net_time": _cut_rule(cr.net_time, v.reconciled),
    "rule_1_5_case_circuit_cause": _cut_rule(cr.case_circuit_parent_cause),
    "rule_1_6_fault_type": _cut_rule(cr.fault_type),
    "rule_1_7_report_type": _cut_rule(cr.report_type),
    "rule_1_7_with_monitoring": _cut_rule(lambda: cr.report_type(check_monitoring=True)),
    "rule_1_8_narrative_dates": _cut_rule(cr.narrative_dates),
    "rule_1_9_owner": _cut_rule(cr.owner),
    "rule_1_10_whole_hours": _cut_rule(cr.whole_hours),
    "rule_1_11_outage_text": _outage_block_rule,
    "rule_2_0_1_claim_not_in_faults": _missing(_faults, wr.claim_not_in_faults),
    "rule_2_0_2_claim_not_in_reports": _missing(_reports, wr.claim_not_in_reports),
    "rule_2_1_fault_fields": _word(_faults, wr.fault_fields),
    "rule_2_2_report_fields": _word(_reports, wr.report_fields),
    "rule_3_1_annex_fields": _rule_3_1,
    "findings_cut": _findings_cut,
    "findings_word": _findings_word,
    "validator": _validator,
    "validator_unique": _validator_unique,
    "observation_count": _observation_count,
}

SQL = {
    "prepared_cut": f"{sql.base()}\nselect * replace (cast(cut_diff_sec as double) as cut_diff_sec) from cut",
    "prepared_incidents": f"{sql.base()}\nselect * from inc",
    "prepared_circuits": f"{sql.base()}\nselect * from circ",
    "prepared_faults": f"{sql.base()}\nselect * from faults",
    "cut_without_incident": f"{sql.base()}\nselect nro_incidencia, tipo_reporte, cut_start, cut_end from u",
    "cut_incident_circuit": f"""{sql.base()}
select c.nro_incidencia, i.inc_cid, c.cut_service, ci.map_service, ci.map_district,
  coalesce(ci.map_site, 'no encontrado') as map_site
from cut c join inc i using (nro_incidencia) left join circ ci on i.inc_cid = ci.inc_cid""",
    "cut_incident_circuit_unique": f"""{sql.base()}
select c.nro_incidencia, i.inc_cid, c.cut_service, ci.map_service, ci.map_district,
  coalesce(ci.map_site, 'no encontrado') as map_site
from cut c join inc i using (nro_incidencia) left join circ ci on i.inc_cid = ci.inc_cid""",
    "input_cardinality": f"{sql.base()}\n" + "\nunion all ".join(
        f"select '{name}' as frame, cast(coalesce(sum(n), 0) as bigint) as n_rows, count(*) as n_keys, count(*) filter (n > 1) as n_repeated, "
        f"cast(coalesce(max(n), 0) as bigint) as most from (select count(*) as n from {source} group by {keys})"
        for name, source, keys in [
            ("cut", "cut", "nro_incidencia"), ("incidents", "inc", "nro_incidencia"), ("circuits", "circ", "inc_cid"),
            ("stops", "lineitem", "l_orderkey"), ("faults", "faults", "nro_incidencia"), ("reports", "reports", "nro_incidencia, word_component"),
            ("sites", "circ", "map_district"),
        ]
    ),
    "ticket_stops": f"""{sql.base(long_incidents=True)}
select nro_incidencia, sum_paradas, stops_header, stops_periods, stops_total from m""",
    "annex_defaults": f"""{sql.base()}
select c.nro_incidencia, c.cut_component, coalesce(a.annex_header, 'no encontrado') as annex_header,
  coalesce(a.annex_periods, 'no encontrado') as annex_periods, coalesce(a.annex_total, 'no encontrado') as annex_total
from cut c left join annexes a on a.nro_incidencia = c.nro_incidencia and a.cut_component = c.cut_component
where c.cut_component in ('COMPONENTE II', 'COMPONENTE IV')""",
    "union_findings": f"""{sql.base()}
select * from ({sql.rule_select('1.0')})
union all
select * replace ('' as "TIPO REPORTE") from ({sql.rule_select('2.0.1')})""",
    "rule_1_0_missing_incident": sql.rule_sql("1.0"),
    "rule_1_1_service_district": sql.rule_sql("1.1"),
    "rule_1_2_start_end": sql.rule_sql("1.2"),
    "rule_1_3_stated_span": sql.rule_sql("1.3"),
    "rule_1_4_net_time": sql.rule_sql("1.4"),
    "rule_1_5_case_circuit_cause": sql.rule_sql("1.5"),
    "rule_1_6_fault_type": sql.rule_sql("1.6"),
    "rule_1_7_report_type": sql.rule_sql("1.7"),
    "rule_1_7_with_monitoring": sql.monitoring_sql(),
    "rule_1_8_narrative_dates": sql.rule_sql("1.8"),
    "rule_1_9_owner": sql.rule_sql("1.9"),
    "rule_1_10_whole_hours": sql.rule_sql("1.10"),
    "rule_1_11_outage_text": sql.rule_sql("1.11", newlines=True),
    "rule_2_0_1_claim_not_in_faults": sql.rule_sql("2.0.1"),
    "rule_2_0_2_claim_not_in_reports": sql.rule_sql("2.0.2"),
    "rule_2_1_fault_fields": sql.rule_sql("2.1"),
    "rule_2_2_report_fields": sql.rule_sql("2.2"),
    "rule_3_1_annex_fields": sql.rule_sql("3.1", long_incidents=True),
    "findings_cut": sql.grouped_sql(CUT),
    "findings_word": sql.grouped_sql(WORD),
    "validator": sql.grouped_sql([*CUT, *WORD, "3.1"]),
    "validator_unique": sql.grouped_sql([*CUT, *WORD, "3.1"]),
    "observation_count": "select count(*) as observaciones, count(*) > 0 as hay_observaciones from ("
    + sql.grouped_sql([*CUT, *WORD, "3.1"])
    + ")",
}
