"""Whole pipelines on small hand-written inputs, sources and sinks."""

import re
from collections import Counter
from dataclasses import replace
from datetime import date, datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from cotejo.plans import attendance, client_report, extract, inputs, sla
from cotejo.plans import validator as v
from cotejo.plans.shared import checkpoint_dir, checkpointed
from cotejo.sources import files, sinks
from cotejo.sources.contracts import CLIENT_REPORT, INCIDENTS, OUTAGE_CUT, ContractError, conform

OPENING = "A través de los Sistemas de Monitoreo de Claro, de manera proactiva se identificó"
MEASURES = (
    "Se revisó el servicio 900 desde el día 05/01/2024 10:00 horas y se repuso tras trabajos el día 05/01/2024 12:30 horas"
)
CUT = {
    "TICKET": "100", "CUISMP": "900.0", "TIPO CASO": "SIN SERVICIO", "AVERÍA": "CORTE", "TIEMPO (HH:MM)": "01:30:00",
    "COMPONENTE": "COMPONENTE II", "DF": "Lima", "OBSERVACIÓN": "Se generó ticket para la revisión del servicio de datos de la sede NORTE",
    "CID": "C1", "FIN-INICIO (HH:MM)": "2:30", "DETERMINACIÓN DE LA CAUSA": "Falla", "RESPONSABILIDAD": "CLARO",
    "TIPO REPORTE": "RECLAMO", "Duracion entero": 1, "Agrupación entero": "Entre 1h a 4h", "CODINCIDENCEPADRE": None,
    "MASIVO": "No", "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS": MEASURES, "TIPO DE INCIDENCIA": None,
    "TIEMPO INTERRUPCION": None, "INDISPONIBILIDAD": None,
    "FECHA Y HORA INICIO": datetime(2024, 1, 5, 10), "FECHA Y HORA FIN": datetime(2024, 1, 5, 12, 30),
}
INCIDENT = {
    "nro_incidencia": "100", "canal_ingreso": "e-mail", "interrupcion_inicio": "05/01/2024 10:00:25", "fecha_generacion": "05/01/2024 10:05",
    "interrupcion_fin": "05/01/2024 12:30:59", "cid": "C1", "tipo_caso": "SIN SERVICIO", "tipificacion_problema": "CORTE ",
    "it_determinacion_de_la_causa": "COMPONENTE II - Falla", "it_medidas_tomadas": MEASURES + " Inicio 05/01/2024 10:00 Fin 05/01/2024 12:30",
    "it_conclusiones": "ok", "tiempo_interrupcion": "1", "tipificacion_interrupcion": "x", "tipificacion_tipo": "CLARO - CORTE",
    "fecha_comunicacion_cliente": "05/01/2024 10:00", "masivo": "No", "codincidencepadre": None,
}
CUT_SCHEMA = ", ".join(
    f"`{c}` " + ("timestamp_ntz" if c.startswith("FECHA") else "bigint" if c == "Duracion entero" else "string") for c in OUTAGE_CUT.columns
) + ", row bigint"


def cut_frame(spark, *changes):
    rows = []
    for i, change in enumerate(changes or [{}]):
        rec = {**CUT, **change}
        rows.append(tuple(rec[c] for c in OUTAGE_CUT.columns) + (i,))
    return inputs.prepare_cut(spark.createDataFrame(rows, CUT_SCHEMA), "row")


def incident_frame(spark, *changes):
    rows = [tuple({**INCIDENT, **ch}[c] for c in INCIDENTS.columns) for ch in (changes or [{}])]
    schema = ", ".join(f"`{c}` string" for c in INCIDENTS.columns)
    return inputs.prepare_incidents(spark.createDataFrame(rows, schema))


def all_inputs(spark, cut, incidents, tickets=("100",), **words):
    spans = [("05/01/2024 09:00:00", "05/01/2024 10:40:00"), ("05/01/2024 10:30:00", "05/01/2024 11:00:00"),
             ("05/01/2024 12:29:00", None)]
    stops = spark.createDataFrame(
        [(t, *span) for t in tickets for span in spans], "nro_incidencia string, startdate string, enddate string"
    )
    circuits = spark.createDataFrame([("C1", "900.0", " LIMA ", "Norte")], "CID string, CUISMP string, `Distrito Fiscal` string, SEDE string")
    return v.Inputs(cut, incidents, inputs.prepare_stops(stops), inputs.prepare_circuits(circuits), **words)


def codes(df):
    return {r["nro_incidencia"]: r["objetivo"] for r in df.collect()}


EACH_RULE = [
    ({}, {}, None),
    ({"CUISMP": "901"}, {}, "1.1"),
    ({"FECHA Y HORA FIN": None}, {}, "1.2 | 1.3 | 1.8"),
    ({"FIN-INICIO (HH:MM)": "2:31"}, {}, "1.3"),
    ({"TIEMPO (HH:MM)": "01:32:00"}, {}, "1.4"),
    ({"CID": "C2"}, {}, "1.5"),
    ({}, {"it_determinacion_de_la_causa": "otra"}, "1.5"),
    ({"AVERÍA": "x"}, {}, "1.6"),
    ({"TIPO REPORTE": "PROACTIVO"}, {}, "1.7"),
    ({"TIPO REPORTE": "OTRO", "OBSERVACIÓN": None}, {}, None),
    ({}, {"it_medidas_tomadas": None}, "1.8"),
    ({"RESPONSABILIDAD": None}, {}, "1.9"),
    ({"Agrupación entero": None}, {}, "1.10"),
]


def test_each_rule(spark):
    """One ticket per case, all in one run."""
    names = [str(500 + i) for i in range(len(EACH_RULE))]
    cut = cut_frame(spark, *[{**c, "TICKET": t} for t, (c, _, _) in zip(names, EACH_RULE)])
    incidents = incident_frame(spark, *[{**o, "nro_incidencia": t} for t, (_, o, _) in zip(names, EACH_RULE)])
    got = codes(v.validate(all_inputs(spark, cut, incidents, tickets=names)))
    assert got == {t: code for t, (_, _, code) in zip(names, EACH_RULE) if code}


def test_messages_and_unmatched(spark):
    cut = cut_frame(spark, {"CUISMP": None}, {"TICKET": "200"}, {"TICKET": "  "})
    got = {r["nro_incidencia"]: r for r in v.validate(all_inputs(spark, cut, incident_frame(spark))).collect()}
    assert set(got) == {"100", "200", "No disponible"}
    assert got["200"]["mensaje"] == (
        "Nro Incidencia 200 con FECHA Y HORA INICIO DE CORTE EXCEL 05/01/2024 10:00 y FECHA HORA FIN DE CORTE EXCEL  "
        "05/01/2024 12:30 no se encuentra en el reporte dinamico SGA - 335 para el rango de fecha de este corte \n"
    )
    assert got["100"]["mensaje"] == (
        "\n CUISMP en Sharepoint CID-CUISMP: \n900\n es diferente a EXCEL -CORTE (CUISMP): \nNo disponible"
        "\n CUISMP: \n No disponible\n no encontrado in MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS."
    )
    assert got["100"]["TIPO REPORTE"] == "RECLAMO"


def test_mass_outage_start(spark):
    late = incident_frame(spark, {"masivo": "Si"}).first()
    assert late["exp_start_text"] == "05/01/2024 10:05"
    early = incident_frame(spark, {"masivo": "Si", "fecha_generacion": "06/01/2024 10:00"}).first()
    assert early["exp_start_text"] == "05/01/2024 10:00"


def test_options(spark):
    """The monitoring suffix and the outage block are checked only when asked for."""
    given = all_inputs(spark, cut_frame(spark), incident_frame(spark, {"tipo_caso": "X-MONITOREO"}))
    plain = v.validate(given).first()
    asked = v.validate(given, check_monitoring=True, outage_block_rule=True).first()
    assert "no debe terminar en 'MONITOREO'" not in plain["mensaje"]
    assert "no debe terminar en 'MONITOREO'" in asked["mensaje"]
    assert asked["objetivo"] == plain["objetivo"] + " | 1.11"


def word_frames(spark, ticket="100", component=v.DATA):
    fault = {
        "Número de ticket": ticket, "Fecha y Hora Inicio": "05/01/2024 10:00", "Fecha y Hora Fin": "05/01/2024 12:30", "CUISMP": "900",
        "Avería reportada": "SIN SERVICIO", "Causa": "CORTE", "Tiempo real de afectación (HH:MM)": "01:30", "Distrito Fiscal": "Lima",
        "Tiempo\nTotal (HH:MM)": "02:30", "responsable": "CLARO",
    }
    report = {
        "nro_incidencia": ticket, "CUISMP": "900", "Tipo Caso": "SIN SERVICIO", "Observación": CUT["OBSERVACIÓN"],
        "DETERMINACIÓN DE LA CAUSA": "Falla", "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS": MEASURES.replace(" ", " \n "),
        "Fecha y hora inicio": "05/01/2024 10:00", "Fecha y hora fin": "05/01/2024 12:30",
    }
    annex = {
        "ticket": ticket, "indisponibilidad_header": " Se tuvo indisponibilidad por parte del cliente para continuar los trabajos el/los día(s)",
        "indisponibilidad_periodos": "05/01/2024 10:00:25 hasta el día 05/01/2024 11:00:00", "indisponibilidad_footer": "",
        "indisponibilidad_total": "00:59",
    }
    make = lambda rec: spark.createDataFrame([tuple(rec.values())], ", ".join(f"`{k}` string" for k in rec))
    return {
        "faults": inputs.prepare_faults(make(fault), component),
        "reports": inputs.prepare_reports(make(report), component),
        "annexes": inputs.prepare_annexes(make(annex), component),
    }


def test_word_documents(spark):
    """One run per document set: agreeing, absent, and in the other component's document."""

    def found(ticket, component):
        words = word_frames(spark, ticket, component)
        given = all_inputs(spark, cut_frame(spark), incident_frame(spark), **words)
        rows = v.reconciled(given)
        parts = [v.word_findings(given.cut, given.faults, given.reports), v.annex_findings(rows, given.annexes)]
        return v.by_ticket(v.union_all(parts)).collect()

    assert found("100", v.DATA) == []
    absent = found("999", v.DATA)[0]
    assert absent["objetivo"] == "2.0.1 | 2.0.2 | 3.1"
    assert "cuadro de averías del Word de datos." in absent["mensaje"] and "no encontrado" in absent["mensaje"]
    assert found("100", v.VOICE)[0]["objetivo"] == "2.0.1 | 2.0.2 | 2.1 | 3.1"


def test_checkpoints_need_a_named_folder():
    unset = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: unset)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkSession=SimpleNamespace(conf=unset, sparkContext=sc)))


def test_shared_rows_give_the_same(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    given = all_inputs(spark, cut_frame(spark, {"CID": "C2"}), incident_frame(spark), **word_frames(spark))
    assert v.validate(given, share=checkpointed).collect() == v.validate(given).collect()


def test_missing_tickets_meet_no_others(spark):
    lost = [{"TICKET": None}] * 3
    given = all_inputs(spark, cut_frame(spark, *lost), incident_frame(spark, *[{"nro_incidencia": None}] * 4))
    assert v.reconciled(given).count() == 0
    got = v.findings(given).collect()
    assert [r["objetivo"] for r in got] == ["1.0"] * 3
    assert v.by_ticket(v.findings(given).withColumn("row", F.monotonically_increasing_id())).count() == 3


def test_repeated_keys_fan_out(spark):
    given = all_inputs(spark, cut_frame(spark, {"CID": "C2"}), incident_frame(spark, {}, {}))
    assert codes(v.validate(given)) == {"100": "1.5 | 1.5"}


def test_contracts(spark):
    df = spark.createDataFrame([(" a\r_x000D_", 1)], "` x ` string, y int")
    with pytest.raises(ContractError, match="TICKET"):
        conform(df, OUTAGE_CUT)
    empty = conform(df, INCIDENTS, on_error="empty")
    assert empty.columns == list(INCIDENTS.columns) and empty.count() == 0
    with pytest.raises(ContractError):
        inputs.prepare_faults(df, v.DATA)


def test_files_and_sinks(spark, tmp_path):
    csv, tsv = tmp_path / "a.csv", tmp_path / "a.tsv"
    csv.write_text('k,v\n1,"a\nb"\n2,c\n', encoding="utf8")
    tsv.write_text("codincidence\tv\n7\tx y\n", encoding="utf8")
    assert files.read_csv(spark, str(csv), multi_line=True).orderBy("k").first()["v"] == "a\nb"
    tab = files.read_tab_separated(spark, str(tsv))
    assert tab.first()["v"] == "x y"
    cells = files.cells_of(spark.createDataFrame([("s", 0, None, "n")], "s string, r int, a string, b string"), "s", "r")
    assert [tuple(r) for r in cells.collect()] == [("s", 0, 1, "n")]
    at = datetime(2024, 1, 2, 3, 4, 5)
    path = sinks.write_sla(tab, str(tmp_path), "01/01/2024", "31/01/2024", at)
    assert path.endswith("sla_report_01-01-2024_to_31-01-2024_20240102_030405")
    assert files.read_table(spark, path).count() == 1
    with pytest.raises(Exception):
        sinks.write_sla(tab, str(tmp_path), "01/01/2024", "31/01/2024", at)
    assert "/clock_stops/extract_" in sinks.write_extract(tab, str(tmp_path), 18, "a", "b", at)
    with pytest.raises(ValueError):
        sinks.write_extract(tab, str(tmp_path), 5, "a", "b", at)
    clean, rejects = sinks.write_with_rejects(tab, tab.limit(0), str(tmp_path), "desk", at)
    assert rejects.endswith("desk_duplicates_20240102_030405") and clean != rejects
    assert sinks.write_report(tab, str(tmp_path), at).endswith("validator_report_20240102_030405")
    assert [r["codincidence"] for r in sinks.records(tab)] == ["7"]


def test_report_in_ticket_order(spark, tmp_path):
    tickets = [str(i * 7919 % 1000) for i in range(1000)] + [None]
    df = spark.createDataFrame([(t, "m") for t in tickets], "nro_incidencia string, mensaje string").repartition(5)
    path = sinks.write_report(df, str(tmp_path), datetime(2024, 1, 2))
    rows = [r["nro_incidencia"] for f in sorted(Path(path).glob("part-*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert rows == sorted(tickets[:-1]) + [None]


def test_plans_refuse_a_range_that_ends_before_it_starts():
    for plan, n in ((sla.fill_sla, 2), (attendance.combined, 4)):
        with pytest.raises(ValueError, match="range"):
            plan(*[None] * n, date(2024, 1, 2), date(2024, 1, 1))


def test_client_report(spark):
    rec = {**INCIDENT, "canal_ingreso": "Proactivo", "it_conclusiones": "uno\nSe recomienda", "tipificacion_problema": "X PROBLEMA DE ENERGIA COMERCIAL EN SITE/POP - y",
           "tipificacion_tipo": "TERCEROS - CORTE", "it_medidas_tomadas": "cuerpo\nFecha y hora inicio: 1/1/2024 1:00", "cid": " 5 "}
    late = {**INCIDENT, "nro_incidencia": "2", "interrupcion_inicio": "?", "tipificacion_problema": None, "cid": "6"}
    schema = ", ".join(f"`{c}` string" for c in CLIENT_REPORT.columns)
    report = spark.createDataFrame([tuple(r[c] for c in CLIENT_REPORT.columns) for r in (late, rec)], schema)
    sites = spark.createDataFrame([(5, "Sede 5")], "cid bigint, sede string")
    a, b = client_report.in_report_order(client_report.client_rows(report, sites)).collect()
    assert (a["sede"], a["mejoras"], a["recomendaciones"], a["it_medidas_tomadas"]) == ("Sede 5", "uno", "Se recomienda", "cuerpo")
    assert (a["fecha_comunicacion_cliente"], a["tipificacion_tipo"]) == ("-", "TERCEROS")
    assert a["tipificacion_problema"] == "PROBLEMA DE ENERGIA COMERCIAL EN SITE/POP"
    assert (b["nro_incidencia"], b["interrupcion_inicio"], b["tipificacion_problema"], b["canal_ingreso"]) == ("2", None, "", "Reportado por el usuario")


def test_sla_compliance(spark):
    schema = "cid string, nombre_cliente string, compute_0044 string, tipificacion_problema string, tiempo_interrupcion double, caso string, tipificacion_tipo string, usuario_cierra string, otpint string, sotpint string, sotwimax string, otpext string, sotpext string, remedy string"
    base = ["f", "X", "a|4|6", "CORTE DE FIBRA", 0.5, "SIN SERVICIO", None, "C2A", "1", None, None, None, "2", "3"]

    def row(**ch):
        names = [x.split()[0] for x in schema.split(", ")]
        return tuple({**dict(zip(names, base)), **ch}.values())

    cases = [row(), row(tiempo_interrupcion=13.0), row(caso="FT"), row(cid="m", tiempo_interrupcion=99.0), row(cid="s"),
             row(cid="none"), row(caso=None), row(nombre_cliente="", compute_0044=None)]
    media = spark.createDataFrame([("f", "Fibra"), ("m", "Microondas"), ("s", "Satelital")], "cid string, medio string")
    got = sla.fill_sla(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + schema), media).orderBy("i").collect()
    assert [r["slacomp"] for r in got] == ["1", "0", "FT", "1", "Satelital", "0", "0", "1"]
    assert [r["fo"] for r in got][:1] + [got[7]["fo"], got[7]["tip_interr_filtrado"]] == [12.0, 8.0, 0.5]
    assert (got[0]["tip_interr_filtrado"], got[0]["mo"], got[0]["tipo_usuario_cierra"]) == (1.0, 6.0, "P")
    assert (got[0]["desp"], got[0]["desplazamiento"]) == ("ATCORP+SOTPINTCORP+SOTPEXT+REMEDY", "ATCORP+SOTPINTCORP+SOTPEXT")


def test_extract_assembly(spark):
    a = spark.createDataFrame([("1", "á-b c", "x.y")], "codincidence string, remedyobs string, it_medidas_tomadas string")
    got = extract.assemble([a, a], extract.GENERAL_REPORT).collect()
    assert [tuple(r) for r in got] == [("1", "b c", "xy")] * 2
    assert extract.assemble([a], 15).first()["remedyobs"] == "á-b c"


def test_registered_queries_have_matching_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


@pytest.mark.parametrize("name", ["stop_totals", "sla_fill", "rule_1_8_narrative_dates", "findings_by_key"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as e
    from check import compare

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in e.TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert compare(spark, con, sf, name, e.queries()[name], e.oracle_sql()[name]).startswith("ok")


def test_no_cross_joins_and_pruned_scans(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["nro_incidencia", "mensaje", "objetivo", "TIPO REPORTE"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan
    scan = e.queries()["stop_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in scan


def test_inputs_may_ask_for_unique_keys(spark):
    words = word_frames(spark)
    once = dict(unique=("cut", "incidents", "circuits", "faults", "reports", "annexes"))
    given = all_inputs(spark, cut_frame(spark, {"CID": "C2"}, {"TICKET": None}, {"TICKET": None}), incident_frame(spark), **words)
    assert sorted(v.validate(replace(given, **once)).collect()) == sorted(v.validate(given).collect())  # rows without a ticket may repeat
    twice = all_inputs(spark, cut_frame(spark), incident_frame(spark, {}, {}), **words)
    assert codes(v.validate(twice)) == {}
    with pytest.raises(Exception, match="incidents: more than one row for nro_incidencia=100"):
        v.validate(replace(twice, **once)).collect()
    doubled = replace(given, **once, faults=words["faults"].union(words["faults"]))
    with pytest.raises(Exception, match="faults: more than one row for nro_incidencia=100, word_component="):
        v.validate(doubled).collect()
    with pytest.raises(ValueError, match="stops"):
        v.validate(replace(given, unique=("stops",)))


def test_one_join_for_the_word_documents(spark):
    given = all_inputs(spark, cut_frame(spark), incident_frame(spark), **word_frames(spark))
    plan = v.word_findings(given.cut, given.faults, given.reports)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) == 1


def test_repeated_word_rows_and_claims(spark):
    """A ticket twice in the cut and twice in a document: fields fan out, absence is told once a cut row."""
    one, other = word_frames(spark, "100", v.DATA), word_frames(spark, "100", v.VOICE)
    cut = cut_frame(spark, {}, {}, {"COMPONENTE": v.VOICE}, {"TICKET": "7"})
    both = one["faults"].union(one["faults"])
    got = sorted((r["objetivo"], r["row"]) for r in v.word_findings(cut, both, other["reports"]).collect())
    assert [x for x in got if x[0] == "2.0.1"] == [("2.0.1", 2), ("2.0.1", 3)]
    assert [x for x in got if x[0] == "2.0.2"] == [("2.0.2", 0), ("2.0.2", 1), ("2.0.2", 3)]
    assert sorted(x[1] for x in got if x[0] == "2.1") == [2, 2]  # the voice row differs from both data rows
    only = v.word_findings(cut, None, other["reports"]).collect()
    assert {r["objetivo"] for r in only} <= {"2.0.2", "2.2"} and v.word_findings(cut, None, None) is None


def test_combined_attendance_reads_each_table_once_or_twice(spark):
    from catalog.plan_queries import attendance_combined

    out = attendance_combined(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    scans = Counter(m for m in re.findall(r"FileScan parquet .*?/([a-z]+)\.parquet", plan))
    assert scans == {"events": 2, "customer": 2, "nation": 2}
