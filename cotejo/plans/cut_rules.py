"""Rule set 1: the outage cut against the incident extract, stops and circuits.

Message texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.numbers import hour_band, not_negative, same, within
from cotejo.functions.text import (
    drop_component_label,
    has_slash_typo,
    leading_token,
    repeats_phrase,
    shown,
    strip,
)
from cotejo.functions.textdates import body_range, closing_range, outage_block_strict
from cotejo.functions.times import minutes_of, two_digits
from cotejo.operators.rules import Check, Rule

CLAIM, PROACTIVE = "RECLAMO", "PROACTIVO"
DATA, VOICE = "COMPONENTE II", "COMPONENTE IV"

# Case types a claim may have, the proactive opening, and the
# observation expected per report type and component.
CLAIM_CASES = ("SIN SERVICIO", "ENLACE LENTO", "SIN SERVICIO-NO DA TONO", "OTROS CALIDAD")
PROACTIVE_OPENING = (
    r"(?iU)^a través de los sistemas de monitoreo de claro, de manera proactiva se identificó"
)
NOTE_DATA = "Se generó ticket para la revisión del servicio de datos de la sede "
NOTE_VOICE = "Se generó ticket para la revisión del servicio de telefonía de la sede "
NOTES = {
    "COMPONENTE II": NOTE_DATA,
    "COMPONENTE III": NOTE_DATA,
    "COMPONENTE IV": NOTE_VOICE,
    "COMPONENTE V": NOTE_DATA,
}


def c(name: str) -> Column:
    return F.col(name)


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def with_rule_columns(df: DataFrame) -> DataFrame:
    """Values that several checks and messages use, worked out once per row.

    Net minutes need the stops; rows without them serve all rules but 1.4 and 1.11.
    """
    net = {"net_minutes": c("inc_span_min") - c("sum_paradas")} if "sum_paradas" in df.columns else {}
    return df.withColumns(
        {
            **net,
            "cut_body": body_range(c("cut_measures")),
            "inc_body": body_range(c("inc_measures")),
            "inc_closing": closing_range(c("inc_measures")),
            "inc_cause_plain": drop_component_label(c("inc_cause")),
            "note_expected": expected_note(),
            "owner_expected": leading_token(shown(c("inc_class"))),
            "band_expected": hour_band(c("cut_hours")),
        }
    )


def missing_incident_message() -> Column:
    return text(
        "Nro Incidencia ", c("nro_incidencia"), " con FECHA Y HORA INICIO DE CORTE EXCEL ",
        c("cut_start_text"), " y FECHA HORA FIN DE CORTE EXCEL  ", c("cut_end_text"),
        " no se encuentra en el reporte dinamico SGA - 335 para el rango de fecha de este corte \n",
    )


def missing_incident() -> Rule:
    """1.0: every row of the unmatched side is a finding."""
    return Rule("1.0", 10, [Check("found", F.lit(False), missing_incident_message())])


def service_and_district() -> Rule:
    service, mapped = c("cut_service"), c("map_service")
    return Rule("1.1", 11, [
        Check("service_match", same(service, mapped), text(
            "\n CUISMP en Sharepoint CID-CUISMP: \n", shown(mapped),
            "\n es diferente a EXCEL -CORTE (CUISMP): \n", shown(service))),
        Check("district_match", same(F.lower(c("cut_district")), F.lower(shown(c("map_district")))), text(
            "\n Distrito Fiscal en Sharepoint CID-CUISMP: \n", shown(c("map_district")),
            "\n es diferente a EXCEL -CORTE (DF):  \n", c("cut_district"))),
        Check("service_in_measures", F.contains(c("cut_measures"), service), text(
            "\n CUISMP: \n ", shown(service),
            "\n no encontrado in MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS.")),
    ])


def start_and_end() -> Rule:
    return Rule("1.2", 12, [
        Check("dates_present", c("cut_start").isNotNull() & c("cut_end").isNotNull(), text(
            "\n Las columnas ‘FECHA Y HORA INICIO’ y/o ‘FECHA Y HORA FIN’ están vacías. ")),
        Check("start_match", same(c("exp_start"), c("cut_start")), text(
            "\n (interrupcion_inicio|fecha generacion) en SGA: \n", c("exp_start_text"),
            "\n no coincide con FECHA Y HORA INICIO CORTE-EXCEL: \n", c("cut_start_text"))),
        Check("end_match", same(c("inc_end_min"), c("cut_end")), text(
            "\n (interrupcion_fin) en SGA: \n", c("inc_end_text"),
            "\n no coincide con FECHA Y HORA FIN CORTE-EXCEL: \n", c("cut_end_text"))),
    ])


def stated_span() -> Rule:
    return Rule("1.3", 13, [
        Check("incident_not_negative", not_negative(c("inc_sec")), text(
            "\n Diferencia en fechas interrupcion fin - inicio Esperado (depende si es masivo ) en SGA - 335  es negativo. ")),
        Check("cut_not_negative", not_negative(c("cut_diff_sec")), text(
            "\n Diferencia Fecha Hora Fin - Fecha Hora Inicio en CORTE-EXCEL  es negativo. ")),
        Check("span_not_negative", not_negative(c("cut_span_min")), text(
            "\n\n FIN-INICIO (HH:MM) is negativo. ")),
        Check("incident_cut_match", within(c("inc_min"), c("cut_diff_min")), text(
            "\n Diferencia en Fecha Fin y Inicio esperado (depende si es masivo) en SGA 335: \n", c("inc_hhmm"),
            "\n no coincide con diferencia en Fecha Inicio y Fin en CORTE-EXCEL (FIN-INICIO (HH:MM)): \n",
            c("cut_diff_hhmm"))),
        Check("span_match", same(c("cut_diff_hhmm"), c("cut_span")), text(
            " \n Diferencia en Fecha Inicio y Fin en CORTE-EXCEL: \n", c("cut_diff_hhmm"),
            "\n no coincide con column FIN-INICIO (HH:MM) en CORTE-EXCEL:  \n", shown(c("cut_span"), "<NA>"))),
    ])


def minutes_hhmm(minutes: Column) -> Column:
    hours = F.floor(minutes / 60).cast("bigint")
    rest = F.floor(F.pmod(minutes, F.lit(60.0))).cast("bigint")
    return F.concat(two_digits(hours), F.lit(":"), two_digits(rest))


def net_time() -> Rule:
    return Rule("1.4", 14, [
        Check("incident_not_negative", not_negative(c("inc_span_min")), text(
            "\n  INTERRUPCION_FIN - INTERRUPCION_INICIO es negativo. \n")),
        Check("stops_not_negative", not_negative(c("sum_paradas")), text(
            "\n  Suma de paradas de reloj es negativa. \n")),
        Check("net_not_negative", not_negative(c("net_minutes")), text(
            "\n Tiempo efectivo (INTERRUPCION - paradas) es negativo.")),
        Check("net_match", within(minutes_of(c("cut_time")), c("net_minutes")), text(
            "\n EL TIEMPO (HH:MM) en CORTE-EXCEL: \n", shown(c("cut_time")),
            "\n no coincide con el tiempo efectivo calculado SGA: \n", shown(minutes_hhmm(c("net_minutes"))))),
    ])


def case_circuit_parent_cause() -> Rule:
    cause = c("inc_cause_plain")
    return Rule("1.5", 15, [
        Check("cause_match", same(c("cut_cause"), cause), text(
            " \n No coincide Determinacion de la causa Excel-Corte: \n", c("cut_cause"),
            "\n con SGA Determinación de la causa: \n", cause)),
        Check("case_match", same(c("inc_case"), c("cut_case")), text(
            "\n No coincide Tipo de Caso de CORTE-EXCEL: \n", c("cut_case"),
            "\n con SGA columna tipo_caso: \n\n", c("inc_case"))),
        Check("cid_match", same(c("inc_cid"), c("cut_cid")), text(
            "\n No coincide cid  de CORTE-EXCEL : \n", c("cut_cid"),
            "\n con cid de SGA: \n", c("inc_cid"))),
        Check("parent_match", same(c("inc_parent"), c("cut_parent")), text(
            "\n  No coincide nro incidencia padre EXCEL-CORTE: \n", c("cut_parent"),
            "con columna SGA codeincidencepadre: \n", c("inc_parent"))),
        Check("mass_match", same(c("inc_mass"), c("cut_mass")), text(
            "\n  No coincide MASIVO EXCEL-CORTE: \n", shown(c("cut_mass")),
            "con columna masivo SGA: \n", shown(c("inc_mass")))),
    ])


FAULT_PREFIX = 37  # Fixed value: characters that must agree.


def fault_type() -> Rule:
    a, b = strip(shown(c("cut_fault"))), strip(shown(c("inc_problem")))
    ok = same(a, b) | same(F.substring(a, 1, FAULT_PREFIX), F.substring(b, 1, FAULT_PREFIX))
    return Rule("1.6", 16, [
        Check("fault_match", ok, text(
            "\n No coincide columnna AVERÍA en EXCEL-CORTE: \n", shown(c("cut_fault")),
            "\n con tipificacion_problema en SGA 335: \n", shown(c("inc_problem")))),
    ])


def expected_note() -> Column:
    """Observation text for the row's component and site; empty for other types."""
    table = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    opening = F.try_element_at(table, c("cut_component"))
    known = c("tipo_reporte").isin(CLAIM, PROACTIVE) & opening.isNotNull()
    return F.when(known, F.concat(opening, shown(c("map_site")))).otherwise(F.lit(""))


def report_type(check_monitoring: bool = False) -> Rule:
    """1.7.  The monitoring suffix of claims is not checked unless asked for."""
    claim, proactive = c("tipo_reporte") == CLAIM, c("tipo_reporte") == PROACTIVE
    monitoring = F.endswith(c("inc_case"), F.lit("MONITOREO"))
    opening = c("cut_measures").rlike(PROACTIVE_OPENING)
    note = c("note_expected")
    note_ok = same(F.lower(c("cut_note")), F.lower(note))
    no_monitoring = ~claim | ~monitoring if check_monitoring else F.lit(True)
    return Rule("1.7", 17, [
        Check("claim_case", ~claim | c("inc_case").isin(*CLAIM_CASES), text(
            "\n\n EN SGA columna tipo_caso:  \n\n", c("inc_case"),
            " \n\n , no está en lista permitida : (SIN SERVICIO , ENLACE LENTO, SIN SERVICIO-NO DA TONO , OTROS CALIDAD).")),
        Check("claim_not_monitoring", no_monitoring, text(
            "\n\n EN SGA columna tipo_caso: \n\n ", c("inc_case"), "\n\n , no debe terminar en 'MONITOREO'.")),
        Check("claim_opening", ~claim | ~opening, text(
            "\n No coincide  EXCEL-CORTE RECLAMO columna MEDIDAS CORRECTIVAS : \n"
            "\n  , no debe iniciar con 'A través de los Sistemas de Monitoreo de Claro, de manera proactiva se identificó'.")),
        Check("claim_note", ~claim | note_ok, text(
            "\n EN EXCEL-CORTE RECLAMO columna OBSERVACION: debe ser: \n", note,
            "\n , pero se obtuvo: \n ", shown(c("cut_note")))),
        Check("proactive_case", ~proactive | monitoring, text(
            "\n\n EN SGA columna tipo_caso: \n\n", c("inc_case"), "\n\n , debe terminar en 'MONITOREO'.")),
        Check("proactive_opening", ~proactive | opening, text(
            "\n EN EXCEL-CORTE PROACTIVO columna MEDIDAS CORRECTIVAS:  \n"
            " \n\n debe iniciar con 'A través de los Sistemas de Monitoreo de Claro, de manera proactiva se identificó'.")),
        Check("proactive_note", ~proactive | note_ok, text(
            "\n EN EXCEL-CORTE PROACTIVO columna OBSERVACION  debe ser: \n", note,
            "\n  , pero se obtuvo \n", shown(c("cut_note")))),
    ])


def narrative_dates() -> Rule:
    mass = c("inc_mass") == "Si"
    cut, inc, closing = c("cut_body"), c("inc_body"), c("inc_closing")
    first = lambda s: s["first"]
    last = lambda s: s["last"]
    return Rule("1.8", 18, [
        Check("cut_first", same(first(cut), c("cut_start_text")) | mass, text(
            " \n La primera fecha/hora  del parrafo (CUERPO) en columna MEDIDAS CORRECTIVAS - EXCEL: \n", shown(first(cut), "None"),
            "\n no coincide con la columna FECHA Y HORA INICIO DE EXCEL - CORTE : \n", c("cut_start_text"))),
        Check("cut_last", same(last(cut), c("cut_end_text")) | mass, text(
            "\n  La última fecha/hora del parrafo (CUERPO) en columna MEDIDAS CORRECTIVAS - EXCEL: \n", shown(last(cut), "None"),
            "\n no coincide con la columna FECHA Y HORA FIN DE EXCEL - CORTE : \n", c("cut_end_text"))),
        Check("incident_first", same(first(inc), first(closing)) | mass, text(
            "\n  La primera fecha/hora del parrafo (CUERPO) en it_medidas_tomadas SGA:  \n", shown(first(inc), "None"),
            "\n no coincide con la Fecha y hora inicio de la penultima fila it_medidas_tomadas SGA : \n",
            shown(first(closing), "None"))),
        Check("incident_last", same(last(inc), last(closing)) | mass, text(
            "\n  La última fecha/hora del parrafo (CUERPO) en it_medidas_tomadas SGA : \n", shown(last(inc), "None"),
            "\n no coincide con la Fecha y hora fin de la última fila SGA it_medidas_tomadas SGA: \n",
            shown(last(closing), "None"))),
        Check("phrase_once", ~repeats_phrase(c("cut_measures")), text(
            "\n La palabra 'A través' se repite ", shown(c("cut_phrases")),
            " veces en el parrafo en MEDIDAS CORRECTIVAS:")),
        Check("no_slash_typo", ~has_slash_typo(c("cut_measures")), text(
            "\nSe encontró un error de redacción con 'cliente/debido' en la columna "
            "'MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS'.")),
    ])


def owner() -> Rule:
    expected = c("owner_expected")
    return Rule("1.9", 19, [
        Check("owner_match", same(strip(shown(c("cut_owner"))), expected), text(
            "\n No coincide la columna RESPONSABILIDAD en CORTE-EXCEL: \n", shown(c("cut_owner")),
            "\n no coincide con la primera palabra de tipificacion_tipo en SGA 335: \n", expected)),
    ])


def whole_hours() -> Rule:
    band = c("band_expected")
    return Rule("1.10", 20, [
        Check("hours_match", same(c("cut_time_hours").cast("double"), c("cut_hours")), text(
            "\n Duración entero EXCEL-CORTE: \n", shown(c("cut_hours_text")),
            "\n es diferente a hora extraída de TIEMPO (HH:MM) en EXCEL-CORTE: \n", shown(c("cut_time_hours")))),
        Check("band_match", same(strip(c("cut_band")), band), text(
            "\n Es incorrecto Agrupación entero en CORTE-EXCEL: \n", shown(c("cut_band")),
            "\n debe ser: \n", band)),
    ])


def with_block(df: DataFrame) -> DataFrame:
    """The outage block that rule 1.11 reads."""
    return df.withColumn("block", outage_block_strict(c("cut_block")))


def outage_text() -> Rule:
    block = c("block")
    ours = lambda part: strip(c(f"stops_{part}"))
    theirs = lambda part: strip(block[part])
    return Rule("1.11", 21, [
        Check("block_header", same(theirs("header"), ours("header")), text(
            "\n Encabezado inválido en EXCEL-CORTE columna INDISPONIBILIDAD: \n", block["header"],
            "\n es diferente a formato de Encabezado Indisponibilidad debe ser: \n", c("stops_header"))),
        Check("block_periods", same(theirs("periods"), ours("periods")), text(
            "\n Parada(s) de clientes en  CORTE - EXCEL columna INDISPONIBILIDAD : \n", block["periods"],
            "\n  ES DIFERENTE A SGA PAUSA CLIENTE SIN OVERLAP: \n", c("stops_periods"))),
        Check("block_total", same(theirs("total"), ours("total")), text(
            "\n Total inválido CORTE - EXCEL columna INDISPONIBILIDAD: \n", block["total"],
            "\n  ES DIFERENTE a total SGA PAUSA CLIENTE SIN OVERLAP: \n", c("stops_total"))),
    ])


def cut_rules(outage_block_rule: bool = False, check_monitoring: bool = False) -> list[Rule]:
    """Rules 1.1 to 1.10; 1.11 and the monitoring suffix only when asked for."""
    rules = [
        service_and_district(),
        start_and_end(),
        stated_span(),
        net_time(),
        case_circuit_parent_cause(),
        fault_type(),
        report_type(check_monitoring),
        narrative_dates(),
        owner(),
        whole_hours(),
    ]
    return [*rules, outage_text()] if outage_block_rule else rules
