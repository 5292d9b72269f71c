"""The validator in plain SQL, written independently of the engine's code."""

from __future__ import annotations

from catalog.dialect import Duck
from catalog.inputs import (
    DATA_NOTE,
    STOPS_HEADER,
    VOICE_NOTE,
    annex_columns,
    circuit_columns,
    cut_columns,
    duck_cte,
    fault_columns,
    incident_columns,
    long_incident_columns,
    report_columns,
    stop_columns,
)

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
M = '"MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS"'
DUR = r"^(?:(\d+)\s+days?,\s*)?(\d+):(\d{2})(?::\d{2})?\.?$"
DUR_H = r"^(?:(\d+)\s+days?,\s*)?(\d{1,2}):"
PAIR = r"(\d{2}/\d{2}/\d{4})\D{0,10}(\d{1,2}:\d{2})"
PAIR_NG = r"\d{2}/\d{2}/\d{4}\D{0,10}\d{1,2}:\d{2}"
LAST = r"(?i)(\d{2}/\d{2}/\d{4})\s*(?:a las\s*)?(\d{1,2}:\d{2})"
PREFIX = r"(?i)(?:COMPONENTE|COMONENTE)\s*(?:IV|II|III|I|V)(?:\s*-|\s*\.-|\s*)\s*"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str, newlines: bool = False) -> str:
    out = f"replace(replace({x}, chr(13), ' '), '_x000D_', '')"
    if not newlines:
        out = f"replace({out}, chr(10), '')"
    return strip(out)


def cell(x: str, newlines: bool = False) -> str:
    return f"coalesce({clean(x, newlines)}, 'nan')"


def known(x: str) -> str:
    return f"coalesce(nullif({x}, ''), 'No disponible')"


def whole(x: str) -> str:
    t = strip(x)
    return (
        f"case when regexp_matches({t}, '^[+-]?\\d+$') then cast(try_cast({t} as hugeint) as varchar) "
        f"when regexp_matches({t}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
        f"then cast(cast(trunc(try_cast({t} as double)) as bigint) as varchar) else '' end"
    )


def num(x: str) -> str:
    return f"coalesce(try_cast(nullif({x}, '') as bigint), 0)"


def duration(x: str) -> str:
    t = strip(x)
    g = lambda i: f"regexp_extract({t}, '{DUR}', {i})"
    return f"case when regexp_matches({t}, '{DUR}') then printf('%02d:%s', {num(g(1))} * 24 + {num(g(2))}, {g(3)}) end"


def duration_hours(x: str) -> str:
    t = strip(x)
    g = lambda i: f"regexp_extract({t}, '{DUR_H}', {i})"
    return f"case when regexp_matches({t}, '{DUR_H}') then {num(g(1))} * 24 + {num(g(2))} end"


def hhmm(sec: str) -> str:
    return (
        f"printf('%02d:%02d', cast(floor({sec} / 3600.0) as bigint), "
        f"cast(floor(((({sec}) % 3600) + 3600) % 3600 / 60.0) as bigint))"
    )


def mins(x: str) -> str:
    return (
        f"case when len(string_split({x}, ':')) = 2 then try_cast(split_part({x}, ':', 1) as double) * 60 "
        f"+ try_cast(split_part({x}, ':', 2) as double) end"
    )


def minute(ts: str) -> str:
    return f"coalesce(strftime({ts}, '%d/%m/%Y %H:%M'), 'N/A')"


def dayfirst(x: str) -> str:
    return f"try_strptime({strip(x)}, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y'])"


def seconds(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) // 1000000"


def prepared_cut(newlines: bool = False) -> str:
    t = lambda c: known(cell(f'"{c}"', newlines))
    c = lambda n: cell(f'"{n}"', newlines)
    time = c("TIEMPO (HH:MM)")
    return f"""cut0 as (select
  {t('TICKET')} as nro_incidencia,
  "FECHA Y HORA INICIO" as cut_start, "FECHA Y HORA FIN" as cut_end,
  {known(whole(c('CUISMP')))} as cut_service,
  {t('TIPO CASO')} as cut_case, {c('AVERÍA')} as cut_fault,
  case when suffix({time}, ':00') then left({time}, 5) else {time} end as cut_time,
  coalesce({duration_hours(time)}, 0) as cut_time_hours,
  {c('COMPONENTE')} as cut_component, {t('DF')} as cut_district, {c('OBSERVACIÓN')} as cut_note,
  {t('CID')} as cut_cid, {duration(c('FIN-INICIO (HH:MM)'))} as cut_span,
  {t('DETERMINACIÓN DE LA CAUSA')} as cut_cause, {c('RESPONSABILIDAD')} as cut_owner,
  {c('TIPO REPORTE')} as tipo_reporte, cast(coalesce("Duracion entero", 0) as double) as cut_hours,
  cast(coalesce("Duracion entero", 0) as varchar) as cut_hours_text, {c('Agrupación entero')} as cut_band,
  {known(whole(c('CODINCIDENCEPADRE')))} as cut_parent, {c('MASIVO')} as cut_mass,
  {known(cell(M, newlines))} as cut_measures, {c('INDISPONIBILIDAD')} as cut_block, source_row as "row"
  from cut_raw),
cut as (select *,
  len(regexp_extract_all(cut_measures, 'A\\s+través')) as cut_phrases,
  {minute('cut_start')} as cut_start_text, {minute('cut_end')} as cut_end_text,
  {seconds('cut_start', 'cut_end')} as cut_diff_sec,
  {hhmm('coalesce(' + seconds('cut_start', 'cut_end') + ', 0)')} as cut_diff_hhmm,
  cast(floor(coalesce({seconds('cut_start', 'cut_end')}, 0) / 60.0) as bigint) as cut_diff_min,
  {mins('cut_span')} as cut_span_min
  from cut0)"""


def prepared_incidents(newlines: bool = False) -> str:
    t = lambda c: known(cell(c, newlines))
    return f"""inc0 as (select
  {t('nro_incidencia')} as nro_incidencia, {t('cid')} as inc_cid, {t('tipo_caso')} as inc_case,
  {t('it_determinacion_de_la_causa')} as inc_cause, {known(whole(cell('codincidencepadre')))} as inc_parent,
  {cell('masivo')} as inc_mass, {cell('tipificacion_problema')} as inc_problem,
  {cell('tipificacion_tipo')} as inc_class, {cell('it_medidas_tomadas', newlines)} as inc_measures,
  {dayfirst('interrupcion_inicio')} as inc_start, {dayfirst('interrupcion_fin')} as inc_end,
  date_trunc('minute', {dayfirst('fecha_generacion')}) as gen
  from inc_raw),
inc1 as (select * exclude (gen),
  date_trunc('minute', inc_end) as inc_end_min,
  case when inc_mass = 'Si' then
    case when date_trunc('minute', inc_end) < gen then date_trunc('minute', inc_start) else gen end
    else date_trunc('minute', inc_start) end as exp_start
  from inc0),
inc as (select *,
  {minute('exp_start')} as exp_start_text, {minute('inc_end_min')} as inc_end_text,
  coalesce({seconds('exp_start', 'inc_end_min')}, 0) as inc_sec,
  {hhmm('coalesce(' + seconds('exp_start', 'inc_end_min') + ', 0)')} as inc_hhmm,
  cast(floor(coalesce({seconds('exp_start', 'inc_end_min')}, 0) / 60.0) as bigint) as inc_min,
  {seconds('exp_start', 'inc_end_min')} / 60.0 as inc_span_min
  from inc1)"""


CIRCUITS = f"""circ as (select coalesce("CID", 'nan') as inc_cid, {whole('"CUISMP"')} as map_service,
  coalesce({strip('"Distrito Fiscal"')}, 'nan') as map_district, coalesce({strip('"SEDE"')}, 'nan') as map_site
  from circ_raw)"""

STOPS = f"""clip as (select i.nro_incidencia as k, i.inc_start as lo, i.inc_end as hi,
    greatest(s.startdate, i.inc_start) as s,
    case when s.enddate is not null then least(s.enddate, i.inc_end) end as e
  from stop_raw s join (select distinct nro_incidencia, inc_start, inc_end from BOUNDS) i
    on s.nro_incidencia = i.nro_incidencia
  where s.startdate is not null),
numbered as (select *, row_number() over (order by k, s, e nulls last) as rn
  from clip where e is null or s < e),
ends as (select *, coalesce(e, lead(s) over (partition by k order by rn)) as e2 from numbered),
flags as (select *, max(e2) over (partition by k order by rn
    rows between unbounded preceding and 1 preceding) as before from ends where e2 is not null),
grp as (select *, sum(case when before is null or s > before then 1 else 0 end)
    over (partition by k order by rn rows unbounded preceding) as g from flags),
merged as (select k, g, min(s) as s, max(e2) as e from grp group by k, g),
tot as (select k, count(*) as n_stops, cast(sum(epoch_us(e) - epoch_us(s)) as bigint) as us,
    string_agg(strftime(s, '%d/%m/%Y %H:%M:%S') || ' hasta el día ' || strftime(e, '%d/%m/%Y %H:%M:%S'),
      chr(10) order by s) as periods from merged group by k),
stops as (select k, n_stops, us / 60000000.0 as sum_paradas, '{STOPS_HEADER}' as stops_header,
  periods as stops_periods, {hhmm('(us // 1000000)')} as stops_total from tot)"""


def stop_ctes(bounds: str = "inc") -> str:
    return STOPS.replace("BOUNDS", bounds)


MATCHED = """m as (select c.*, i.* exclude (nro_incidencia), ci.* exclude (inc_cid),
  coalesce(st.sum_paradas, 0.0) as sum_paradas, coalesce(st.stops_header, '') as stops_header,
  coalesce(st.stops_periods, '') as stops_periods, coalesce(st.stops_total, '') as stops_total
  from cut c join inc i on c.nro_incidencia = i.nro_incidencia
  left join circ ci on i.inc_cid = ci.inc_cid
  left join stops st on c.nro_incidencia = st.k),
u as (select * from cut where nro_incidencia not in (select nro_incidencia from inc))"""

WORD = f"""faults as (select "Número de ticket" as nro_incidencia,
  case when "Causa" like '%2-HIGH' then 'COMPONENTE IV' else 'COMPONENTE II' end as word_component,
  try_strptime("Fecha y Hora Inicio", '%d/%m/%Y %H:%M') as word_start,
  try_strptime("Fecha y Hora Fin", '%d/%m/%Y %H:%M') as word_end,
  "CUISMP" as word_service, "Avería reportada" as word_case, "Causa" as word_fault,
  "Tiempo real de afectación (HH:MM)" as word_time, "Distrito Fiscal" as word_district,
  "Tiempo Total (HH:MM)" as word_span, "responsable" as word_owner from fault_raw),
reports as (select nro_incidencia,
  case when nro_incidencia in (select nro_incidencia from faults where word_component = 'COMPONENTE IV')
    then 'COMPONENTE IV' else 'COMPONENTE II' end as word_component,
  "CUISMP" as word_service, "Tipo Caso" as word_case, "Observación" as word_note,
  "DETERMINACIÓN DE LA CAUSA" as word_cause, {M} as word_measures,
  "Fecha y hora inicio" as word_start_text, "Fecha y hora fin" as word_end_text from report_raw),
annexes as (select ticket as nro_incidencia,
  case when ticket in (select nro_incidencia from faults where word_component = 'COMPONENTE IV')
    then 'COMPONENTE IV' else 'COMPONENTE II' end as cut_component,
  indisponibilidad_header as annex_header, indisponibilidad_periodos as annex_periods,
  indisponibilidad_total as annex_total from annex_raw),
claims as (select * from cut where tipo_reporte = 'RECLAMO' and cut_component in ('COMPONENTE II', 'COMPONENTE IV')),
mf as (select c.*, f.* exclude (nro_incidencia) from cut c join faults f using (nro_incidencia)),
mr as (select c.*, r.* exclude (nro_incidencia) from cut c join reports r using (nro_incidencia)),
ma as (select m.*, coalesce(a.annex_header, 'no encontrado') as annex_header,
  coalesce(a.annex_periods, 'no encontrado') as annex_periods, coalesce(a.annex_total, 'no encontrado') as annex_total
  from m left join annexes a on m.nro_incidencia = a.nro_incidencia and m.cut_component = a.cut_component
  where m.cut_component in ('COMPONENTE II', 'COMPONENTE IV')),
no_fault as (select * from claims c where not exists (select 1 from faults f
  where f.nro_incidencia = c.nro_incidencia and f.word_component = c.cut_component)),
no_report as (select * from claims c where not exists (select 1 from reports f
  where f.nro_incidencia = c.nro_incidencia and f.word_component = c.cut_component))"""


def raw_ctes(long_incidents: bool = False) -> str:
    inc = long_incident_columns if long_incidents else incident_columns
    return ",\n".join(
        [
            duck_cte("cut_raw", "orders", cut_columns(Duck)),
            duck_cte("inc_raw", "orders", inc(Duck)),
            duck_cte("stop_raw", "lineitem", stop_columns(Duck)),
            duck_cte("circ_raw", "customer", circuit_columns(Duck)),
            duck_cte("fault_raw", "orders", fault_columns(Duck)),
            duck_cte("report_raw", "orders", report_columns(Duck)),
            duck_cte("annex_raw", "orders", annex_columns(Duck)),
        ]
    )


def base(long_incidents: bool = False, newlines: bool = False) -> str:
    return "with " + ",\n".join(
        [
            raw_ctes(long_incidents),
            prepared_cut(newlines),
            prepared_incidents(newlines),
            CIRCUITS,
            stop_ctes(),
            MATCHED,
            WORD,
        ]
    )


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parts(*items: str) -> str:
    """Texts, and expressions marked with a leading ``=``."""
    return " || ".join(i[1:] if i.startswith("=") else lit(i) for i in items)


def nan(x: str, word: str = "nan") -> str:
    return f"=coalesce(cast({x} as varchar), '{word}')"


def body(x: str) -> str:
    return f"case when regexp_matches(trim({x}), '(?i)^fecha y hora(?: de)? (?:inicio|fin)\\s*:?') then '' else {x} end"


def body_first(x: str) -> str:
    b = body(x)
    at = f"length(regexp_extract({b}, '(?s)^(.*?){PAIR_NG}', 1))"
    value = f"regexp_extract({b}, '{PAIR}', 1) || ' ' || lpad(regexp_extract({b}, '{PAIR}', 2), 5, '0')"
    return f"case when regexp_matches({b}, '{PAIR_NG}') and {at} * 2 < length({b}) then {value} else 'No disponible' end"


def body_last(x: str) -> str:
    b = body(x)
    at = f"length(regexp_extract({b}, '(?s)^(.*){PAIR_NG}', 1))"
    hit = f"regexp_extract_all({b}, '{PAIR_NG}')[-1]"
    value = f"regexp_extract({hit}, '{PAIR}', 1) || ' ' || lpad(regexp_extract({hit}, '{PAIR}', 2), 5, '0')"
    return f"case when regexp_matches({b}, '{PAIR_NG}') and {at} * 2 >= length({b}) then {value} else 'No disponible' end"


def closing(x: str, i: int, padded: bool = True) -> str:
    hits = f"regexp_extract_all({x}, '{LAST}')"
    time = f"regexp_extract({hits}[{i}], '{LAST}', 2)"
    if padded:
        time = f"lpad({time}, 5, '0')"
    return f"case when len({hits}) >= 2 then regexp_extract({hits}[{i}], '{LAST}', 1) || ' ' || {time} end"


CAUSE = strip(f"regexp_replace(inc_cause, '{PREFIX}', '', 'g')")
NET = "(inc_span_min - sum_paradas)"
NET_TEXT = (
    f"=coalesce(printf('%02d:%02d', cast(floor({NET} / 60) as bigint), "
    f"cast(floor((({NET} % 60) + 60) % 60) as bigint)), 'nan')"
)
NOTE = (
    "case when tipo_reporte in ('RECLAMO', 'PROACTIVO') and cut_component in ('COMPONENTE II', 'COMPONENTE III', 'COMPONENTE V') "
    f"then '{DATA_NOTE}' || coalesce(map_site, 'nan') "
    f"when tipo_reporte in ('RECLAMO', 'PROACTIVO') and cut_component = 'COMPONENTE IV' then '{VOICE_NOTE}' || coalesce(map_site, 'nan') else '' end"
)
OPENED = "regexp_matches(cut_measures, '(?i)^a través de los sistemas de monitoreo de claro, de manera proactiva se identificó')"
BAND = (
    "case when cut_hours = 0 then 'Menor a 1h' when cut_hours in (1, 2, 3) then 'Entre 1h a 4h' "
    "when cut_hours in (4, 5, 6, 7) then 'Entre 4h a 8h' when cut_hours between 8 and 23 then 'Entre 8h a 24h' else 'Mayor a 24h' end"
)
NARR = lambda x: f"trim(regexp_replace(nfc_normalize({x}), '[\\s\\x{{a0}}]+', ' ', 'g'))"
DOC = "=case when cut_component = 'COMPONENTE IV' then 'telefonia' else 'datos' end"
STAMP = lambda x: f"=coalesce(strftime({x}, '%Y-%m-%d %H:%M:%S'), 'NaT')"
EXPECTED_OWNER = strip("split_part(inc_class, '-', 1)")
BLK = "list_filter(list_transform(string_split(cut_block, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
BLK_H = f"coalesce(list_filter({BLK}, lambda x: regexp_matches(x, '(?i)^Se tuvo indisponibilidad por parte del cliente para continuar los trabajos el/los día\\(s\\)'))[-1], '')"
PER = r"(?i)^(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})\s+hasta el día\s+(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})"


def pad_dt(x: str) -> str:
    # RE2 has no look-ahead, so the text that follows is kept as a group.
    return (
        f"regexp_replace(regexp_replace({x}, '\\b(\\d)(/\\d{{1,2}}/\\d{{4}})', '0\\1\\2', 'g'), "
        f"'\\b(\\d)(:\\d{{2}})', '0\\1\\2', 'g')"
    )


BLK_P = (
    f"coalesce(array_to_string(list_transform(list_filter({BLK}, lambda x: regexp_matches(x, '{PER}')), "
    f"lambda x: {pad_dt(f'''regexp_extract(x, '{PER}', 1)''')} || ' hasta el día ' || {pad_dt(f'''regexp_extract(x, '{PER}', 2)''')}), chr(10)), '')"
)
TOT = r"(?i)\(Total de horas sin acceso a la sede:\s*(\d{1,2}:\d{2})\s*horas\)"
BLK_T = (
    f"coalesce(lpad(regexp_extract(list_filter({BLK}, lambda x: regexp_matches(x, '{TOT}'))[-1], '{TOT}', 1), 5, '0'), '')"
)

# code -> (source, sequence, condition, [(check, message parts)])
RULES: dict[str, tuple] = {
    "1.0": ("u", "10", None, [("false", (
        "Nro Incidencia ", "=nro_incidencia", " con FECHA Y HORA INICIO DE CORTE EXCEL ", "=cut_start_text",
        " y FECHA HORA FIN DE CORTE EXCEL  ", "=cut_end_text",
        " no se encuentra en el reporte dinamico SGA - 335 para el rango de fecha de este corte \n"))]),
    "1.1": ("m", "11", None, [
        ("cut_service = map_service", ("\n CUISMP en Sharepoint CID-CUISMP: \n", nan("map_service"),
            "\n es diferente a EXCEL -CORTE (CUISMP): \n", "=cut_service")),
        ("lower(cut_district) = lower(coalesce(map_district, 'nan'))", ("\n Distrito Fiscal en Sharepoint CID-CUISMP: \n",
            nan("map_district"), "\n es diferente a EXCEL -CORTE (DF):  \n", "=cut_district")),
        ("strpos(cut_measures, cut_service) > 0", ("\n CUISMP: \n ", "=cut_service",
            "\n no encontrado in MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS."))]),
    "1.2": ("m", "12", None, [
        ("cut_start is not null and cut_end is not null",
            ("\n Las columnas ‘FECHA Y HORA INICIO’ y/o ‘FECHA Y HORA FIN’ están vacías. ",)),
        ("exp_start = cut_start", ("\n (interrupcion_inicio|fecha generacion) en SGA: \n", "=exp_start_text",
            "\n no coincide con FECHA Y HORA INICIO CORTE-EXCEL: \n", "=cut_start_text")),
        ("inc_end_min = cut_end", ("\n (interrupcion_fin) en SGA: \n", "=inc_end_text",
            "\n no coincide con FECHA Y HORA FIN CORTE-EXCEL: \n", "=cut_end_text"))]),
    "1.3": ("m", "13", None, [
        ("inc_sec >= 0", ("\n Diferencia en fechas interrupcion fin - inicio Esperado (depende si es masivo ) en SGA - 335  es negativo. ",)),
        ("cut_diff_sec >= 0", ("\n Diferencia Fecha Hora Fin - Fecha Hora Inicio en CORTE-EXCEL  es negativo. ",)),
        ("cut_span_min >= 0", ("\n\n FIN-INICIO (HH:MM) is negativo. ",)),
        ("abs(inc_min - cut_diff_min) <= 1", (
            "\n Diferencia en Fecha Fin y Inicio esperado (depende si es masivo) en SGA 335: \n", "=inc_hhmm",
            "\n no coincide con diferencia en Fecha Inicio y Fin en CORTE-EXCEL (FIN-INICIO (HH:MM)): \n", "=cut_diff_hhmm")),
        ("cut_diff_hhmm = cut_span", (" \n Diferencia en Fecha Inicio y Fin en CORTE-EXCEL: \n", "=cut_diff_hhmm",
            "\n no coincide con column FIN-INICIO (HH:MM) en CORTE-EXCEL:  \n", nan("cut_span", "<NA>")))]),
    "1.4": ("m", "14", None, [
        ("inc_span_min >= 0", ("\n  INTERRUPCION_FIN - INTERRUPCION_INICIO es negativo. \n",)),
        ("sum_paradas >= 0", ("\n  Suma de paradas de reloj es negativa. \n",)),
        (f"{NET} >= 0", ("\n Tiempo efectivo (INTERRUPCION - paradas) es negativo.",)),
        (f"abs({mins('cut_time')} - {NET}) <= 1", ("\n EL TIEMPO (HH:MM) en CORTE-EXCEL: \n", "=cut_time",
            "\n no coincide con el tiempo efectivo calculado SGA: \n", NET_TEXT))]),
    "1.5": ("m", "15", None, [
        (f"cut_cause = {CAUSE}", (" \n No coincide Determinacion de la causa Excel-Corte: \n", "=cut_cause",
            "\n con SGA Determinación de la causa: \n", f"={CAUSE}")),
        ("inc_case = cut_case", ("\n No coincide Tipo de Caso de CORTE-EXCEL: \n", "=cut_case",
            "\n con SGA columna tipo_caso: \n\n", "=inc_case")),
        ("inc_cid = cut_cid", ("\n No coincide cid  de CORTE-EXCEL : \n", "=cut_cid", "\n con cid de SGA: \n", "=inc_cid")),
        ("inc_parent = cut_parent", ("\n  No coincide nro incidencia padre EXCEL-CORTE: \n", "=cut_parent",
            "con columna SGA codeincidencepadre: \n", "=inc_parent")),
        ("inc_mass = cut_mass", ("\n  No coincide MASIVO EXCEL-CORTE: \n", "=cut_mass",
            "con columna masivo SGA: \n", "=inc_mass"))]),
    "1.6": ("m", "16", None, [
        ("trim(cut_fault) = trim(inc_problem) or left(trim(cut_fault), 37) = left(trim(inc_problem), 37)", (
            "\n No coincide columnna AVERÍA en EXCEL-CORTE: \n", "=cut_fault",
            "\n con tipificacion_problema en SGA 335: \n", "=inc_problem"))]),
    "1.7": ("m", "17", None, [
        ("tipo_reporte <> 'RECLAMO' or inc_case in ('SIN SERVICIO', 'ENLACE LENTO', 'SIN SERVICIO-NO DA TONO', 'OTROS CALIDAD')", (
            "\n\n EN SGA columna tipo_caso:  \n\n", "=inc_case",
            " \n\n , no está en lista permitida : (SIN SERVICIO , ENLACE LENTO, SIN SERVICIO-NO DA TONO , OTROS CALIDAD).")),
        (f"tipo_reporte <> 'RECLAMO' or not {OPENED}", (
            "\n No coincide  EXCEL-CORTE RECLAMO columna MEDIDAS CORRECTIVAS : \n"
            "\n  , no debe iniciar con 'A través de los Sistemas de Monitoreo de Claro, de manera proactiva se identificó'.",)),
        (f"tipo_reporte <> 'RECLAMO' or lower(cut_note) = lower({NOTE})", (
            "\n EN EXCEL-CORTE RECLAMO columna OBSERVACION: debe ser: \n", f"={NOTE}",
            "\n , pero se obtuvo: \n ", "=cut_note")),
        ("tipo_reporte <> 'PROACTIVO' or suffix(inc_case, 'MONITOREO')", (
            "\n\n EN SGA columna tipo_caso: \n\n", "=inc_case", "\n\n , debe terminar en 'MONITOREO'.")),
        (f"tipo_reporte <> 'PROACTIVO' or {OPENED}", (
            "\n EN EXCEL-CORTE PROACTIVO columna MEDIDAS CORRECTIVAS:  \n"
            " \n\n debe iniciar con 'A través de los Sistemas de Monitoreo de Claro, de manera proactiva se identificó'.",)),
        (f"tipo_reporte <> 'PROACTIVO' or lower(cut_note) = lower({NOTE})", (
            "\n EN EXCEL-CORTE PROACTIVO columna OBSERVACION  debe ser: \n", f"={NOTE}",
            "\n  , pero se obtuvo \n", "=cut_note"))]),
    "1.8": ("m", "18", None, [
        (f"{body_first('cut_measures')} = cut_start_text or inc_mass = 'Si'", (
            " \n La primera fecha/hora  del parrafo (CUERPO) en columna MEDIDAS CORRECTIVAS - EXCEL: \n", f"={body_first('cut_measures')}",
            "\n no coincide con la columna FECHA Y HORA INICIO DE EXCEL - CORTE : \n", "=cut_start_text")),
        (f"{body_last('cut_measures')} = cut_end_text or inc_mass = 'Si'", (
            "\n  La última fecha/hora del parrafo (CUERPO) en columna MEDIDAS CORRECTIVAS - EXCEL: \n", f"={body_last('cut_measures')}",
            "\n no coincide con la columna FECHA Y HORA FIN DE EXCEL - CORTE : \n", "=cut_end_text")),
        (f"{body_first('inc_measures')} = {closing('inc_measures', -2)} or inc_mass = 'Si'", (
            "\n  La primera fecha/hora del parrafo (CUERPO) en it_medidas_tomadas SGA:  \n", f"={body_first('inc_measures')}",
            "\n no coincide con la Fecha y hora inicio de la penultima fila it_medidas_tomadas SGA : \n",
            f"=coalesce({closing('inc_measures', -2)}, 'None')")),
        (f"{body_last('inc_measures')} = {closing('inc_measures', -1)} or inc_mass = 'Si'", (
            "\n  La última fecha/hora del parrafo (CUERPO) en it_medidas_tomadas SGA : \n", f"={body_last('inc_measures')}",
            "\n no coincide con la Fecha y hora fin de la última fila SGA it_medidas_tomadas SGA: \n",
            f"=coalesce({closing('inc_measures', -1)}, 'None')")),
        ("cut_phrases <= 1", ("\n La palabra 'A través' se repite ", "=cast(cut_phrases as varchar)",
            " veces en el parrafo en MEDIDAS CORRECTIVAS:")),
        ("not regexp_matches(cut_measures, '(?i)cliente\\s*/\\s*debido')", (
            "\nSe encontró un error de redacción con 'cliente/debido' en la columna 'MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS'.",))]),
    "1.9": ("m", "19", None, [
        (f"trim(cut_owner) = {EXPECTED_OWNER}", (
            "\n No coincide la columna RESPONSABILIDAD en CORTE-EXCEL: \n", "=cut_owner",
            "\n no coincide con la primera palabra de tipificacion_tipo en SGA 335: \n", f"={EXPECTED_OWNER}"))]),
    "1.10": ("m", "20", None, [
        ("cut_time_hours = cut_hours", ("\n Duración entero EXCEL-CORTE: \n", "=cut_hours_text",
            "\n es diferente a hora extraída de TIEMPO (HH:MM) en EXCEL-CORTE: \n", "=cast(cut_time_hours as varchar)")),
        (f"trim(cut_band) = {BAND}", ("\n Es incorrecto Agrupación entero en CORTE-EXCEL: \n", "=cut_band",
            "\n debe ser: \n", f"={BAND}"))]),
    "1.11": ("m", "21", None, [
        (f"{BLK_H} = stops_header", ("\n Encabezado inválido en EXCEL-CORTE columna INDISPONIBILIDAD: \n", f"={BLK_H}",
            "\n es diferente a formato de Encabezado Indisponibilidad debe ser: \n", "=stops_header")),
        (f"{BLK_P} = stops_periods", ("\n Parada(s) de clientes en  CORTE - EXCEL columna INDISPONIBILIDAD : \n", f"={BLK_P}",
            "\n  ES DIFERENTE A SGA PAUSA CLIENTE SIN OVERLAP: \n", "=stops_periods")),
        (f"{BLK_T} = stops_total", ("\n Total inválido CORTE - EXCEL columna INDISPONIBILIDAD: \n", f"={BLK_T}",
            "\n  ES DIFERENTE a total SGA PAUSA CLIENTE SIN OVERLAP: \n", "=stops_total"))]),
    "2.0.1": ("no_fault", "case when cut_component = 'COMPONENTE IV' then 31 else 30 end", None, [("false", (
        "La incidencia de tipo RECLAMO no se encuentra en el cuadro de averías del Word de ", DOC, "."))]),
    "2.0.2": ("no_report", "case when cut_component = 'COMPONENTE IV' then 33 else 32 end", None, [("false", (
        "La incidencia de tipo RECLAMO no se encuentra en informe técnico del Word de ", DOC, "."))]),
    "2.1": ("mf", "case when word_component = 'COMPONENTE IV' then 35 else 34 end", None, [
        ("cut_start = word_start", ("\n  No coincide Fecha y Hora Inicio de WORD CUADRO AVERIAS : \n", STAMP("word_start"),
            "\n es diferente a FECHA Y HORA INICIO en EXCEL-CORTE:  \n", "=cut_start_text")),
        ("cut_end = word_end", ("\n  No coincide Fecha y Hora Fin de WORD CUADRO AVERIAS : \n", STAMP("word_end"),
            "\n es diferente columna FECHA Y HORA FIN en EXCEL-CORTE:  \n", "=cut_end_text")),
        ("cut_service = word_service", ("\n  No coincide CUISMP en WORD CUADRO AVERIAS : \n", nan("word_service"),
            "\n es diferente a CUISMP en CORTE-EXCEL: \n", "=cut_service")),
        ("cut_case = word_case", ("\n  No coincide Avería reportada de WORD CUADRO AVERIAS : \n", nan("word_case"),
            "\n es diferente a TIPO CASO en EXCEL-CORTE: \n", "=cut_case")),
        ("cut_fault = word_fault", ("\n  No coincide Causa de WORD CUADRO AVERIAS: \n", nan("word_fault"),
            "\n es diferente a AVERÍA de CORTE-EXCEL: \n", "=cut_fault")),
        ("cut_time = word_time", ("\n  No coincide Tiempo real de afectación de WORD CUADRO DE AVERIAS: \n", nan("word_time"),
            "\n es diferente a TIEMPO (HH:MM) de EXCEL-CORTE: \n", "=cut_time")),
        ("cut_component = word_component", (" \n No coincide COMPONENTE en  de WORD CUADRO DE AVERIAS : \n", "=word_component",
            "\n es diferente a la  columna COMPONENTE de CORTE-EXCEL: \n", "=cut_component")),
        ("cut_district = word_district", ("\n  No coincide Distrito Fiscal de WORD CUADRO DE AVERIAS : \n", nan("word_district"),
            "\n es diferente a column DF de CORTE-EXCEL: \n", "=cut_district")),
        ("cut_span = word_span", ("\n No coincide Tiempo Total (HH:MM) de WORD CUADRO DE AVERIAS : \n", nan("word_span"),
            "\n es diferente a la columna FIN-INICIO (HH:MM) de CORTE-EXCEL: \n", nan("cut_span", "<NA>"))),
        ("cut_owner = word_owner", ("\n  No coincide Responsable de WORD CUADRO DE AVERIAS : \n", nan("word_owner"),
            "\n es diferente a la columna RESPONSABILIDAD de CORTE-EXCEL: \n", "=cut_owner"))]),
    "2.2": ("mr", "case when word_component = 'COMPONENTE IV' then 37 else 36 end", None, [
        ("cut_start_text = word_start_text", ("\n No coincide Fecha y hora inicio de WORD informe técnico : \n", nan("word_start_text"),
            "\n , es diferente a EXCEL-CORTE:  \n\n", "=cut_start_text")),
        ("cut_end_text = word_end_text", ("\n  No coincide Fecha y hora fin de WORD en informe técnico : \n", nan("word_end_text"),
            "\n , es diferente a EXCEL-CORTE:  \n", "=cut_end_text")),
        ("cut_service = word_service", ("\n  No coincide CUISMP de WORD informe técnico : \n", nan("word_service"),
            "\n , es diferente a CUISMP en EXCEL-CORTE: \n", "=cut_service")),
        ("cut_case = word_case", ("\n\n  No coincide Avería reportada de WORD informe técnico : \n\n", nan("word_case"),
            "\n\n , es diferente a TIPO CASO en EXCEL-CORTE: \n\n", "=cut_case")),
        ("cut_note = word_note", ("\n  No coincide Observacion de WORD informe técnico : \n", nan("word_note"),
            "\n es diferente a OBSERVACIÓN en EXCEL-CORTE: \n", "=cut_note")),
        ("cut_cause = word_cause", ("\n  No coincide Determinación de la causa de WORD informe técnico : \n", nan("word_cause"),
            "\n , es diferente a DETERMINACION DE LA CAUSA en EXCEL-CORTE: \n", "=cut_cause")),
        (f"{NARR('cut_measures')} = {NARR('word_measures')}", ("\n  No coincide MEDIDAS CORRECTIVAS de WORD informe técnico : \n",
            nan("word_measures"), "\n , es diferente a MEDIDAS CORRECTIVAS en EXCEL-CORTE: \n", "=cut_measures"))]),
    "3.1": ("ma", "case when cut_component = 'COMPONENTE IV' then 41 else 40 end",
        "tipo_reporte = 'RECLAMO' and stops_header <> ''", [
        ("trim(annex_header) = stops_header", ("\n No coincide texto inicio de WORD ANEXOS INDISPONIBILIDAD : \n", "=annex_header",
            "\n es diferente a SGA PAUSA CLIENTE SIN OVERLAP: \n", "=stops_header")),
        ("trim(annex_periods) = stops_periods", ("\n No coincide paradas de reloj de WORD ANEXOS INDISPONIBILIDAD : \n", "=annex_periods",
            "\n es diferente a SGA PAUSA CLIENTE SIN OVERLAP :  \n", "=stops_periods")),
        ("trim(annex_total) = stops_total", ("\n No coincide total horas sin acceso a la sede de WORD ANEXOS INDISPONIBILIDAD : \n ", "=annex_total",
            "\n es diferente a SGA PAUSA CLIENTE SIN OVERLAP :  \n", "=stops_total"))]),
}


def _with_monitoring(rule: tuple) -> tuple:
    """Rule 1.7 with the check that is asked for by option, in its place."""
    source, seq, when, checks = rule
    asked = ("tipo_reporte <> 'RECLAMO' or not suffix(inc_case, 'MONITOREO')", (
        "\n\n EN SGA columna tipo_caso: \n\n ", "=inc_case", "\n\n , no debe terminar en 'MONITOREO'."))
    return source, seq, when, [checks[0], asked, *checks[1:]]


def monitoring_sql() -> str:
    return f"{base()}\n{_select('1.7', _with_monitoring(RULES['1.7']))}"


def rule_select(code: str) -> str:
    return _select(code, RULES[code])


def _select(code: str, rule: tuple) -> str:
    source, seq, when, checks = rule
    ok = [f"coalesce({c}, false)" for c, _ in checks]
    msg = " || ".join(f"case when {o} then '' else {parts(*p)} end" for o, (_, p) in zip(ok, checks))
    cond = f" and ({when})" if when else ""
    return (
        f"select nro_incidencia, {msg} as mensaje, '{code}' as objetivo, tipo_reporte as \"TIPO REPORTE\", "
        f"{seq} as seq, \"row\" from {source} where not ({' and '.join(ok)}){cond}"
    )


def rule_sql(code: str, **options) -> str:
    return f"{base(**options)}\n{rule_select(code)}"


def grouped_sql(codes: list[str], **options) -> str:
    union = "\nunion all\n".join(rule_select(c) for c in codes)
    return f"""{base(**options)},
f as ({union})
select nro_incidencia, string_agg(mensaje, ' | ' order by seq, "row", mensaje) as mensaje,
  string_agg(objetivo, ' | ' order by seq, "row", mensaje) as objetivo, min("TIPO REPORTE") as "TIPO REPORTE"
from f where nro_incidencia is not null and nro_incidencia <> '' group by nro_incidencia"""
