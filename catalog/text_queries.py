"""Text, time and number functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.dialect import Duck, Spark
from catalog.validator_sql import WS, body_first, body_last, closing, duration, duration_hours, hhmm, mins, pad_dt, strip, whole
from cotejo.functions import numbers as n
from cotejo.functions import text as t
from cotejo.functions import textdates as td
from cotejo.functions import times as tm
from cotejo.functions.unicode import canonical, same_narrative, strip_marks
from cotejo.operators.rules import Check, Rule, flag
from cotejo.sources.contracts import Contract, conform


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# --- contracted scan -------------------------------------------------------

DIRTY_NAME = "concat('  ', c_name, {cr}, c_mktsegment, '_x000D_', {nl}, ' end ')"


def contract_scan(spark: SparkSession, sf: str) -> DataFrame:
    dirty = DIRTY_NAME.format(cr="chr(13)", nl="chr(10)")
    raw = read(spark, sf, "customer").selectExpr(
        "c_custkey as ` KEY `",
        f"{dirty} as `NAME `",
        "case when c_acctbal < 0 then null else c_mktsegment end as SEGMENT",
        "c_acctbal as BALANCE",
        "c_nationkey as UNUSED",
    )
    return conform(raw, Contract("customers", ("NAME", "SEGMENT", "KEY", "BALANCE")), keep_newlines=False, null_text="nan")


def contract_empty(spark: SparkSession, sf: str) -> DataFrame:
    """An input without a required column, on request read as an empty frame, beside one that has it."""
    wanted = Contract("customers", ("NAME", "SEGMENT"))
    whole = read(spark, sf, "customer").selectExpr("c_name as NAME", "c_mktsegment as `SEGMENT `")
    short = read(spark, sf, "customer").selectExpr("c_name as NAME")
    return conform(whole, wanted, on_error="empty").unionByName(conform(short, wanted, on_error="empty"))


CONTRACT_EMPTY_SQL = 'select trim(c_name) as "NAME", trim(c_mktsegment) as "SEGMENT" from customer'
CONTRACT_SQL = f"""select
  trim(replace(replace(replace({DIRTY_NAME.format(cr='chr(13)', nl='chr(10)')}, chr(13), ' '), '_x000D_', ''), chr(10), ''), {WS}) as "NAME",
  case when c_acctbal < 0 then 'nan' else c_mktsegment end as "SEGMENT", c_custkey as "KEY", c_acctbal as "BALANCE"
from customer"""

# --- cleaning --------------------------------------------------------------

MESSY = (
    "case c_mktsegment when 'BUILDING' then '   ' when 'FURNITURE' then null "
    "when 'HOUSEHOLD' then concat(' ', {bal}, ' ') when 'MACHINERY' then concat({key}, '.90') else concat('id ', {key}) end"
)


def cell_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    bal, key = "cast(cast(c_acctbal * 100 as bigint) as string)", "cast(c_custkey as string)"
    df = read(spark, sf, "customer").withColumn("v", F.expr(MESSY.format(bal=bal, key=key)))
    v = F.col("v")
    return df.select(
        "c_custkey",
        t.or_unknown(v).alias("known"),
        t.as_text(v).alias("as_text"),
        t.integer_part(v).alias("integer_part"),
        F.lower(F.col("c_name")).alias("lowered"),
        t.only_alphanumeric(F.concat("c_name", F.lit(" é-"), "c_mktsegment")).alias("alphanumeric"),
        n.number_or_zero(v).alias("number"),
        t.shown(v, "None").alias("shown"),
    )


def _messy_sql() -> str:
    v = MESSY.format(bal="cast(cast(trunc(c_acctbal * 100) as bigint) as varchar)", key="cast(c_custkey as varchar)")
    return f"""with c as (select *, {v} as v from customer)
select c_custkey, case when trim(v) = '' then 'No disponible' else trim(v) end as known,
  coalesce(trim(v), 'nan') as as_text, coalesce({whole('v')}, '') as integer_part, lower(c_name) as lowered,
  regexp_replace(c_name || ' é-' || c_mktsegment, '[^a-zA-Z0-9 ]', '', 'g') as alphanumeric,
  coalesce(try_cast(trim(v) as double), 0) as number, coalesce(v, 'None') as shown from c"""


def null_fill_by_type(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderstatus = 'P' then null else o_orderpriority end as priority",
        "case when o_orderstatus = 'F' then null else o_totalprice end as price",
        "case when o_orderstatus = 'O' then null else cast(o_orderdate as timestamp_ntz) end as made",
        "case when o_orderstatus = 'O' then null else o_custkey end as customer",
    )
    return n.fill_by_type(df).withColumn("customer", F.coalesce("customer", F.lit(-1)))


NULL_FILL_SQL = """select o_orderkey, case when o_orderstatus = 'P' then '' else o_orderpriority end as priority,
  case when o_orderstatus = 'F' then 0.0 else o_totalprice end as price,
  case when o_orderstatus = 'O' then null else o_orderdate end as made,
  case when o_orderstatus = 'O' then -1 else o_custkey end as customer from orders"""


def text_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Membership, ranges, prefixes, suffixes and containment over whole texts."""
    df = read(spark, sf, "documents")
    text, lang = F.col("text"), F.col("lang")
    return df.select(
        "doc_id",
        n.holds(lang.isin("en", "de")).alias("is_listed"),
        F.col("n_chars").between(100, 2000).alias("in_range"),
        (text.isNotNull() & (text != "")).alias("filled"),
        F.contains(F.lower(text), F.concat(F.lit(" "), lang, F.lit(" "))).alias("holds_lang"),
        text.rlike("^[A-Z]").alias("opens_upper"),
        F.endswith(t.strip(text), F.lit(".")).alias("ends_stop"),
        F.substring(text, 1, 37).alias("opening"),
        t.leading_token(F.col("source")).alias("source_head"),
        t.field(F.concat("source", F.lit("|"), "lang", F.lit("|x")), 1).alias("second_field"),
    )


TEXT_TESTS_SQL = f"""select doc_id, coalesce(lang in ('en', 'de'), false) as is_listed, n_chars between 100 and 2000 as in_range,
  text is not null and text <> '' as filled, strpos(lower(text), ' ' || lang || ' ') > 0 as holds_lang,
  regexp_matches(text, '^[A-Z]') as opens_upper, suffix({strip('text')}, '.') as ends_stop,
  left(text, 37) as opening, trim(split_part(source, '-', 1)) as source_head, lang as second_field from documents"""


def one_line_texts(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return df.select(
        "doc_id",
        t.one_line(F.col("text")).alias("one_line"),
        t.upper_unaccented(F.col("source")).alias("source_upper"),
    )


ONE_LINE_SQL = r"""select doc_id,
  trim(regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as one_line,
  upper(source) as source_upper from documents"""


def unaccented_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms of whole texts; compatibility forms have no SQL counterpart."""
    df = read(spark, sf, "documents")
    return df.select("doc_id", strip_marks(F.upper("text")).alias("plain"))


def canonical_texts(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    return df.select("doc_id", F.length(canonical(F.col("text"))).alias("canonical_length"), canonical(F.col("text")).alias("canonical"))


VARIANT = ("é", "e\u0301"), ("ñ", "n\u0303"), ("ä", "a\u0308"), ("fi", "\ufb01")


def canonical_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Texts against a spelling with combining marks and ligatures, which is the same, and one with another letter."""
    spelt = F.col("text")
    for letter, other in VARIANT:
        spelt = F.replace(spelt, F.lit(letter), F.lit(other))
    df = read(spark, sf, "documents").select("doc_id", "text", spelt.alias("spelt"))
    return df.select(
        "doc_id",
        (F.col("text") != F.col("spelt")).alias("spelt_otherwise"),
        same_narrative(F.col("text"), F.col("spelt")).alias("same"),
        same_narrative(F.col("text"), F.concat("spelt", F.lit(" ø"))).alias("other"),
    )


# Compatibility forms, code point by code point: an accented letter is its letter and a combining mark, other forms are plain text.
# The marks, by what they make of a letter, for the letters of the four languages, and the other forms in the queries.
MARKED = {"\u0300": "ÀÈÌÒÙàèìòù AEIOUaeiou", "\u0301": "ÁÉÍÓÚáéíóú AEIOUaeiou", "\u0302": "ÂÊÎÔÛâêîôû AEIOUaeiou", "\u0308": "ÄËÏÖÜäëïöü AEIOUaeiou", "\u0303": "ÃÑÕãñõ ANOano", "\u0327": "Çç Cc"}
PLAIN_FORMS = {"\ufb01": "fi", "\uff34": "T", "\u2460": "1", "\u00bd": "1\u20442", "\u00a0": " "}


def _canonical_sql(x: str) -> str:
    for mark, pairs in MARKED.items():
        for letter, plain in zip(*pairs.split()):
            x = f"replace({x}, '{letter}', '{plain}{mark}')"
    for form, plain in PLAIN_FORMS.items():
        x = f"replace({x}, '{form}', '{plain}')"
    return rf"trim(regexp_replace({x}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


CANONICAL_SQL = f"with c as (select doc_id, {_canonical_sql('text')} as canonical from documents) select doc_id, cast(length(canonical) as integer) as canonical_length, canonical from c"
FORMS = "concat(text, chr(160), 'o\ufb01cina \uff34 \u2460 \u00bd  Ñandú ', source)"


def canonical_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with a ligature, a full-width letter, a circled digit, a fraction and a fixed blank."""
    return read(spark, sf, "documents").select("doc_id", canonical(F.expr(FORMS)).alias("canonical"))


CANONICAL_FORMS_SQL = f"select doc_id, {_canonical_sql(FORMS)} as canonical from documents"


def _variants_sql() -> str:
    spelt = "text"
    for letter, other in VARIANT:
        spelt = f"replace({spelt}, '{letter}', '{other}')"
    return f"""with d as (select doc_id, text, {spelt} as spelt from documents)
select doc_id, text <> spelt as spelt_otherwise, {_canonical_sql('text')} = {_canonical_sql('spelt')} as same,
  {_canonical_sql('text')} = {_canonical_sql("concat(spelt, ' ø')")} as other from d"""


# --- names, shifts, labels -------------------------------------------------

NAME = (
    "case c_mktsegment when 'BUILDING' then concat(' ', n_name, '  ', c_name, ' ') when 'FURNITURE' then concat(c_mktsegment, ' ', n_name, ' ', c_name) "
    "when 'HOUSEHOLD' then concat('José', ' ', n_name, ' Núñez  ', c_name) when 'MACHINERY' then concat('A B ', n_name, ' C ', c_name) else c_name end"
)
SHIFT = "case when c_acctbal < 0 then 'DESCANSO' when c_acctbal < 5000 then ' 08:30 - 17:30' else '22:00 a 06:00 - noche' end"
DAY_LABEL = "concat('Lunes ', {day}, ' turno')"


def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation")
    df = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.withColumns({"name": F.expr(NAME), "shift": F.expr(SHIFT)})
    return df.select(
        "c_custkey",
        t.short_name(F.col("name")).alias("short_name"),
        t.surname_first(F.col("name")).alias("surname_first"),
        t.upper_unaccented(F.col("name")).alias("upper_plain"),
        strip_marks(F.upper("name")).alias("upper_no_marks"),
        t.shift_start(F.col("shift")).alias("shift_start"),
        t.replace_values(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}).alias("replaced"),
        t.label_if_contains(F.col("name"), "NATION_1").alias("labelled"),
    )


NAME_SQL = f"""with c as (select *, {NAME} as name, {SHIFT} as shift from customer join nation on c_nationkey = n_nationkey),
w as (select *, regexp_split_to_array(trim(name), '\\s+') as w from c)
select c_custkey,
  case len(w) when 4 then w[1] || ' ' || w[3] when 3 then w[1] || ' ' || w[2] else trim(name) end as short_name,
  case when len(w) >= 3 then array_to_string(w[len(w) - 1 : len(w)], ' ') || ' ' || array_to_string(w[1 : len(w) - 2], ' ') else name end as surname_first,
  strip_accents(upper(name)) as upper_plain, strip_accents(upper(name)) as upper_no_marks,
  case when strpos(shift, ':') > 0 then trim(split_part(shift, ' - ', 1)) else shift end as shift_start,
  case c_mktsegment when 'BUILDING' then 'B' when 'MACHINERY' then 'M' else c_mktsegment end as replaced,
  case when strpos(name, 'NATION_1') > 0 then 'NATION_1' else name end as labelled from w"""

# --- narratives ------------------------------------------------------------

TRAILING = "concat(text, {nl}, 'Fecha y hora de inicio: 1/02/2024 7:30', {nl}, '  fecha y hora fin 03/02/2024 17:05 ')"


def narrative_split(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents")
    parts = t.split_narrative(F.col("text"), "the ")
    return df.select("doc_id", parts["before"].alias("before"), parts["after"].alias("after"))


NARRATIVE_SPLIT_SQL = """with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
p as (select *, list_position(list_transform(ls, lambda x: strpos(lower(x), 'the ') > 0), true) as k from l)
select doc_id, case when k > 0 then array_to_string(ls[1 : k - 1], chr(10)) else text end as before,
  case when k > 0 then array_to_string(ls[k : len(ls)], chr(10)) else '' end as after from p"""


def narrative_trim(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents").withColumn("v", F.expr(TRAILING.format(nl="chr(10)")))
    return df.select("doc_id", t.drop_trailing_date_lines(F.col("v")).alias("trimmed"))


NARRATIVE_TRIM_SQL = "select doc_id, text as trimmed from documents"

PHRASES = (
    "concat(text, case lang when 'en' then ' A través' when 'fr' then ' A  través del cliente /debido, A través' "
    "when 'de' then ' CLIENTE/ Debido a través' else ' Inmediatamente, claro revisó e inmediatamente, Claro revisó' end)"
)


def phrase_count(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents").withColumn("v", F.expr(PHRASES))
    v = F.col("v")
    return df.select(
        "doc_id",
        t.phrase_count(v).alias("phrases"),
        t.repeats_phrase(v).alias("repeats"),
        t.has_slash_typo(v).alias("slash_typo"),
        t.has_repetition(v).alias("repetition"),
    )


PHRASE_SQL = f"""with d as (select doc_id, {PHRASES} as v from documents)
select doc_id, cast(len(regexp_extract_all(v, 'A\\s+través')) as integer) as phrases, len(regexp_extract_all(v, 'A\\s+través')) > 1 as repeats,
  regexp_matches(v, '(?i)cliente\\s*/\\s*debido') as slash_typo,
  regexp_matches(v, '(?i)\\bInmediatamente, claro revisó.*\\bInmediatamente, claro revisó') or regexp_matches(v, '\\bA través\\b.*\\bA través\\b') as repetition from d"""

# --- dates inside text -----------------------------------------------------

DATED = (
    "concat(case when lang = 'en' then 'Desde 05/02/2024 a las 7:30, ' else '' end, text, "
    "case when lang in ('en', 'fr') then ' corte 06/02/2024 18:45 y ' else ' corte 6/2/24 ' end, text, "
    "case when lang = 'de' then ' fin 07/02/2024 9:15' else '' end, {nl}, 'Fecha y hora de inicio: 01/01/2020 0:00', {nl}, ' ')"
)


def text_date_body(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents").withColumn("v", F.expr(DATED.format(nl="chr(10)")))
    body, loose = td.body_range(F.col("v")), td.body_range_loose(F.col("v"))
    return df.select(
        "doc_id",
        body["first"].alias("first"),
        body["last"].alias("last"),
        loose["first"].alias("loose_first"),
        loose["last"].alias("loose_last"),
    )


def _dated_sql() -> str:
    # The appended start line and blank line are the trailing part to ignore.
    v = DATED.format(nl="chr(10)")
    cut = "left(v, length(v) - 41)"
    pair = r"(\d{2}/\d{2}/\d{4})\D{0,10}(\d{1,2}:\d{2})"

    def paired(take: str, side: str, i: int) -> str:
        # A loose pair stands where its time stands.
        at = f"length(regexp_extract(v, '(?s)^(.{take}\\d{{2}}/\\d{{2}}/\\d{{4}}\\D{{0,10}})\\d{{1,2}}:\\d{{2}}', 1))"
        hit = f"regexp_extract_all(v, '{pair}')[{i}]"
        value = f"regexp_extract({hit}, '{pair}', 1) || ' ' || lpad(regexp_extract({hit}, '{pair}', 2), 5, '0')"
        return f"case when regexp_matches(v, '{pair}') and {at} * 2 {side} length(v) then {value} else 'No disponible' end"

    return f"""with d as (select doc_id, lang, {v} as v from documents),
b as (select doc_id, lang, {cut} as v from d)
select doc_id, {body_first('v')} as first, {body_last('v')} as last,
  {paired('*?', '<', 1)} as loose_first, {paired('*', '>=', -1)} as loose_last from b"""


CLOSED = (
    "concat('Del 01/03/2024 10:00 al ', {start}, ' hrs', {nl}, 'Hora fin ', {end}, {nl}, "
    "case when l_returnflag = 'R' then concat('Cierre ', {start}, ' y reapertura', {nl}, ' sin fecha') else 'sin cierre' end)"
)


def text_date_last(spark: SparkSession, sf: str) -> DataFrame:
    d = Spark
    ship = d.plus_seconds(d.ntz("l_shipdate"), "l_partkey * 60")
    made = CLOSED.format(start=d.loose_minute_text(ship), end=d.minute_text(d.ntz("l_shipdate")), nl="chr(10)")
    df = read(spark, sf, "lineitem").withColumn("v", F.expr(made))
    padded, raw, ls = td.closing_range(F.col("v")), td.closing_range(F.col("v"), False), td.closing_lines_range(F.col("v"))
    return df.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        padded["first"].alias("first"),
        padded["last"].alias("last"),
        raw["first"].alias("raw_first"),
        ls["first"].alias("line_first"),
        ls["last"].alias("line_last"),
    )


def _closed_sql() -> str:
    d = Duck
    ship = d.plus_seconds(d.ntz("l_shipdate"), "l_partkey * 60")
    made = CLOSED.format(start=d.loose_minute_text(ship), end=d.minute_text(d.ntz("l_shipdate")), nl="chr(10)")
    pair = r"(\d{2}/\d{2}/\d{4})\D{0,10}(\d{1,2}:\d{2})"
    at = lambda i: f"regexp_extract(hits[{i}], '{pair}', 1) || ' ' || lpad(regexp_extract(hits[{i}], '{pair}', 2), 5, '0')"
    return f"""with d as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, {made} as v from lineitem),
h as (select *, list_filter(string_split(v, chr(10)), lambda x: regexp_matches(x, '{pair}')) as hits from d)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, {closing('v', -2)} as first, {closing('v', -1)} as last,
  {closing('v', -2, False)} as raw_first, {at(-2)} as line_first, {at(-1)} as line_last from h"""


BLOCK = (
    "concat('Nota', {nl}, ' Se tuvo indisponibilidad por parte del cliente para continuar los trabajos el/los día(s) ', "
    "case when l_linestatus = 'F' then 'martes' else '' end, {nl}, {a}, ' hasta el día ', {b}, {nl}, "
    "case when l_returnflag = 'A' then concat({b}, '  hasta el día ', {a}, ' aprox', {nl}) else '' end, "
    "'(Total de horas sin acceso a la sede: ', {h}, ':05 horas)', {nl}, {nl})"
)


def _block(d) -> str:
    ship = d.ntz("l_shipdate")
    return BLOCK.format(
        a=d.loose_text(d.plus_seconds(ship, "l_partkey * 61")),
        b=d.loose_text(d.plus_seconds(ship, "l_suppkey * 7001")),
        h=d.text("l_linenumber * 3"),
        nl="chr(10)",
    )


def block_split(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "lineitem").withColumn("v", F.expr(_block(Spark)))
    loose, strict = td.outage_block(F.col("v")), td.outage_block_strict(F.col("v"))
    return df.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        *[loose[p].alias(p) for p in ("header", "periods", "total")],
        *[strict[p].alias(f"strict_{p}") for p in ("header", "periods", "total")],
    )


# Connecting words in capitals, before a day of one digit.
BLOCK_CAPITALS = "replace(replace({block}, ' hasta el día ', ' HASTA EL DÍA '), '  hasta', ' Hasta')"


def _block_capitals(d) -> str:
    return f"case when l_linenumber % 2 = 1 then {BLOCK_CAPITALS.format(block=_block(d))} else {_block(d)} end"


def block_capitals(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks whose periods are connected in capitals, after which a day is not padded by the loose form."""
    df = read(spark, sf, "lineitem").withColumn("v", F.expr(_block_capitals(Spark)))
    loose, strict = td.outage_block(F.col("v")), td.outage_block_strict(F.col("v"))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", loose["periods"].alias("periods"), strict["periods"].alias("strict_periods"))


def _block_sql(made: str | None = None) -> str:
    made = _block(Duck) if made is None else made
    head = r"(?i)^Se tuvo indisponibilidad por parte del cliente"
    full = r"(?i)^Se tuvo indisponibilidad por parte del cliente para continuar los trabajos el/los día\(s\)"
    period = r"(?i)^\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}.*hasta el día\s+\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}.*$"
    strict = r"(?i)^(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})\s+hasta el día\s+(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})"
    total = r"(?i)^\(Total de horas sin acceso a la sede:\s*(\d{1,3}:\d{2})\s*horas\)"
    total2 = r"(?i)\(Total de horas sin acceso a la sede:\s*(\d{1,2}:\d{2})\s*horas\)"
    pick = lambda p: f"list_filter(ls, lambda x: regexp_matches(x, '{p}'))"
    pad = lambda x: (
        f"regexp_replace(regexp_replace(regexp_replace({x}, '^(\\d)/', '0\\1/'), '(hasta el día\\s)(\\d)/', '\\g<1>0\\2/'), '\\b(\\d)(:\\d{{2}})', '0\\1\\2', 'g')"
    ).replace("\\g<1>0\\2/", "\\10\\2/")
    two = lambda x: f"regexp_replace({x}, '\\b(\\d)(:\\d{{2}})', '0\\1\\2', 'g')"
    g = lambda i: pad_dt(f"regexp_extract(x, '{strict}', {i})")
    return f"""with d as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, {made} as v from lineitem),
b as (select *, list_filter(list_transform(string_split(v, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from d)
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  {pick(head)}[1] as header, array_to_string(list_transform({pick(period)}, lambda x: {pad('x')}), chr(10)) as periods,
  regexp_extract({two(pick(total) + '[1]')}, '{total}', 1) as total,
  {pick(full)}[-1] as strict_header,
  array_to_string(list_transform({pick(strict)}, lambda x: {g(1)} || ' hasta el día ' || {g(2)}), chr(10)) as strict_periods,
  {two(f"regexp_extract({pick(total2)}[-1], '{total2}', 1)")} as strict_total from b"""


# --- times -----------------------------------------------------------------

STAMP_TEXT = (
    "case o_orderpriority when '1-URGENT' then {full} when '2-HIGH' then {short} when '3-MEDIUM' then {iso} "
    "when '4-NOT SPECIFIED' then 'sin fecha' else {day} end"
)


def _stamp(d) -> str:
    ts = d.plus_seconds(d.ntz("o_orderdate"), "o_orderkey % 90000")
    if d is Spark:
        iso, day = f"date_format({ts}, 'yyyy-MM-dd HH:mm:ss')", f"date_format({ts}, 'd/M/yyyy')"
    else:
        iso, day = f"strftime({ts}, '%Y-%m-%d %H:%M:%S')", f"strftime({ts}, '%-d/%-m/%Y')"
    return STAMP_TEXT.format(full=d.loose_text(ts), short=d.minute_text(ts), iso=iso, day=day)


def date_parsing(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "orders").withColumn("v", F.expr(_stamp(Spark)))
    v = F.col("v")
    parsed = tm.parse(v)
    return df.select(
        "o_orderkey",
        parsed.alias("parsed"),
        tm.parse(v, "d/M/yyyy H:mm").alias("fixed"),
        tm.floor_minute(parsed).alias("minute"),
        tm.minute_text(parsed).alias("minute_text"),
        F.date_format(F.to_date(parsed), "yyyy-MM-dd").alias("day"),
        tm.clock(parsed).alias("clock"),
        tm.date_in_label(F.concat(F.lit("Turno "), v, F.lit(" mesa"))).cast("string").alias("label_date"),
        tm.parse_strict(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"), "dd/MM/yyyy HH:mm:ss").alias("strict"),
    )


def _date_sql() -> str:
    parsed = "try_strptime(v, ['%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y', '%Y-%m-%d %H:%M:%S'])"
    label = "try_strptime(nullif(regexp_extract(v, '\\d{1,2}/\\d{1,2}/\\d{4}'), ''), '%d/%m/%Y')"
    return f"""with o as (select o_orderkey, o_orderdate, {_stamp(Duck)} as v from orders), p as (select *, {parsed} as p from o)
select o_orderkey, p as parsed, try_strptime(v, '%d/%m/%Y %H:%M') as fixed, date_trunc('minute', p) as minute,
  coalesce(strftime(p, '%d/%m/%Y %H:%M'), 'N/A') as minute_text, strftime(p, '%Y-%m-%d') as day, strftime(p, '%H:%M:%S') as clock,
  strftime({label}, '%Y-%m-%d') as label_date, o_orderdate as strict from p"""


def expected_start(spark: SparkSession, sf: str) -> DataFrame:
    made = F.col("o_orderdate").cast("timestamp_ntz")
    ship = F.col("l_shipdate").cast("timestamp_ntz")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag")
    df = lines.join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ended = F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(cast(l_suppkey % 40 as int), 0, 0, 31.5)")
    start = tm.expected_start(F.col("l_returnflag") == "A", ship, made, tm.floor_minute(ended))
    span = tm.seconds_between(start, tm.floor_minute(ended))
    return df.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", start.alias("expected"), span.alias("seconds"), tm.hhmm(span).alias("span")
    )


EXPECTED_SQL = f"""with j as (select l.*, o_orderdate, o_orderdate + to_days(cast(l_suppkey % 40 as integer)) as ended
  from lineitem l join orders on l_orderkey = o_orderkey),
e as (select *, case when l_returnflag = 'A' and ended >= l_shipdate then l_shipdate else o_orderdate end as expected from j),
s as (select *, (epoch_us(ended) - epoch_us(expected)) // 1000000 as seconds from e)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, expected, seconds, {hhmm('seconds')} as span from s"""

DURATION = (
    "case when l_returnflag = 'R' then concat({q}, ' days, ', {t}, ':30') when l_linestatus = 'F' then concat('1 day, ', {t}) "
    "when l_linenumber = 1 then concat(' ', {q}, '0:07. ') when l_linenumber = 2 then concat({t}, ':00') when l_linenumber = 3 then 'garbage 7' else null end"
)


def _duration(d) -> str:
    return DURATION.format(q=d.text("cast(l_quantity as bigint)"), t=d.hhmm("(l_partkey * 17 % 1440)"))


def duration_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "lineitem").withColumn("v", F.expr(_duration(Spark)))
    v = F.col("v")
    return df.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        tm.duration_hhmm(v).alias("hhmm"),
        tm.minutes_of(tm.duration_hhmm(v)).alias("minutes"),
        F.coalesce(tm.duration_hours(v), F.lit(0)).alias("hours"),
        tm.drop_zero_seconds(v).alias("short"),
        tm.minutes_of(v).alias("plain_minutes"),
    )


def _duration_sql() -> str:
    return f"""with d as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, {_duration(Duck)} as v from lineitem),
h as (select *, {duration('v')} as hhmm from d)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, hhmm, {mins('hhmm')} as minutes, coalesce({duration_hours('v')}, 0) as hours,
  case when suffix(v, ':00') then left(v, 5) else v end as short, {mins('v')} as plain_minutes from h"""


# --- numbers and checks ----------------------------------------------------


def hour_bands(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "lineitem")
    hours = F.col("l_quantity") - 5
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", n.hour_band(hours).alias("band"))


BANDS_SQL = """select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_quantity - 5 = 0 then 'Menor a 1h'
  when l_quantity - 5 in (1, 2, 3) then 'Entre 1h a 4h' when l_quantity - 5 in (4, 5, 6, 7) then 'Entre 4h a 8h'
  when l_quantity - 5 between 8 and 23 then 'Entre 8h a 24h' else 'Mayor a 24h' end as band from lineitem"""


def check_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags, fail count and outcome of a rule over missing values as well."""
    df = read(spark, sf, "lineitem").withColumn(
        "stated", F.when(F.col("l_returnflag") != "N", F.col("l_quantity") + F.col("l_linenumber") - 3)
    )
    rule = Rule(
        "x",
        1,
        [
            Check("close", n.within(F.col("stated"), F.col("l_quantity"), 1), F.lit("far")),
            Check("not_negative", n.not_negative(F.col("stated")), F.lit("negative")),
            Check("is_same", n.same(F.col("stated"), F.col("l_quantity")), F.lit("other")),
        ],
        when=F.col("l_linestatus") == "F",
    )
    return flag(df, rule).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "close", "not_negative", "is_same", "validation_ok", "fail_count"
    )


CHECK_SQL = """with l as (select *, case when l_returnflag <> 'N' then l_quantity + l_linenumber - 3 end as stated from lineitem),
f as (select *, coalesce(abs(stated - l_quantity) <= 1, false) as close, coalesce(stated >= 0, false) as not_negative,
  coalesce(stated = l_quantity, false) as is_same from l)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, close, not_negative, is_same,
  l_linestatus <> 'F' or (close and not_negative and is_same) as validation_ok,
  cast((not close)::int + (not not_negative)::int + (not is_same)::int as integer) as fail_count from f"""

QUERIES = {
    "contract_scan": contract_scan,
    "contract_empty": contract_empty,
    "cell_cleaning": cell_cleaning,
    "null_fill_by_type": null_fill_by_type,
    "text_tests": text_tests,
    "one_line_texts": one_line_texts,
    "unaccented_texts": unaccented_texts,
    "canonical_texts": canonical_texts,
    "canonical_variants": canonical_variants,
    "canonical_forms": canonical_forms,
    "name_forms": name_forms,
    "narrative_split": narrative_split,
    "narrative_trim": narrative_trim,
    "phrase_count": phrase_count,
    "text_date_body": text_date_body,
    "text_date_last": text_date_last,
    "block_split": block_split,
    "block_capitals": block_capitals,
    "date_parsing": date_parsing,
    "expected_start": expected_start,
    "duration_text_parse": duration_text_parse,
    "hour_bands": hour_bands,
    "check_flags": check_flags,
}

SQL = {
    "contract_scan": CONTRACT_SQL,
    "cell_cleaning": _messy_sql(),
    "null_fill_by_type": NULL_FILL_SQL,
    "text_tests": TEXT_TESTS_SQL,
    "one_line_texts": ONE_LINE_SQL,
    "contract_empty": CONTRACT_EMPTY_SQL,
    "canonical_texts": CANONICAL_SQL,
    "canonical_forms": CANONICAL_FORMS_SQL,
    "canonical_variants": _variants_sql(),
    "unaccented_texts": "select doc_id, strip_accents(upper(replace(text, 'ß', 'SS'))) as plain from documents",
    "name_forms": NAME_SQL,
    "narrative_split": NARRATIVE_SPLIT_SQL,
    "narrative_trim": NARRATIVE_TRIM_SQL,
    "phrase_count": PHRASE_SQL,
    "text_date_body": _dated_sql(),
    "text_date_last": _closed_sql(),
    "block_split": _block_sql(),
    "block_capitals": f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, periods, strict_periods from ({_block_sql(_block_capitals(Duck))})",
    "date_parsing": _date_sql(),
    "expected_start": EXPECTED_SQL,
    "duration_text_parse": _duration_sql(),
    "hour_bands": BANDS_SQL,
    "check_flags": CHECK_SQL,
}
