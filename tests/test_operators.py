"""Joins, duplicates, scans, rules, findings, sections, rosters, batches."""

import pytest
from pyspark.sql import functions as F

from cotejo.operators import batches, dedupe, findings, joins, rosters, scans, sections
from cotejo.operators.rules import Check, Rule, evaluate, flag
from cotejo.sources import landed


def rows(df, *names):
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_matched_and_anti_joins(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z"), (None, "n")], "k string, v string")
    b = spark.createDataFrame([("1", "p"), ("1", "q"), ("3", "r"), (None, "m")], "k string, v string")
    m = joins.matched(a, b, ["k"], ("_a", "_b"))
    assert m.columns == ["k", "v_a", "v_b"] and m.count() == 4  # repeated keys fan out
    assert rows(joins.only_left(a, b, ["k"])) == [("2", "z"), (None, "n")]
    assert rows(joins.only_right(a, b, ["k"])) == [("3", "r"), (None, "m")]
    e = joins.enrich(a, b, ["k"], {"v_right": "no"})
    assert rows(e.where("k = '2' or k is null"), "v_right") == [("no",), ("no",)]


def test_required_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    ok = df.distinct()
    with pytest.raises(Exception, match="one: more than one row for k=2"):
        joins.join_on_spine({"one": df, "two": ok.withColumnRenamed("v", "w")}, ["k"]).collect()
    last = joins.join_on_spine({"two": ok.withColumnRenamed("v", "w"), "one": df}, ["k"])
    assert last.count() == 3  # the last source may repeat


def test_missing_keys_meet_on_the_spine(spark):
    frames = {n: spark.createDataFrame([("u", None, i), (None, 1, i + 10)], f"k string, d int, {n} int") for i, n in enumerate("abc")}
    got = rows(joins.join_on_spine(frames, ["k", "d"]))
    assert got == sorted([("u", None, 0, 1, 2), (None, 1, 10, 11, 12)], key=repr)


def test_duplicates_with_missing_and_hot_keys(spark):
    data = [("a", 1, 5), ("a", 1, 3), (None, 2, 9), (None, 2, 1), ("b", 1, 4)] + [("hot", 0, 1000 - i) for i in range(500)]
    df = spark.createDataFrame(data, "u string, d int, o int")
    first, several = dedupe.split_duplicates(df, ["u", "d"], ["o"])
    assert rows(first) == sorted([("a", 1, 3), (None, 2, 1), ("b", 1, 4), ("hot", 0, 501)], key=repr)
    assert several.count() == 504 and several.columns == df.columns


def test_numbering_and_footers(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(100)], "line_no int")
    got = scans.number_rows(df, "line_no", "n", slice_rows=50)
    assert rows(got, "line_no", "n") == sorted(((i * 7, i) for i in range(100)), key=repr)
    assert scans.drop_last_rows(df, "line_no", 3).agg(F.max("line_no")).first()[0] == 96 * 7
    assert scans.drop_last_rows(df, "line_no", 0) is df
    tied = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, "d"), (None, "e")], "line_no int, v string")
    assert rows(scans.drop_last_rows(tied, "line_no", 1, ["v"])) == sorted([(1, "a"), (2, "b"), (2, "c"), (None, "e")], key=repr)
    assert rows(scans.drop_last_rows(tied, "line_no", 3)) == sorted([(1, "a"), (None, "e")], key=repr)
    with pytest.raises(Exception, match="at the edge"):
        scans.drop_last_rows(tied, "line_no", 1).collect()
    far = spark.createDataFrame([(x,) for x in (-(2**62), -5, 0, 7, 10**6, 10**12, 2**62)], "line_no bigint")
    assert [r["n"] for r in scans.number_rows(far, "line_no", "n", slice_rows=3).orderBy("line_no").collect()] == list(range(7))
    assert scans.skip_first_rows(df, "line_no", 7).count() == 98


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_carry_forward_over_slices(spark, width):
    marks = {0: {3: "a", 9: "b"}, 1: {}, 2: {1: "c"}}
    data = [(d, i, marks[d].get(i)) for d in marks for i in range(1, 15)]
    df = spark.createDataFrame(data, "doc int, line int, mark string")
    got = scans.carry_forward(df, ["doc"], "line", F.col("mark"), "out", width)

    def want(d, i):
        seen = [m for k, m in sorted(marks[d].items()) if k <= i]
        return seen[-1] if seen else None

    assert {(r["doc"], r["line"]): r["out"] for r in got.collect()} == {(d, i): want(d, i) for d, i, _ in data}


def test_batches(spark):
    df = spark.createDataFrame([(" t%d" % (i % 25), i) for i in range(100)], "ticket string, place int")
    out = batches.key_batches(df, "ticket", "place", size=10, slice_rows=4)
    assert rows(out, "position", "batch", "ticket")[:2] == [(0, 0, "t0"), (1, 0, "t1")]
    req = batches.batch_requests(out, "ticket").orderBy("batch").collect()
    assert [r["n_keys"] for r in req] == [10, 10, 5]
    assert req[2]["request"] == "t20\nt21\nt22\nt23\nt24"


def test_rules_in_one_pass(spark):
    df = spark.createDataFrame([("1", "A", 5, None, 2), ("2", None, None, 3, 1), ("3", "B", 3, 3, 0)],
                               "nro_incidencia string, tipo_reporte string, x int, y int, place int")
    rules = [
        Rule("r.1", 1, [Check("eq", F.col("x") == F.col("y"), F.concat(F.lit("x="), F.coalesce(F.col("x").cast("string"), F.lit("nan"))))]),
        Rule("r.2", 2, [Check("pos", F.col("x") > 4, F.lit("low")), Check("low", F.col("y") > 9, F.lit(" y"))], when=F.col("tipo_reporte") == "A"),
    ]
    long = evaluate(df, rules, row=F.col("place"))
    assert rows(long, "nro_incidencia", "objetivo", "mensaje") == [("1", "r.1", "x=5"), ("1", "r.2", " y"), ("2", "r.1", "x=nan")]
    flagged = flag(df, rules[1]).orderBy("nro_incidencia").collect()
    assert [r["validation_ok"] for r in flagged] == [False, True, True]
    assert [r["fail_count"] for r in flagged] == [1, 2, 2]


def test_findings_by_ticket_order_and_type(spark):
    schema = "nro_incidencia string, mensaje string, objetivo string, `TIPO REPORTE` string, seq int, row bigint"
    data = [("t", "b", "2", "K", 2, 1), ("t", "a2", "1", None, 1, 7), ("t", "a1", "1", None, 1, 3), ("", "x", "1", "K", 1, 1), (None, "x", "1", "K", 1, 1)]
    got = findings.by_ticket(spark.createDataFrame(data, schema)).collect()
    assert [tuple(r) for r in got] == [("t", "a1 | a2 | b", "1 | 1 | 2", "K")]
    empty = findings.observation_count(spark.createDataFrame([], schema)).first()
    assert tuple(empty) == (0, False)


def test_union_fills_missing_text(spark):
    a = spark.createDataFrame([("1", None)], "k string, v string")
    b = spark.createDataFrame([("2",)], "k string")
    assert rows(findings.union_all([a, b])) == [("1", ""), ("2", "")]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [1]), (3, "a", [2])], "i int, s string, l array<int>")
    got = {r["column_name"]: tuple(r)[1:] for r in findings.profile(df).collect()}
    assert got == {"i": ("int", 3, 0, 0.0, 3), "s": ("string", 2, 1, 33.33, 1), "l": ("array<int>", 3, 0, 0.0, 2)}


REPORT = """intro
reporte tecnico nº 77
CUISMP
:
123. sede
Tipo Caso: X  caso
Observación: todo  bien
OBSERVACION: otra
Determinacion de la causa

corte de fibra
MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS
uno
Fecha y Hora de Inicio: 1/2/2024 a las 7:05 horas.
dos
Hora Fin: 2/2/2024 8:05
Hora Fin: 3/2/2024 9:05
Medidas correctivas y/o preventivas tomadas otra vez
Detalle de solicitudes
tres
Fecha y Hora Fin 9/9/2024 9:09
REPORTE TÉCNICO Nº 78
Tipo Caso:
REPORTE TÉCNICO Nº 79
nada"""


@pytest.mark.parametrize("width", [2, 7, 1000])
def test_technical_reports(spark, width):
    docs = spark.createDataFrame([(1, REPORT), (2, "sin reportes\nCUISMP: 5")], "doc_id int, text string")
    got = sections.technical_reports(sections.document_lines(docs), width).orderBy("section").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("77", "123", "X  caso", "todo  bien", "corte de fibra",
         "uno dos Medidas correctivas y/o preventivas tomadas otra vez", "1/2/2024 7:05", "3/2/2024 9:05"),
        ("78", "", "", "", "", "", "", ""),
        ("79", "", "", "", "", "", "", ""),
    ]


ANNEX = """Se tuvo indisponibilidad por parte del cliente antes
ANEXO 1 – TICKET 11
Se tuvo indisponibilidad por parte del cliente a
1/2/2024 7:05:00 hasta el día 2/2/2024 8:05:00
Se tuvo indisponibilidad por parte del cliente b
(Total de horas sin acceso a la sede: 9:30 horas)
3/2/2024 7:05:00 hasta el día 4/2/2024 8:05:00
(Total de horas sin acceso a la sede: 1:00 horas)
anexo 2 – ticket 12
nada
EVIDENCIA RESPONSABILIDAD DE TERCEROS
ANEXO 3 – TICKET 13"""


@pytest.mark.parametrize("width", [2, 1000])
def test_outage_annexes(spark, width):
    docs = spark.createDataFrame([(1, ANNEX), (2, "nada")], "doc_id int, text string")
    got = sections.outage_annexes(sections.document_lines(docs), width).orderBy("section").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("11", "Se tuvo indisponibilidad por parte del cliente b", "01/2/2024 07:05:00 hasta el día 02/2/2024 08:05:00",
         "(Total de horas sin acceso a la sede: 9:30 horas)", "09:30"),
        ("12", "", "", "", ""),
    ]


def cells(spark, grid, sheet="s"):
    data = [(sheet, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None]
    return spark.createDataFrame(data, "sheet string, row bigint, col int, value string")


def test_desk_roster_grid(spark):
    grid = [
        ["MESA", None, None, "Lunes 6/1/2025", None, "Martes 07/01/2025"],
        ["x", None, None, "a", None, "b"],
        ["José Peña", None, None, "08:00 - 17:00", None, "DESCANSO"],
        [None, None, None, "09:00 - 18:00", None, "c"],
        ["Ana", None, None, None, None, "10:00 a 12:00"],
    ]
    got = rosters.roster_rows(rosters.unpivot(cells(spark, grid), **rosters.DESK, body=rosters.DESK_BODY_ROW))
    assert [(str(d), u, s) for d, u, s in rows(got, "date", "user", "shift_start")] == [
        ("2025-01-06", "JOSE PENA", "08:00"),
        ("2025-01-07", "ANA", "10:00 a 12:00"),
        ("2025-01-07", "JOSE PENA", "DESCANSO"),
    ]


def test_general_roster_body_and_exclusions(spark):
    grid = [
        [None, None, "Lunes 06/01/2025", None, None, "Martes 07/01/2025"],
        ["t", None, None, None, None, None],
        ["t", "cabecera", "08:00", None, None, "08:00"],
        [None, "cabecera", "08:00", None, None, "08:00"],
        [None, "tarde", "08:00", None, None, "08:00"],
        [None, "Ana", "08:00 - 9", None, None, None],
        [None, "Turno", "08:00", None, None, "08:00"],
    ]
    full = cells(spark, grid)
    assert rows(rosters.body_start(full)) == [("s", 5)]
    no_gap = cells(spark, [["a", "Ana", "x"], ["b", "Eva", "y"]], "n")
    assert rows(rosters.body_start(no_gap)) == [("n", 0)]
    got = rosters.unpivot(full, **rosters.GENERAL, body=rosters.body_start(full), exclude=rosters.LABEL_ROWS)
    assert rows(got, "name", "day", "shift") == [("Ana", 0, "08:00 - 9")]


def test_word_tables_pad_short_rows(spark):
    grid = [(1, t, r, c, v) for t, r, vals in [
        (4, 0, [" A ", "B"]), (4, 1, ["1", "2"]), (4, 2, ["3"]), (5, 0, ["A"]), (5, 1, ["9"]), (3, 0, ["A"]), (3, 1, ["0"]),
    ] for c, v in enumerate(vals)]
    df = spark.createDataFrame(grid, "doc_id int, table_no int, row bigint, col int, text string")
    got = landed.fault_tables(df, ["A", "B"])
    assert rows(got, "A", "B", "responsable") == [("1", "2", "CLARO"), ("3", "", "CLARO"), ("9", None, "CLIENTE")]


def test_presence_rows(spark):
    td = lambda *v: "<tr>" + "".join(f"<td>{x}</td>" for x in v) + "</tr>"
    html = td(1, 2, 3, "Ana", " ", "m", "d", "h") + td(1, 2, 3, "", "&nbsp;", " ", "", "", "x") + td(1, 2) + "<tr></tr>"
    got = landed.presence_table(spark.createDataFrame([(1, html)], "page_no int, html string"))
    assert rows(got, *landed.PRESENCE_COLUMNS) == [("Ana", "-", "m", "d", "h")]


def test_table_rows_of_nested_open_and_encoded_markup(spark):
    pages = [
        (1, "<table><thead><tr><td>head</td></tr></thead><tbody><tr><td>&#225;&eacute;&amp;lt;</td><td> a<br>b </td></tr>"
            "<tr><td>x<table><tbody><tr><td>in</td></tr></tbody></table>y</td><td>z</td></tr></tbody><tbody><tr><td>other</td></tr></tbody></table>"),
        (2, "<table><tr><td>1<td>2<tr><td>3</table><script>'<td>'</script>"),
        (3, None), (4, ""), (5, "<tbody><tr><td>a <!-- <td> --> < 5</td><td></td>"),
    ]
    got = landed.table_rows(spark.createDataFrame(pages, "page int, html string"), "page", "html")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, ["áé&lt;", "ab"]), (1, 2, ["xiny", "in", "z"]), (1, 3, ["in"]), (2, 0, ["1", "2"]), (2, 1, ["3"]), (5, 0, ["a  < 5", ""]),
    ]


def test_mail_flags(spark):
    mail = spark.createDataFrame([(None, "s", "TICKET\xa0 5"), ("a", None, "tickets"), ("b", "t", None)], "sender string, subject string, body string")
    got = landed.mail_table(mail.withColumn("received", F.expr("timestamp_ntz '2024-01-02 03:04:05'")))
    assert rows(got, "Remitente", "Asunto", "Ticket", "Fecha", "Hora")[0][:3] == ("Sin remitente", "s", "ok")
    assert [r[2] for r in rows(got, "Remitente", "Asunto", "Ticket")] == ["ok", "No encontrado", "No encontrado"]


def exchanges(df):
    """Hash exchanges, reused ones apart, and scans of the plan that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in x and "Reused" not in x for x in plan.splitlines()), sum("Scan ExistingRDD" in x or "FileScan" in x for x in plan.splitlines())


def test_mark_join_tells_own_and_paired_rows(spark):
    cut = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "z"), (None, "n")], "k string, v string")
    words = spark.createDataFrame([("1", "p", 3), ("1", "q", 4), ("3", "r", 5)], "k string, w string, n int")
    marks = {"most": F.max("n"), "has_q": F.max(F.col("w") == "q")}
    got = joins.mark_join(cut, words, ["k"], marks)
    own, paired = got.where(~F.col(joins.PAIRED)), got.where(joins.PAIRED)
    assert rows(own, "k", "v", "most", "has_q", "w") == sorted(
        [("1", "x", 4, True, None), ("1", "y", 4, True, None), ("2", "z", None, None, None), (None, "n", None, None, None)], key=repr
    )
    assert rows(paired, "k", "v", "w") == rows(joins.matched(cut, words, ["k"]), "k", "v", "w")
    assert joins.mark_join(cut, words.limit(0), ["k"], marks).count() == 4
    assert joins.mark_join(cut.limit(0), words, ["k"], marks).count() == 0


def test_cardinality_and_unique_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 1)], "k string, n int")
    assert tuple(joins.cardinality(df, ["k"]).first()) == (5, 3, 2, 2)
    assert tuple(joins.cardinality(df.limit(0), ["k"]).first()) == (0, 0, 0, 0)
    assert tuple(joins.cardinality(df, ["k", "n"]).first()) == (5, 4, 1, 2)
    assert rows(joins.unique(df.where("k is not null"), ["k", "n"], "df")) == [("a", 1), ("a", 2), ("b", 1)]
    with pytest.raises(Exception, match="df: more than one row for k=a"):
        joins.unique(df.where("k = 'a'"), ["k"], "df").collect()
    with pytest.raises(Exception, match="df: more than one row for k=null, n=1"):
        joins.unique(df, ["k", "n"], "df").collect()


def test_unique_shares_the_shuffle_of_its_join(spark):
    left = spark.range(2000).select(F.col("id").cast("string").alias("k"), "id")
    right = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("w"))
    merge = lambda df: left.hint("merge").join(df.hint("merge"), "k", "left")
    plain, checked = merge(right), merge(joins.unique(right, ["k"], "right"))
    assert rows(plain) == rows(checked)
    assert exchanges(checked)[0] == exchanges(plain)[0]


def test_reports_take_four_exchanges(spark):
    docs = spark.createDataFrame([(i, REPORT) for i in range(50)], "doc_id int, text string")
    out = sections.technical_reports(sections.document_lines(docs), 7)
    assert exchanges(out)[0] <= 4
    assert out.count() == 150


def test_sections_of_many_slices_equal_one_slice(spark):
    import random

    rnd = random.Random(5)
    bits = ["REPORTE TÉCNICO Nº {i}", "CUISMP: {i}", "CUISMP", "{i}", "Tipo Caso", ": caso {i}", "Determinación de la causa", "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS",
            "Detalle de solicitudes", "Solicitudes", "Hora Inicio 1/2/2024 {i}:10", "Fecha y hora fin: 2/2/2024 7:05", "Observación:", "nota {i}", "", "x"]
    docs = [(d, "\n".join(rnd.choice(bits).format(i=rnd.randrange(10)) for _ in range(rnd.choice((3, 60, 400))))) for d in range(40)]
    df = sections.document_lines(spark.createDataFrame(docs, "doc_id int, text string"))
    want = rows(sections.technical_reports(df, 10**6))
    assert len(want) > 300
    for width in (1, 3, 16):
        assert rows(sections.technical_reports(df, width)) == want


def test_layouts_of_both_rosters_at_once(spark):
    import random

    rnd = random.Random(6)

    def grid(first, stride, name_col, gap):
        out = [[f"Lunes {c}/1/2025" if c >= first and (c - first) % stride == 0 and rnd.random() < 0.9 else None for c in range(12)]]
        for r in range(1, 14):
            row = [rnd.choice(("08:00 - 17:00", "DESCANSO", None)) for _ in range(12)]
            row[name_col] = rnd.choice(("José Peña", "Ana", "Turno", None, "Eva"))
            row[0] = row[0] if name_col == 0 else (None if r >= gap and rnd.random() < 0.6 else "x")
            out.append(row)
        return out

    both = None
    for s in range(6):
        for name, (first, stride, name_col) in {"Mesa": (3, 2, 0), "General": (2, 3, 1)}.items():
            part = cells(spark, grid(first, stride, name_col, rnd.randrange(1, 15)), f"s{s}").withColumn("roster", F.lit(name))
            both = part if both is None else both.unionByName(part)
    both = both.unionByName(cells(spark, [["a"]], "short").withColumn("roster", F.lit("General"))).cache()
    desk, general = both.where("roster = 'Mesa'").drop("roster"), both.where("roster = 'General'").drop("roster")
    want = rosters.unpivot(desk, **rosters.DESK, body=rosters.DESK_BODY_ROW).withColumn("roster", F.lit("Mesa"))
    want = want.unionByName(
        rosters.unpivot(general, **rosters.GENERAL, body=rosters.body_start(general), exclude=rosters.LABEL_ROWS).withColumn("roster", F.lit("General"))
    )
    names = ("roster", "sheet", "row", "day", "label", "name", "shift")
    got = rosters.unpivot_layouts(both)
    assert rows(got, *names) == rows(want, *names) != []
    rosters.GAP_ROWS, before = 2, rosters.GAP_ROWS  # gaps across slices of rows
    try:
        assert rows(rosters.unpivot_layouts(both), *names) == rows(want, *names)
    finally:
        rosters.GAP_ROWS = before


def test_a_header_given_twice_names_its_last_column(spark):
    grid = [(1, 4, r, c, v) for r, vals in enumerate([["A", "B", " A ", "N"], ["z", "1", "a", "n"], ["y", "2"], ["x", "3", "", "m"]]) for c, v in enumerate(vals)]
    df = spark.createDataFrame(grid + [(1, 4, 1, 7, "far")], "doc_id int, table_no int, row bigint, col int, text string")
    assert rows(landed.fault_tables(df, ["A", "B"]), "row", "A", "B") == [(1, "a", "1"), (2, "", "2"), (3, "", "3")]
    assert rows(landed.undeclared_cells(df, ["A", "B"]), "row", "col", "text", "header") == sorted(
        [(1, 0, "z", "A"), (2, 0, "y", "A"), (3, 0, "x", "A"), (1, 3, "n", "N"), (3, 3, "m", "N"), (1, 7, "far", None)], key=repr
    )
