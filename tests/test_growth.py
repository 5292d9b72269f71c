"""What keeps memory and shuffles from growing faster than the input."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cotejo.functions import textdates as td
from cotejo.functions.unicode import canonical, strip_marks
from cotejo.operators import intervals, joins, rosters
from cotejo.operators.dedupe import duplicates
from cotejo.plans import validator as v
from cotejo.plans.inputs import prepare_cut
from cotejo.sources import landed
from cotejo.sources.contracts import OUTAGE_CUT


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_joins_are_never_broadcast_for_a_small_file(spark):
    a, b = (spark.createDataFrame([("1", i, "x"), ("2", i, "y")], f"k string, {c} int, z_{c} string") for i, c in enumerate("ab"))
    cells = spark.createDataFrame([(0, 0, 3, "Lunes 6/1/2025"), (0, 2, 0, "Ana"), (0, 2, 3, "08:00")], "sheet int, row int, col int, value string")
    marks = {"m": F.lit(True)}
    frames = [joins.matched(a, b, ["k"]), joins.only_left(a, b, ["k"]), joins.enrich(a, b, ["k"]), joins.mark_join(a, b, ["k"], marks), duplicates(a, ["k"])]
    for df in frames:
        assert "Broadcast" not in _plan(df)
    names = rosters.unpivot(cells, **rosters.DESK, body=2)
    assert "SortMergeJoin" in _plan(names)
    assert [tuple(r) for r in names.collect()] == [(0, 2, 0, "Lunes 6/1/2025", "Ana", "08:00")]


def test_no_roster_cells_are_broadcast(spark, tmp_path):
    grid = [(0, 0, "Mesa"), (0, 2, "Lunes 6/1/2025"), (0, 5, "Martes 7/1/2025"), (1, 0, "x"), (4, 1, "Ana"), (4, 2, "08:00"), (4, 5, "09:00"), (5, 1, "Turno"), (5, 2, "10:00"), (2, 1, "Eva"), (2, 2, "11:00")]
    cells = spark.createDataFrame([(s, r, c, v) for s in (0, 1, None) for r, c, v in grid] + [(2, 0, 2, "Lunes 6/1/2025"), (2, 0, 1, "Luz"), (2, 0, 5, None)], "sheet int, row int, col int, value string")
    cells.write.parquet(str(tmp_path / "cells"))  # a file whose size is known, and small
    cells = spark.read.parquet(str(tmp_path / "cells"))
    for out in (rosters.body_start(cells), rosters.unpivot(cells, **rosters.DESK, body=0), rosters.unpivot(cells, **rosters.GENERAL, body=rosters.body_start(cells), exclude=rosters.LABEL_ROWS)):
        assert "Broadcast" not in _plan(out)
    days = ((0, "Lunes 6/1/2025", "08:00"), (1, "Martes 7/1/2025", "09:00"))
    want = [(s, 4, day, label, "Ana", shift) for s in (0, 1) for day, label, shift in days] + [(2, 0, 0, "Lunes 6/1/2025", "Luz", "Lunes 6/1/2025")]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_join_beside_deals_rows_by_the_ticket_only(spark):
    left = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("1", None, 3), (None, "a", 4), ("2", "a", 5)], "k string, c string, n int")
    right = spark.createDataFrame([("1", "a", 10), ("1", "a", 11), ("1", None, 12), (None, "a", 13), ("3", "a", 14)], "k string, c string, m int")
    out = joins.enrich(left, right, ["k", "c"], dealt=["k"])
    plain = left.join(right, ["k", "c"], "left")
    assert out.columns == plain.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
    keys = [line for line in _plan(out).splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all(line.split("hashpartitioning(")[1].count("#") == 1 for line in keys)


AT = lambda h, m=0: datetime(2024, 1, 1, h, m)
STOPS = [
    ("1", AT(1), AT(2), 1), ("1", AT(2), AT(3), 2), ("1", AT(5), None, 3), ("1", AT(6), AT(6, 30), 4), ("1", AT(9), None, 5), ("1", AT(1), AT(1, 30), 6),
    ("1", AT(5), AT(5, 10), 7), ("2", AT(3), None, 1), ("2", None, AT(4), 2), ("3", AT(4), AT(4), 1), ("4", AT(1), AT(20), 1), ("4", AT(2), AT(3), 2),
    (None, AT(1), AT(2), 1), ("5", AT(1), AT(2), 1), ("5", AT(1), None, 2), ("5", AT(8), AT(9), 3),
]
BOUNDS = [("1", AT(0), AT(23)), ("1", AT(0), AT(23)), ("1", AT(2), None), ("2", AT(0), AT(23)), ("3", AT(0), AT(9)), ("4", None, AT(10)), (None, AT(0), AT(2)), ("5", None, None)]


@pytest.mark.parametrize("order", [(), ("startdate", "turn")])


def test_whole_tickets_merge_as_by_the_tree(spark, order):
    stops = spark.createDataFrame(STOPS, "t string, startdate timestamp_ntz, enddate timestamp_ntz, turn int")
    bounds = spark.createDataFrame(BOUNDS, "t string, lo timestamp_ntz, hi timestamp_ntz")
    got = [
        sorted(map(str, intervals.stops_by_ticket(stops, bounds, "t", "lo", "hi", order=order, whole_stops=n).collect()))
        for n in (0, 2, intervals.WHOLE_STOPS)
    ]
    assert got[0] and got[0] == got[1] == got[2]


def test_normal_forms_need_no_batches_of_thousands_of_texts(spark):
    df = spark.createDataFrame([("ﬁn é",), (None,), ("plain",), ("é Ж",)], "t string").select(canonical(F.col("t")).alias("c"), strip_marks(F.col("t")).alias("m"))
    assert "ArrowEvalPython" not in _plan(df)
    assert [tuple(r) for r in df.collect()] == [("fin é", "ﬁn e"), ("", None), ("plain", "plain"), ("é Ж", "e Ж")]


PAGES = [
    "<table><tr><td>a &amp; b</td><td> c", "<TABLE class=x><TBODY><TR><TD a='1' b>x<b>y</b></TD></TR></TBODY></TABLE>&lt", "<table><tbody><tr><td>1<table><tr><td>2</td></tr></table>3</td></tr></table>",
    "<tr><td>a<td>b</tr>text</td>", "<table><tr></tr></table><tr><td>&#225;&eacute &notit;</td></tr>", "", "plain & text", "<td><tr><td>x</tbody></table><tbody><tr><td>y", "<tr><td\n>a</td\t></TR>",
]
ODD = ["<tr><td>a < b</td></tr>", "<tr><td><br/>x</td></tr>", "<tr><td><!-- <td> --></td></tr>", "<script><tr><td>x</td></tr></script>", "<tr><td title='>'>x</td></tr>", "<tr><td>x</td", "<title><td>x</title>"]


def _parsed(html):
    found = landed._TableRows()
    found.feed(html)
    found.close()
    return found.cells()


def test_plain_pages_read_as_by_the_parser():
    for html in PAGES:
        assert landed._plain_rows(html) == _parsed(html), html
    for html in ODD:
        assert landed._plain_rows(html) is None and landed._rows_of(html) == _parsed(html), html


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, "<tr><td>a</td></tr><tr></tr>"), (2, None), (3, "")], "page_no int, html string")
    rows = landed.agent_table(pages)
    assert _plan(rows).count("ArrowEvalPython") == 1
    assert [(r.page_no, r.row, r.Fecha) for r in rows.collect()] == [(1, 0, "a")]


def test_no_wide_row_is_dealt_by_circuit(spark):
    rows = spark.createDataFrame([("1", "C1", 1), ("1", "C2", 2), ("2", "C1", 3), ("9", None, 4)], "nro_incidencia string, inc_cid string, n int")
    incidents = spark.createDataFrame([("1", "C1"), ("1", "C1"), ("1", "C2"), ("2", "C1")], "nro_incidencia string, inc_cid string")
    circuits = spark.createDataFrame([("C1", "a"), ("C1", "b"), ("C3", "c")], "inc_cid string, map_site string")
    out = v.with_circuits(rows, v.Inputs(cut=rows, incidents=incidents, stops=None, circuits=circuits))
    plain = joins.enrich(rows, circuits, ["inc_cid"]).select(*out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_claims_are_asked_by_the_rule_and_not_filtered_in_the_cells(spark):
    raw = spark.createDataFrame([("1", "RECLAMO ", v.DATA, 1), ("2", "RECLAMO", "x", 2), ("3", "OTRO", v.DATA, 3), ("4", "RECLAMO", v.VOICE, 4), ("5", None, None, 5)], "t string, kind string, comp string, row long")
    cut = raw.select(F.trim("t").alias(v.KEY), F.trim("kind").alias("tipo_reporte"), F.trim("comp").alias("cut_component"), "row")
    documents = spark.createDataFrame([("4", v.VOICE), ("1", v.VOICE)], f"{v.KEY} string, word_component string")
    out = v.missing_findings(cut, documents, v.claim_not_in_faults())
    filters = [line for line in _plan(out).splitlines() if "Filter" in line]
    assert not any("RECLAMO" in line for line in filters)
    assert [(r[v.KEY], r["row"]) for r in out.collect()] == [("1", 1)]
    assert [r[v.KEY] for r in v.claims_missing(cut, documents).collect()] == ["1"]


def test_repeated_tickets_are_found_without_dealing_rows_twice(spark):
    frame = lambda keys: spark.createDataFrame([(k, f"row {i}") for i, k in enumerate(keys)], f"{v.KEY} string, wide string")
    incidents = spark.createDataFrame([("1", 1), ("3", 3)], f"{v.KEY} string, n int")

    def joined(keys):
        given = v.Inputs(cut=frame(keys), incidents=incidents, stops=None, circuits=None, unique=("cut",))
        return joins.enrich(given.checked().cut, incidents, [v.KEY])

    keys = ["1", "2", "nan", "nan", "", "No disponible", "No disponible", None, None]
    out = joined(keys)
    assert "Window" not in _plan(out) and _plan(out).count("Exchange hashpartitioning") == 3
    assert out.columns == [v.KEY, "wide", "n"]
    assert sorted(map(str, out.collect())) == sorted(map(str, joins.enrich(frame(keys), incidents, [v.KEY]).collect()))
    with pytest.raises(Exception, match="cut: more than one row for nro_incidencia=2"):
        joined([*keys, "2"]).collect()


def test_repeated_document_rows_raise_where_they_are_counted(spark):
    cut = spark.createDataFrame([("1", v.DATA, 1), ("2", v.DATA, 2)], f"{v.KEY} string, cut_component string, row int")
    faults, reports = (spark.createDataFrame(rows, f"{v.KEY} string, word_component string, {c} int") for rows, c in (
        ([("1", v.DATA, 1), ("1", v.VOICE, 2), ("1", None, 3), ("nan", v.DATA, 4), ("nan", v.DATA, 5), ("7", v.DATA, 6)], "f"),
        ([("2", v.DATA, 1), ("2", v.DATA, 2), ("8", None, 3), ("8", None, 4)], "r"),
    ))
    free, once = (v.with_words(cut, faults, reports, names) for names in ((), ("faults",)))
    assert "Window" not in _plan(once) and free.columns == once.columns
    assert sorted(map(str, free.collect())) == sorted(map(str, once.collect()))
    with pytest.raises(Exception, match="reports: more than one row for nro_incidencia=(2, word_component=COMPONENTE II|8, word_component=null)"):
        v.with_words(cut, faults, reports, ("faults", "reports")).collect()
    with pytest.raises(Exception, match="faults: more than one row for nro_incidencia=7, word_component=COMPONENTE II"):
        v.with_words(cut, faults.union(faults.where(f"{v.KEY} = '7'")), reports, ("faults",)).collect()
    annexes = spark.createDataFrame([("1", v.DATA, 1), ("9", v.VOICE, 2), ("9", v.VOICE, 3)], f"{v.KEY} string, cut_component string, a int")
    again = joins.repeated("annexes", {v.KEY: v.KEY, "annex_component": "cut_component"})
    out = joins.mark_join(cut, annexes, [v.KEY, "cut_component"], {"m": F.lit(True)}, dealt=[v.KEY], once=([], again))
    with pytest.raises(Exception, match="annexes: more than one row for nro_incidencia=9, annex_component=COMPONENTE IV"):
        out.collect()


BREAKS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def _body(text):
    """The body line by line."""
    text = text.replace("\r\n", "\n")
    end = at = 0
    for line in "".join("\n" if x in BREAKS else x for x in text).split("\n"):
        at += len(line) + 1
        if line.strip() and not line.strip().lower().startswith(("fecha y hora inicio", "fecha y hora de fin")):
            end = at - 1
    return text[:end]


def test_narrative_body_looks_at_lines_and_not_behind_each_character(spark):
    texts = ["", "\n", "a", "a\n", " \n a \t\n\n Fecha y hora inicio: x\n", "a\r\r\nFECHA Y HORA DE FIN\r\n", "Fecha y hora inicio", "\U0001f600\r\n\u2028b\xa0"]
    texts += [f"é 01/02/2024{b}{x}{b}{y}" for b in BREAKS for x in ("", " \x1f", "Fecha y hora inicio 1", "fin 2") for y in ("", "\tfecha y hora de fin", "\r\n", "z")]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    out = df.select("i", td.narrative_body(F.col("t")).alias("b"))
    assert "(?<!" not in _plan(out)
    got = dict(map(tuple, out.collect()))
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(texts))] == [_body(x) for x in texts]


def test_cells_are_stripped_once(spark):
    cells = {c: F.lit(f" {c} ") for c in OUTAGE_CUT.columns} | {"TIPO CASO": F.col("t"), "DF": F.col("t"), "CID": F.col("n"), "TICKET": F.col("t")}
    raw = spark.createDataFrame([("  x ", 1), (None, None), (" \t", 2), ("\r", 3)], "t string, n int")
    rows = prepare_cut(raw.select(*[x.alias(k) for k, x in cells.items()]))
    assert _plan(rows.select("cut_case", "cut_district")).count("trim(") == 2
    got = [tuple(r) for r in rows.select(v.KEY, "cut_case", "cut_district", "cut_cid").collect()]
    empty = "No disponible"
    assert got == [("x", "x", "x", "1"), ("nan", "nan", "nan", "nan"), (empty, empty, empty, "2"), (empty, empty, empty, "3")]


PERIODS = [
    "1/2/2020 3:04:05 hasta el día 4/5/2020 6:07:08", "hasta el día\n1/2/2020 5:1/2/2020", "5:1/2/2020 9:30\n٣/1/2020 HASTA EL DÍA 2/", "hasta el día 3/4/2020 hasta el día\xa0٣/x 1:00",
    "a1/2/2020 b3:04 10:11 12/1/2020", "1/\r2/\n3/4", "", "7:5/1/24 8:05/1/2024",
]


def test_periods_are_padded_in_one_scan(spark):
    df = spark.createDataFrame([*[(x,) for x in PERIODS], (None,)], "t string")
    t, hour = F.col("t"), r"(\d)(?<=\b\d)(?=:\d{2})"
    first = F.regexp_replace(t, r"(?m)^(\d)(?=/)", "0$1")
    second = {case: F.regexp_replace(first, rf"(?{flags})(hasta el día\s)(\d)(?=/)", "$10$2") for case, flags in ((True, "iU"), (False, "U"))}
    want = [F.regexp_replace(c, hour, "0$1") for c in (second[True], second[False], F.regexp_replace(t, r"(\d)(?<=\b\d)(?=/\d{1,2}/\d{4})", "0$1"))]
    got = [td.pad_period(t), td.pad_period(t, any_case=False), td.pad_date_time(t)]
    out = df.select(*[c.alias(f"g{i}") for i, c in enumerate(got)])
    assert _plan(out).count("regexp_replace(") == 3
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in df.select(*[c.alias(f"w{i}") for i, c in enumerate(want)]).collect()]
