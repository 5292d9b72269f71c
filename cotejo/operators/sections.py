"""Document lines to rows: technical reports and outage annexes.

Input is ``(doc_id, line_no, text)``.  A line belongs to the latest heading of
its document; sections are then aggregated by (document, heading line), so a
long document spreads over its sections and line slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.text import lines, strip
from cotejo.functions.textdates import BLOCK_HEADER, BLOCK_PERIOD, BLOCK_TOTAL, pad_hours, pad_period
from cotejo.operators.scans import SLICE_ROWS, carry_forward, sliced

# Headings and field patterns of the two documents.
REPORT_HEADING = r"(?iU)REPORTE T[EÉ]CNICO Nº\s*(\d+)"
SERVICE_ID = r"(?iU)CUISMP\.?\s*(?:\:|\s)?\s*(\d+)(?:\.|,|;|:|\s|$)"
CASE_TYPE = r"(?iU)Tipo Caso\s*:\s*(.+)"
OBSERVATION = r"(?iU)Observaci[oó]n\s*:\s*(.+)"
FIELD_HINT = r"(?iU)CUISMP|Tipo Caso|Observaci[oó]n"
CAUSE_TITLE = r"(?iU)^Determinaci[oó]n\s+de\s+la\s+causa\s*:?\s*$"
MEASURES_TITLE = r"(?iU)^MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS"
MEASURES_END = ("detalle de solicitudes", "solicitudes")
EVENT_LINE = (
    r"(?iU)^(?:Fecha y Hora|Hora)(?:\s+de)?\s+(Inicio|Fin)(?:\s*:)?\s*"
    r"(\d{1,2}/\d{1,2}/\d{4})\s*(?:a las\s*)?(\d{1,2}:\d{2})(?:\s+horas\.?)?"
)
ANNEX_TICKET = r"(?iU)ANEXO\s+\d+\s+–\s+TICKET\s+(\d+)"
ANNEX_END = r"(?iU)EVIDENCIA RESPONSABILIDAD DE TERCEROS"
REPORT_COLUMNS = (
    "nro_incidencia",
    "CUISMP",
    "Tipo Caso",
    "Observación",
    "DETERMINACIÓN DE LA CAUSA",
    "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS",
    "Fecha y hora inicio",
    "Fecha y hora fin",
)


def document_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts to numbered lines (1-based), each stripped."""
    return docs.select(
        F.col(doc).alias("doc_id"), F.posexplode(lines(F.col(text))).alias("_p", "_t")
    ).select("doc_id", (F.col("_p") + 1).cast("bigint").alias("line_no"), strip(F.col("_t")).alias("text"))


def sections(
    df: DataFrame, heading: Column, section: str = "section", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Lines after a heading, with the heading's line number; earlier lines go."""
    opens = F.when(heading, F.col("line_no"))
    return carry_forward(df, ["doc_id"], "line_no", opens, section, slice_rows).where(
        F.col(section).isNotNull()
    )


def _joined(ok: Column, value: Column, sep: str) -> Column:
    """Values of the rows where ``ok``, in line order, as one text."""
    kept = F.array_sort(F.collect_list(F.when(ok, F.struct("line_no", value.alias("v")))))
    return F.array_join(F.transform(kept, lambda x: x["v"]), sep)


def _first(ok: Column, value: Column) -> Column:
    return F.min_by(value, F.when(ok, F.col("line_no")))


def _last(ok: Column, value: Column) -> Column:
    return F.max_by(value, F.when(ok, F.col("line_no")))


def _latest(c: Column, rows) -> Column:
    return F.last(c, ignorenulls=True).over(rows)


def _first_since(mark: str, prior: str, heading: str) -> Column:
    """``mark``, unless one like it (``prior``) came after the latest heading."""
    return F.when(F.col(prior).isNull() | (F.col(prior) < F.col(heading)), F.col(mark))


def scanned_sections(
    df: DataFrame, heading: Column, firsts: dict[str, Column], latest: dict[str, Column], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Lines after a heading with the state of a scan over their document, of any length, in three shuffles.

    Adds ``section`` (line of the latest heading), for each of ``firsts`` the first such line of the
    section up to here, for each of ``latest`` the latest such line of the document up to here, and ``_n1`` and
    ``_n2``, the next two lines.  Lines are scanned inside slices; a slice hands on one summary row: its latest
    heading, the first marks after that, its latest marks, and its two opening lines for the slice before.
    """
    mark = lambda on: F.when(on, F.col("line_no"))
    names = [*firsts]
    rows = sliced(df, "line_no", slice_rows).withColumns(
        {"_opens": mark(heading), **{f"_is_{n}": mark(on) for n, on in firsts.items()}, **{f"_at_{n}": mark(on) for n, on in latest.items()}}
    )
    inside = Window.partitionBy("doc_id", "_slice").orderBy("line_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns(
        {
            "_n1": F.lead("text", 1).over(inside),
            "_n2": F.lead("text", 2).over(inside),
            "_own": _latest(F.col("_opens"), upto),
            **{f"_at_{n}": _latest(F.col(f"_at_{n}"), upto) for n in latest},
            **{f"_prior_{n}": _latest(F.col(f"_is_{n}"), before) for n in names},
        }
    )
    # Before the first heading of a slice any first mark counts, until the earlier slices tell otherwise.
    since = lambda n: F.when(F.col(f"_is_{n}").isNotNull(), _first_since(f"_is_{n}", f"_prior_{n}", "_from"))
    local = local.withColumn("_from", F.coalesce("_own", F.lit(-1).cast("bigint")))
    local = local.withColumns({f"_first_{n}": _latest(since(n), upto) for n in names})
    valid = lambda n: F.when(F.col(f"_first_{n}") > F.col("_from"), F.col(f"_first_{n}"))
    local = local.withColumns({f"_first_{n}": valid(n) for n in names}).drop("_opens", "_from", *[f"_is_{n}" for n in names], *[f"_prior_{n}" for n in names])

    at_end = lambda c: F.max_by(c, "line_no")
    summary = local.groupBy("doc_id", "_slice").agg(
        F.max("_own").alias("_own"),
        *[at_end(f"_first_{n}").alias(f"_first_{n}") for n in names],
        *[F.max(f"_at_{n}").alias(f"_at_{n}") for n in latest],
        F.min_by(F.struct("text", "_n1"), "line_no").alias("_h"),
    )
    by_slice = Window.partitionBy("doc_id").orderBy("_slice")
    prior = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {
            "_from": _latest(F.col("_own"), by_slice.rowsBetween(Window.unboundedPreceding, 0)),
            "_carry": _latest(F.col("_own"), prior),
            **{f"_carry_at_{n}": F.max(f"_at_{n}").over(prior) for n in latest},
            **{f"_prior_{n}": _latest(F.col(f"_first_{n}"), prior) for n in names},
            "_a": F.lead("_h.text", 1).over(by_slice),
            "_b": F.coalesce(F.lead("_h._n1", 1).over(by_slice), F.lead("_h.text", 2).over(by_slice)),
        }
    )
    summary = summary.withColumns({f"_carry_{n}": _latest(_first_since(f"_first_{n}", f"_prior_{n}", "_from"), prior) for n in names})
    carried = summary.select("doc_id", "_slice", "_carry", "_a", "_b", *[f"_carry_{n}" for n in names], *[f"_carry_at_{n}" for n in latest])

    section = F.coalesce("_own", "_carry")
    handed = lambda n: F.when(F.col("_own").isNull() & (F.col(f"_carry_{n}") > F.col("_carry")), F.col(f"_carry_{n}"))
    out = local.join(carried, ["doc_id", "_slice"]).where(section.isNotNull())
    return out.select(
        *df.columns,
        section.alias("section"),
        *[F.coalesce(handed(n), F.col(f"_first_{n}")).alias(n) for n in names],
        *[F.coalesce(f"_at_{n}", f"_carry_at_{n}").alias(n) for n in latest],
        F.coalesce("_n1", "_a").alias("_n1"),
        F.coalesce("_n2", F.when(F.col("_n1").isNull(), F.col("_b")).otherwise(F.col("_a"))).alias("_n2"),
    )


def _field(pattern: str) -> Column:
    """Value of a labelled field whose label begins on this line.

    White space in the patterns may include line breaks, so the value is looked
    for in the line and the next two filled ones.
    """
    begins = F.regexp_instr(F.col("_near"), F.lit(pattern)).between(1, F.length("text"))
    return _first(begins, strip(F.regexp_extract("_near", pattern, 1)))


def technical_reports(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per report heading with the eight ``REPORT_COLUMNS``.

    A field whose label and value are split over lines is read across the
    break.  Documents without a heading give no rows.
    """
    t = F.col("text")
    by = ["doc_id", "section"]
    rows = df.withColumn("text", strip(t)).where(t != "")
    ends = F.lit(False)
    for word in MEASURES_END:
        ends = ends | F.startswith(F.lower(t), F.lit(word))
    firsts = {"_title": t.rlike(MEASURES_TITLE), "_cause": t.rlike(CAUSE_TITLE)}
    rows = scanned_sections(rows, t.rlike(REPORT_HEADING), firsts, {"_end": ends}, slice_rows)
    n1 = F.when(~F.col("_n1").rlike(REPORT_HEADING), F.col("_n1"))
    n2 = F.when(n1.isNotNull() & ~F.col("_n2").rlike(REPORT_HEADING), F.col("_n2"))
    near = F.when(t.rlike(FIELD_HINT), F.concat_ws("\n", t, n1, n2))
    rows = rows.withColumn("_near", near).drop("_n1", "_n2")

    # After the section's first title, until a closing line has come.
    inside = (F.col("line_no") > F.col("_title")) & (F.col("_end").isNull() | (F.col("_end") <= F.col("_title")))
    event = t.rlike(EVENT_LINE)
    which = F.lower(F.regexp_extract(t, EVENT_LINE, 1))
    when = F.concat_ws(" ", F.regexp_extract(t, EVENT_LINE, 2), F.regexp_extract(t, EVENT_LINE, 3))
    fields = {"CUISMP": SERVICE_ID, "Tipo Caso": CASE_TYPE, "Observación": OBSERVATION}
    aggs = {
        "nro_incidencia": _first(t.rlike(REPORT_HEADING), F.regexp_extract(t, REPORT_HEADING, 1)),
        **{name: _field(pattern) for name, pattern in fields.items()},
        "DETERMINACIÓN DE LA CAUSA": _first(F.col("line_no") > F.col("_cause"), t),
        "MEDIDAS CORRECTIVAS Y/O PREVENTIVAS TOMADAS": strip(_joined(inside & ~event, t, " ")),
        "Fecha y hora inicio": _last(inside & event & (which == "inicio"), when),
        "Fecha y hora fin": _last(inside & event & (which == "fin"), when),
    }
    return (
        rows.groupBy(*by)
        .agg(*[F.coalesce(c, F.lit("")).alias(n) for n, c in aggs.items()])
        .select("doc_id", "section", *REPORT_COLUMNS)
    )


def outage_annexes(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per annex heading before the evidence heading.

    Header: the last one; periods: all, padded; total: the first, after which
    the rest of the annex is ignored.
    """
    rows = df.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    t = F.col("text")
    evidence = (
        rows.where(t.rlike(ANNEX_END)).groupBy("doc_id").agg(F.min("line_no").alias("_evidence"))
    )
    rows = (
        rows.join(evidence, "doc_id", "left")
        .where(F.col("_evidence").isNull() | (F.col("line_no") < F.col("_evidence")))
        .drop("_evidence")
    )
    rows = sections(rows, t.rlike(ANNEX_TICKET), slice_rows=slice_rows)
    by = ["doc_id", "section"]
    body = F.col("line_no") > F.col("section")
    ends = rows.groupBy(*by).agg(
        F.min(F.when(body & t.rlike(BLOCK_TOTAL), F.col("line_no"))).alias("_end")
    )
    rows = rows.join(ends, by).where(F.col("_end").isNull() | (F.col("line_no") <= F.col("_end")))
    total = t.rlike(BLOCK_TOTAL) & body
    aggs = {
        "ticket": _first(t.rlike(ANNEX_TICKET), F.regexp_extract(t, ANNEX_TICKET, 1)),
        "indisponibilidad_header": _last(body & t.rlike(BLOCK_HEADER), t),
        "indisponibilidad_periodos": _joined(body & t.rlike(BLOCK_PERIOD), pad_period(t), "\n"),
        "indisponibilidad_footer": _first(total, t),
        "indisponibilidad_total": _first(total, pad_hours(F.regexp_extract(t, BLOCK_TOTAL, 1))),
    }
    return rows.groupBy(*by).agg(*[F.coalesce(c, F.lit("")).alias(n) for n, c in aggs.items()])
