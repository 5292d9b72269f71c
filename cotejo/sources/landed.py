"""Landed documents to rows: word tables, HTML tables and mail."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import strip

# Owner of each fault table, columns of the scraped tables, mail words.
TABLE_OWNERS = {4: "CLARO", 5: "CLIENTE", 6: "TERCEROS"}
AGENT_COLUMNS = ("Fecha", "Anexo", "Usuario", "Agente", "Evento", "Duracion", "Motivo")
PRESENCE_COLUMNS = ("ANALISTA", "HORARIO", "MODALIDAD", "FECHA", "HORA DE INGRESO")
TICKET_WORD = r"(?iU)\bticket\b"
TICKET_FLAGS = ("ok", "No encontrado")
BLANK_CELL = "-"
ENTITIES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _owner_cells(cells: DataFrame, owners: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """Body cells of the owner tables, and the tables' headers by position: (doc_id, table_no, col, header, last).

    A header given twice names its last column; ``last`` tells which one that is.
    """
    kept = cells.where(F.col("table_no").isin(*owners)).withColumn("text", strip(F.col("text")))
    names = kept.where(F.col("row") == 0).select("doc_id", "table_no", "col", F.col("text").alias("header"))
    ends = names.groupBy("doc_id", "table_no", "header").agg(F.max("col").alias("_end"), F.collect_set("col").alias("_cols"))
    heads = ends.select("doc_id", "table_no", "header", "_end", F.explode("_cols").alias("col"))
    heads = heads.select("doc_id", "table_no", "col", "header", (F.col("col") == F.col("_end")).alias("last"))
    return kept.where(F.col("row") > 0), heads


def fault_tables(cells: DataFrame, headers: Sequence[str], owners: dict[int, str] = TABLE_OWNERS) -> DataFrame:
    """Cells ``(doc_id, table_no, row, col, text)`` of the owner tables to rows.

    Row 0 names the columns; a header given twice means its last column, the others are in
    ``undeclared_cells``.  ``headers`` declares the names to expect, so the pivot needs no extra pass; a cell missing from
    a row reads empty, a column missing from a table is null.  Missing tables give no rows.
    """
    body, heads = _owner_cells(cells, owners)
    rows = (
        body.join(heads, ["doc_id", "table_no", "col"], "left")
        .groupBy("doc_id", "table_no", "row")
        .pivot("header", list(headers))
        .agg(F.max(F.when(F.col("last"), F.col("text"))))
    )
    present = heads.groupBy("doc_id", "table_no").agg(F.collect_set("header").alias("_names"))
    rows = rows.join(present, ["doc_id", "table_no"])
    filled = {
        h: F.when(F.col(f"`{h}`").isNull() & F.array_contains("_names", h), F.lit("")).otherwise(F.col(f"`{h}`"))
        for h in headers
    }
    owner = F.create_map(*[x for n, o in owners.items() for x in (F.lit(n), F.lit(o))])
    return rows.withColumns({**filled, "responsable": owner[F.col("table_no")]}).drop("_names")


def undeclared_cells(cells: DataFrame, headers: Sequence[str], owners: dict[int, str] = TABLE_OWNERS) -> DataFrame:
    """Cells of the owner tables that ``fault_tables`` leaves out: under no declared header, or under one given again further right."""
    body, heads = _owner_cells(cells, owners)
    body = body.join(heads, ["doc_id", "table_no", "col"], "left")
    return body.where(F.col("header").isNull() | ~F.col("header").isin(*headers) | ~F.col("last")).drop("last")


def cell_text(html: Column) -> Column:
    """Text of a markup fragment: tags removed, basic entities decoded, stripped."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def element_texts(html: Column, tag: str) -> Column:
    """Texts of every ``tag`` element, in page order."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, cell_text)


def html_rows(pages: DataFrame, page: str, html: str, row_tag: str, cell_tag: str) -> DataFrame:
    """Elements ``row_tag`` with at least one ``cell_tag``: (page, row, cells).

    For elements that do not nest, such as lists of links; see ``table_rows`` for tables.
    """
    rows = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<{row_tag}(?:\s[^>]*)?>(.*?)</{row_tag}>"), F.lit(1))
    return (
        pages.select(F.col(page), F.posexplode(rows).alias("row", "_html"))
        .select(page, "row", element_texts(F.col("_html"), cell_tag).alias("cells"))
        .where(F.size("cells") > 0)
    )


class _TableRows(HTMLParser):
    """Cells of each row of a page; rows outside its first ``tbody``, if it has one, are left empty.

    A cell belongs to every row around it, and its text is all text inside, so
    a nested table gives rows of its own and cells to the row that holds it.
    Character references are decoded; a row or cell that is never closed ends
    where the next one of its table begins.
    """

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, list]] = []
        self.rows: list[list[list[str]]] = []
        self.inside: list[bool] = []
        self.body: list | None = None

    def _end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] == "table":
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("tbody", "tr", "td"):
            self._end(tag)
        if tag not in ("table", "tbody", "tr", "td"):
            return
        held: list = []
        if tag == "tbody" and self.body is None:
            self.body = held
        elif tag == "tr":
            self.rows.append(held)
            self.inside.append(self.body is not None and any(h is self.body for _, h in self.open))
        elif tag == "td":
            for around, row in self.open:
                if around == "tr":
                    row.append(held)
        self.open.append((tag, held))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("table", "tbody", "tr", "td"):
            self._end(tag)

    def handle_data(self, data: str) -> None:
        if self.cdata_elem is None:
            for tag, held in self.open:
                if tag == "td":
                    held.append(data)

    def cells(self) -> list[list[str]]:
        return [["".join(c) for c in row] if here or self.body is None else [] for row, here in zip(self.rows, self.inside)]


_BLANK = r"[ \t\n\r\f]"
#: A tag that every parser reads alike: plain names, and values without angle brackets.
_PLAIN_TAG = re.compile(
    rf"""<(/[A-Za-z][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*(?:{_BLANK}+[A-Za-z][A-Za-z0-9_-]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[A-Za-z0-9_.-]+))?)*+){_BLANK}*>"""
)
#: Elements inside which tags may be text.
_RAW_TEXT = re.compile(r"(?i)<(?:script|style|xmp|iframe|noembed|noframes|noscript|plaintext|textarea|title)")
_NESTING = {"table", "tbody", "tr", "td"}


def _plain_rows(html: str) -> list[list[str]] | None:
    """As the parser reads it, for a page of plain tags and text only; None for any other."""
    pieces = _PLAIN_TAG.split(html)
    if any("<" in text for text in pieces[::2]) or _RAW_TEXT.search(html):
        return None
    found = _TableRows()
    for i, text in enumerate(pieces):
        if i % 2:
            name = text.split(None, 1)[0].lower()
            if name in _NESTING:
                found.handle_starttag(name, [])
            elif name[1:] in _NESTING and name[0] == "/":
                found.handle_endtag(name[1:])
        elif text and found.open:
            found.handle_data(unescape(text))
    return found.cells()


def _rows_of(html: str | None) -> list[list[str]] | None:
    if html is None:
        return None
    plain = _plain_rows(html)
    if plain is not None:
        return plain
    found = _TableRows()
    found.feed(html)
    found.close()
    return found.cells()


def table_rows(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Rows of a page's tables with at least one cell: (page, row, cells).

    Only the first ``tbody`` counts where there is one; ``row`` numbers all
    rows of the page.  Markup nests, so pages are parsed one by one in Arrow batches, and once: a filter that
    is inferred from the rows of a repeatable function would parse them again.
    """

    def parse(series: pd.Series) -> pd.Series:
        return series.map(_rows_of)

    parse.__annotations__ = {"series": pd.Series, "return": pd.Series}
    rows = pages.select(F.col(page), F.pandas_udf(parse, "array<array<string>>").asNondeterministic()(F.col(html)).alias("_rows"))
    rows = rows.select(F.col(page), F.posexplode("_rows").alias("row", "_cells"))
    return rows.where(F.size("_cells") > 0).select(page, "row", F.transform("_cells", strip).alias("cells"))


def agent_table(pages: DataFrame, page: str = "page_no", html: str = "html") -> DataFrame:
    """Seven declared columns of the agent activity table, all pages together.

    Rows of more cells do not fit the columns; they are in ``agent_rejects``.
    """
    rows = table_rows(pages, page, html).where(F.size("cells") <= len(AGENT_COLUMNS))
    return rows.select(
        page, "row", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(AGENT_COLUMNS)]
    )


def agent_rejects(pages: DataFrame, page: str = "page_no", html: str = "html") -> DataFrame:
    """Rows of the agent activity table with more cells than columns, whole."""
    return table_rows(pages, page, html).where(F.size("cells") > len(AGENT_COLUMNS))


def presence_table(pages: DataFrame, page: str = "page_no", html: str = "html") -> DataFrame:
    """Cells 3 to 7 of rows with eight or more; blank cells read ``-``; all-blank rows go."""
    rows = table_rows(pages, page, html).where(F.size("cells") >= 8)
    kept = F.transform(F.slice("cells", 4, 5), lambda x: F.when(x == "", F.lit(BLANK_CELL)).otherwise(x))
    rows = rows.withColumn("_kept", kept).where(F.exists("_kept", lambda x: x != BLANK_CELL))
    return rows.select(
        page, "row", *[F.get("_kept", F.lit(i)).alias(c) for i, c in enumerate(PRESENCE_COLUMNS)]
    )


def mail_table(messages: DataFrame) -> DataFrame:
    """``(received, sender, subject, body)`` to the mail report with its ticket flag."""
    mentions = F.coalesce(F.col("body").rlike(TICKET_WORD), F.lit(False))
    return messages.select(
        F.date_format("received", "yyyy-MM-dd").alias("Fecha"),
        F.date_format("received", "HH:mm:ss").alias("Hora"),
        F.coalesce("sender", F.lit("Sin remitente")).alias("Remitente"),
        F.coalesce("subject", F.lit("Sin asunto")).alias("Asunto"),
        F.when(mentions, TICKET_FLAGS[0]).otherwise(TICKET_FLAGS[1]).alias("Ticket"),
        F.col("body").alias("Cuerpo Completo"),
    )
