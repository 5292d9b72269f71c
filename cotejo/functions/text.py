"""Text expressions.  Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from both ends of a cell, and line breaks.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)
LINE_BREAK = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# The words and patterns the checks look for.
UNKNOWN = "No disponible"
COMPONENT_LABEL = r"(?iU)(?:COMPONENTE|COMONENTE)\s*(?:IV|II|III|I|V)(?:\s*-|\s*\.-|\s*)\s*"
REPEATED_PHRASE = r"(?U)A\s+través"
SLASH_TYPO = r"(?iU)cliente\s*/\s*debido"
CHECKED_TWICE = r"(?iU)\b(Inmediatamente, claro revisó)\b.*\b\1\b"
ACROSS_TWICE = r"(?U)\b(A través)\b.*\b\1\b"
RECOMMENDS = "recomienda"
TRAILING_DATE_LINE = (
    r"(?iU)^\s*fecha\s*y\s*hora\s*(de\s*)?(inicio|fin)?:?\s*"
    r"\d{1,2}/\d{1,2}/\d{4}\s*\d{1,2}:\d{2}\s*$"
)
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
UNACCENTED = "AAAAAAEEEEIIIIOOOOOUUUUNCY"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def starts_like(c: Column, word: str) -> Column:
    """Cheap look at the first characters, in front of a costlier pattern."""
    return F.lower(F.substring(c, 1, len(word))) == word


def lines(c: Column) -> Column:
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_BREAK)


def clean_cell(c: Column, keep_newlines: bool = True) -> Column:
    """Carriage returns to blanks, exporter residue removed, ends stripped."""
    out = F.replace(F.replace(c, F.lit("\r"), F.lit(" ")), F.lit("_x000D_"), F.lit(""))
    if not keep_newlines:
        out = F.replace(out, F.lit("\n"), F.lit(""))
    return strip(out)


def as_text(c: Column, null_text: str = "nan") -> Column:
    """Stripped text in which a missing value reads ``null_text``."""
    return F.coalesce(strip(c.cast("string")), F.lit(null_text))


def shown(c: Column, null_text: str = "nan") -> Column:
    """Text of a value inside a message."""
    return F.coalesce(c.cast("string"), F.lit(null_text))


def or_unknown(c: Column, default: str = UNKNOWN) -> Column:
    return stripped_or_unknown(strip(c), default)


def stripped_or_unknown(c: Column, default: str = UNKNOWN) -> Column:
    """As ``or_unknown``, of text that is stripped already: each of the strips would be worked out anew."""
    return F.when(c == "", F.lit(default)).otherwise(c)


def integer_part(c: Column) -> Column:
    """``13.5`` -> ``13``; anything that is not a number -> empty text."""
    t = strip(c.cast("string"))
    whole = t.rlike(r"^[+-]?\d{1,38}$")
    real = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(whole, t.try_cast("decimal(38,0)").cast("string"))
        .when(real, F.coalesce(t.try_cast("double").try_cast("bigint").cast("string"), F.lit("")))
        .otherwise(F.lit(""))
    )


def one_line(c: Column) -> Column:
    """Every run of white space becomes one blank; missing becomes empty."""
    return F.coalesce(F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def drop_component_label(c: Column) -> Column:
    return F.coalesce(strip(F.regexp_replace(c, COMPONENT_LABEL, "")), F.lit(""))


def leading_token(c: Column, sep: str = "-") -> Column:
    return strip(F.split_part(c, F.lit(sep), F.lit(1)))


def field(c: Column, n: int, sep: str = r"\|") -> Column:
    """Zero-based field of a separated cell, null when absent."""
    return F.try_element_at(F.split(c, sep), F.lit(n + 1))


def phrase_count(c: Column) -> Column:
    possible = F.contains(c, F.lit("través"))
    return F.when(possible, F.regexp_count(c, F.lit(REPEATED_PHRASE))).otherwise(F.lit(0))


def repeats_phrase(c: Column) -> Column:
    return phrase_count(c) > 1


def has_slash_typo(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("/")) & c.rlike(SLASH_TYPO), F.lit(False))


def has_repetition(c: Column) -> Column:
    return F.coalesce(c.rlike(CHECKED_TWICE) | c.rlike(ACROSS_TWICE), F.lit(False))


def only_alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9 ]", "")


def upper_unaccented(c: Column) -> Column:
    """Upper case without accents, for the Latin letters in ``ACCENTED``.

    ``functions.unicode.strip_marks`` covers every script through Arrow.
    """
    return F.translate(F.upper(c), ACCENTED, UNACCENTED)


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def short_name(c: Column) -> Column:
    """Four words -> first and third; three -> first and second; else as is."""
    return let(
        words(c),
        lambda w: F.when(F.size(w) == 4, F.concat_ws(" ", w[0], w[2]))
        .when(F.size(w) == 3, F.concat_ws(" ", w[0], w[1]))
        .otherwise(F.coalesce(strip(c), F.lit(""))),
    )


def surname_first(c: Column) -> Column:
    """Three or more words -> the last two in front of the rest."""
    return let(
        words(c),
        lambda w: F.when(
            F.size(w) >= 3,
            F.concat_ws(
                " ",
                F.array_join(F.slice(w, -2, 2), " "),
                F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), " "),
            ),
        ).otherwise(c),
    )


def shift_start(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), strip(F.split_part(c, F.lit(" - "), F.lit(1)))).otherwise(c)


def split_narrative(c: Column, word: str = RECOMMENDS) -> Column:
    """Struct (before, after): the first line holding ``word`` opens ``after``."""

    def parts(at: Column, ls: Column) -> Column:
        before = F.when(at > 0, F.array_join(F.slice(ls, F.lit(1), at - 1), "\n")).otherwise(c)
        after = F.when(at > 0, F.array_join(F.slice(ls, at, F.size(ls)), "\n")).otherwise(F.lit(""))
        return F.struct(before.alias("before"), after.alias("after"))

    def split(ls: Column) -> Column:
        hits = F.transform(ls, lambda x: F.contains(F.lower(x), F.lit(word)))
        return let(F.array_position(hits, F.lit(True)).cast("int"), lambda at: parts(at, ls))

    return let(F.split(c, "\n"), split)


def drop_trailing(ls: Column, drop) -> Column:
    """Array of lines without the trailing ones whose stripped text ``drop`` accepts."""

    def kept(a: Column) -> Column:
        last = F.array_max(F.transform(F.transform(a, strip), lambda x, i: F.when(~drop(x), i + 1)))
        return F.slice(a, F.lit(1), F.coalesce(last, F.lit(0)))

    return let(ls, kept)


def drop_trailing_date_lines(c: Column) -> Column:
    dated = lambda x: starts_like(x, "fecha") & x.rlike(TRAILING_DATE_LINE)
    return F.array_join(drop_trailing(F.split(c, "\n"), dated), "\n")


def replace_values(c: Column, mapping: dict[str, str]) -> Column:
    """Exact value replacement; other values stay."""
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)) if out is None else out.when(c == old, F.lit(new))
    return c if out is None else out.otherwise(c)


def label_if_contains(c: Column, label: str) -> Column:
    return F.when(F.contains(c, F.lit(label)), F.lit(label)).otherwise(c)


def plus_flags(base: str, flags: list[tuple[Column, str]]) -> Column:
    return F.concat_ws("+", F.lit(base), *[F.when(cond, F.lit(name)) for cond, name in flags])
