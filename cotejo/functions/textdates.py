"""Dates and outage blocks found inside narrative text.

Regular-expression matches carry no offsets in Spark.  Where positions are needed they
follow from the literal text of a match, or from the lengths of the matches and of the pieces
between them, carried along in a fold.  All of it is linear in the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import LINE_BREAK, UNKNOWN, WHITESPACE, let, lines, strip

# The patterns of dates, block headers, periods and totals.
BODY_PAIR = r"(?U)(\d{2}/\d{2}/\d{4})\D{0,10}(\d{1,2}:\d{2})"
LAST_PAIR = r"(?iU)(\d{2}/\d{2}/\d{4})\s*(?:a las\s*)?(\d{1,2}:\d{2})"
PLAIN_DATE = r"\d{2}/\d{2}/\d{4}"
PLAIN_TIME = r"\d{1,2}:\d{2}"
META_LINE = r"fecha y hora(?: de)? (?:inicio|fin)"
BLOCK_HEADER = r"(?iU)^Se tuvo indisponibilidad por parte del cliente.*"
BLOCK_PERIOD = (
    r"(?iU)^\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}.*hasta el día\s+"
    r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}.*$"
)
BLOCK_TOTAL = r"(?iU)^\(Total de horas sin acceso a la sede:\s*(\d{1,3}:\d{2})\s*horas\)"
FULL_HEADER = (
    r"(?iU)^Se tuvo indisponibilidad por parte del cliente para continuar los trabajos el/los día\(s\)"
)
FULL_PERIOD = (
    r"(?iU)^(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})\s+hasta el día\s+"
    r"(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}:\d{2})"
)
FULL_TOTAL = r"(?iU)\(Total de horas sin acceso a la sede:\s*(\d{1,2}:\d{2})\s*horas\)"


def _pair(match: Column, pattern: str, padded: bool = True) -> Column:
    day = F.regexp_extract(match, pattern, 1)
    time = F.regexp_extract(match, pattern, 2)
    if padded:
        time = F.when(F.length(time) == 4, F.concat(F.lit("0"), time)).otherwise(time)
    return F.concat(day, F.lit(" "), time)


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


_BREAKS = LINE_BREAK[1:-1]
_OTHER_BREAKS = "".join(x for x in _BREAKS if x != "\n")
#: The blanks within a line, as for strip, and as white space of a pattern.
_BLANKS = "[" + "".join(x for x in WHITESPACE if x not in _BREAKS) + "]*+"
_SPACE = r"[\x20\t\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
# Everything up to the last line that is neither blank nor a start or end line; found from the end of the text, whose line
# breaks are line feeds, so that a place is passed over by a look at the character before it.
_BODY = rf"(?smd)\A(.*^(?!{_BLANKS}(?:\n|\z))(?!{_BLANKS}(?iU:{META_LINE}))[^\n]+)"


def _other_breaks(c: Column) -> Column:
    """Whether a text has line breaks other than line feeds; few have."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in _OTHER_BREAKS])


def narrative_body(c: Column) -> Column:
    """The text without trailing blank lines and start/end lines; a line break counts as one character."""

    def search(text: Column) -> Column:
        fed = F.translate(text, _OTHER_BREAKS, "\n" * len(_OTHER_BREAKS))
        other = F.left(text, F.length(F.regexp_extract(fed, _BODY, 1)))
        return F.when(_other_breaks(text), other).otherwise(F.regexp_extract(text, _BODY, 1))

    return let(F.replace(c, F.lit("\r\n"), F.lit("\n")), search)


def body_range(c: Column) -> Column:
    """Struct (first, last) of ``dd/MM/yyyy HH:mm`` around the text's midpoint.

    Matches come in ascending position, so the first date of the first half can
    only be the first match and the last date of the second half only the last.
    The first match stands where its text first occurs.  The last one stands where its text last occurs, unless
    that occurrence begins inside the match, with its minutes as a day; then the pieces between matches tell.
    """

    def ends(body: Column, found: Column) -> Column:
        size = F.length(body)
        head, tail = F.get(found, F.lit(0)), F.try_element_at(found, F.lit(-1))
        after = F.length(F.call_function("substring_index", body, tail, F.lit(-1)))

        def last(end: Column, width: Column) -> Column:
            again = F.endswith(F.left(body, end - width), F.left(tail, width - 2))
            rest = F.when(again, F.length(F.element_at(F.split(body, BODY_PAIR, -1), -1))).otherwise(size - end)
            return F.when((size - rest - width) * 2 >= size, _pair(tail, BODY_PAIR))

        first = F.when((F.instr(body, head) - 1) * 2 < size, _pair(head, BODY_PAIR))
        closing = let(F.struct((size - after).alias("end"), F.length(tail).alias("width")), lambda x: last(x["end"], x["width"]))
        return _range(c, first, F.when(tail.isNotNull(), closing))

    return let(narrative_body(c), lambda body: let(_all(body, BODY_PAIR), lambda found: ends(body, found)))


def _range(c: Column, first: Column, last: Column) -> Column:
    known = lambda x: F.when(c.isNotNull(), F.coalesce(x, F.lit(UNKNOWN)))
    return F.struct(known(first).alias("first"), known(last).alias("last"))


#: A date or a time, so written that a place without a digit is passed over at once.
MARK = r"\d(?:\d/\d{2}/\d{4}|\d?:\d{2})"


def _paired(acc: Column, at: Column, day: Column, time: Column, size: Column) -> dict[str, Column]:
    """The state after a date or a time at a place: both together make a pair, which counts for its half of the text."""
    padded = F.when(F.length(time) == 4, F.concat(F.lit("0"), time)).otherwise(time)
    full, early = F.concat(day, F.lit(" "), padded), at * 2 < size
    return {
        "day": F.when(full.isNull(), day),
        "time": F.when(full.isNull(), time),
        "first": F.coalesce(acc["first"], F.when(early, full)),
        "last": F.when(full.isNotNull() & ~early, full).otherwise(acc["last"]),
    }


def _struct(**parts: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _open() -> dict[str, Column]:
    return {k: F.lit(None).cast("string") for k in ("day", "time", "first", "last")}


def _in_turn(size: Column, found: Column, gaps: Column) -> Column:
    """Fold over dates and times in one list, with the pieces between them."""

    def take(acc: Column, i: Column) -> Column:
        mark = F.get(found, i)
        is_day = F.substring(mark, 3, 1) == "/"
        at = acc["end"] + F.length(F.get(gaps, i))
        day, time = F.when(is_day, mark).otherwise(acc["day"]), F.when(is_day, acc["time"]).otherwise(mark)
        return _struct(end=at + F.length(mark), **_paired(acc, at, day, time, size))

    turns = F.when(F.size(found) > 1, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, _struct(end=F.lit(0), **_open()), take, lambda acc: _struct(first=acc["first"], last=acc["last"]))


def _merged(size: Column, days: Column, day_gaps: Column, times: Column, time_gaps: Column) -> Column:
    """The same over a list of dates and one of times, of which one may begin inside the other: a merge by place."""

    def take(acc: Column, _: Column) -> Column:
        day_at = F.when(acc["i"] < F.size(days), acc["day_end"] + F.length(F.get(day_gaps, acc["i"])))
        time_at = F.when(acc["j"] < F.size(times), acc["time_end"] + F.length(F.get(time_gaps, acc["j"])))

        def step(x: Column) -> Column:
            by_day = F.coalesce(x["day"] < x["time"], x["day"].isNotNull())
            pick = lambda a, b: F.when(by_day, a).otherwise(b)
            day, time = F.get(days, acc["i"]), F.get(times, acc["j"])
            ends = {"day_end": pick(x["day"] + F.length(day), acc["day_end"]), "time_end": pick(acc["time_end"], x["time"] + F.length(time))}
            moved = {"i": acc["i"] + by_day.cast("int"), "j": acc["j"] + (~by_day).cast("int")}
            return _struct(**moved, **ends, **_paired(acc, pick(x["day"], x["time"]), pick(day, acc["day"]), pick(acc["time"], time), size))

        return let(_struct(day=day_at, time=time_at), step)

    both = (F.size(days) > 0) & (F.size(times) > 0)
    turns = F.when(both, F.sequence(F.lit(1), F.size(days) + F.size(times))).otherwise(F.array().cast("array<int>"))
    zero = {k: F.lit(0) for k in ("i", "j", "day_end", "time_end")}
    return F.aggregate(turns, _struct(**zero, **_open()), take, lambda acc: _struct(first=acc["first"], last=acc["last"]))


def body_range_loose(c: Column) -> Column:
    """As ``body_range``, pairing each date with the next time in text order.

    Dates and times are found in one list; where one follows another so closely that it may begin inside it, they are
    found apart and merged.
    """

    def cut(body: Column, pattern: str, use) -> Column:
        return let(_all(body, pattern), lambda found: let(F.split(body, pattern, -1), lambda gaps: use(found, gaps)))

    def search(body: Column) -> Column:
        size = F.length(body)

        def apart() -> Column:
            return cut(body, PLAIN_DATE, lambda days, a: cut(body, PLAIN_TIME, lambda times, b: _merged(size, days, a, times, b)))

        next_to = lambda gap: (gap == "") | F.substring(gap, 1, 1).isin(":", "/") | (F.substring(gap, 2, 1) == "/")
        close = lambda gap, i: (i > 0) & next_to(gap)
        glued = lambda gaps: F.exists(F.transform(gaps, close), lambda x: x)
        done = cut(body, MARK, lambda found, gaps: F.when(glued(gaps), apart()).otherwise(_in_turn(size, found, gaps)))
        return let(done, lambda x: _range(c, x["first"], x["last"]))

    return let(narrative_body(c), search)


def closing_range(c: Column, padded: bool = True) -> Column:
    """Struct (first, last) of the last two date-time pairs; both null below two."""

    def ends(found: Column) -> Column:
        at = lambda i: F.when(
            F.size(found) >= 2, _pair(F.try_element_at(found, F.lit(i)), LAST_PAIR, padded)
        )
        return F.struct(at(-2).alias("first"), at(-1).alias("last"))

    return let(_all(c, LAST_PAIR), ends)


def closing_lines_range(c: Column) -> Column:
    """Struct (first, last) read from the last two lines that hold a pair."""

    def ends(ls: Column) -> Column:
        def at(i: int) -> Column:
            found = F.regexp_extract(F.try_element_at(ls, F.lit(i)), BODY_PAIR, 0)
            return F.when(F.size(ls) >= 2, _pair(found, BODY_PAIR))

        return F.struct(at(-2).alias("first"), at(-1).alias("last"))

    stripped = F.transform(lines(F.replace(c, F.lit("\r"), F.lit(" "))), strip)
    return let(F.filter(stripped, lambda x: x.rlike(BODY_PAIR)), ends)


# A day or an hour of one digit.
SHORT_HOUR = r"(\d)(?<=\b\d)(?=:\d{2})"
# Such an hour, and a day at the start of a line or after the connecting words; in one scan.
_PERIOD_DIGIT = r"(?m)((?U:\d))(?:(?<=\b\d)(?=:\d{2})|(?=/)(?:(?<=^\d)|(?<=(?%s:hasta el día\s\d))))"
# An hour or a day of one digit; a day of one digit is padded first, so that an hour may stand before it.
_ANY_DIGIT = r"(\d)(?<=\b\d)(?=/\d{1,2}/\d{4}|:(?:\d{2}|\d/\d{1,2}/\d{4}))"


def pad_hours(c: Column) -> Column:
    return F.regexp_replace(c, SHORT_HOUR, "0$1")


def pad_period(c: Column, any_case: bool = True) -> Column:
    """Zero-pad a leading day of each line, the day after the connecting words, and hours.

    Annexes may write those words in any case, outage blocks only as they are.
    """
    return F.regexp_replace(c, _PERIOD_DIGIT % ("iU" if any_case else "U"), "0$1")


def pad_date_time(c: Column) -> Column:
    return F.regexp_replace(c, _ANY_DIGIT, "0$1")


def _words(text: str) -> str:
    return f"(?iU:{text})"


def _unix(c: Column) -> Column:
    """The text with line feeds for all line breaks."""
    return F.when(_other_breaks(c), F.regexp_replace(c, f"\r\n|[{_OTHER_BREAKS}]", "\n")).otherwise(c)


# A line of such a text, from its first character that is no blank on; patterns for lines may not look past a line feed.
_LINE = f"(?md)^{_BLANKS}"
_FILLED = f"[^{WHITESPACE}]"
_REST_FILLED = rf"(?:[^\n]*{_FILLED})?"
# The patterns above for lines of a text, with flags on their words only.
_OUTAGE = "Se tuvo indisponibilidad por parte del cliente"
_FULL_OUTAGE = _words(_OUTAGE + r" para continuar los trabajos el/los día\(s\)")
_UNTIL, _TOTAL, _HOURS = _words("hasta el día"), rf"\({_words('Total de horas sin acceso a la sede:')}{_SPACE}*", rf"{_SPACE}*{_words('horas')}\)"
_MOMENT = rf"\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{4}}{_SPACE}+\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}"
_SECOND = rf"{_MOMENT}:\p{{Nd}}{{2}}"
_SPAN = f"{_SECOND}{_SPACE}+{_UNTIL}{_SPACE}+{_SECOND}"
HEADER_LINE = f"{_LINE}({_words(_OUTAGE)}{_REST_FILLED})"
PERIOD_LINE = rf"{_LINE}({_MOMENT}[^\n]*{_UNTIL}{_SPACE}+{_MOMENT}{_REST_FILLED})"
TOTAL_LINE = rf"{_LINE}{_TOTAL}(\p{{Nd}}{{1,3}}:\p{{Nd}}{{2}}){_HOURS}"
FULL_HEADER_LINE = f"{_LINE}({_FULL_OUTAGE}{_REST_FILLED})"
SPAN_LINE = f"{_LINE}({_SPAN})"
LAST_TOTAL_LINE = rf"{_LINE}(?!{_FULL_OUTAGE}|{_SPAN})[^\n]*?{_TOTAL}(\p{{Nd}}{{1,2}}:\p{{Nd}}{{2}}){_HOURS}"
_JOINER = rf"{_SPACE}+{_UNTIL}{_SPACE}+"


def _every(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _block(header: Column, periods: Column, total: Column) -> Column:
    empty = lambda x: F.coalesce(x, F.lit(""))
    return F.struct(
        empty(header).alias("header"),
        empty(periods).alias("periods"),
        empty(total).alias("total"),
    )


def outage_block(c: Column) -> Column:
    """Struct (header, periods, total): first header, padded period lines, first total.  Each is one scan of the text."""
    c = _unix(c)
    periods = pad_period(F.array_join(_every(c, PERIOD_LINE), "\n"), any_case=False)
    return _block(F.regexp_extract(c, HEADER_LINE, 1), periods, pad_hours(F.regexp_extract(c, TOTAL_LINE, 1)))


def outage_block_strict(c: Column) -> Column:
    """As ``outage_block`` with full header, seconds required and last one wins.

    A line counts once: as a header, else as a period, else as a total.
    """
    c = _unix(c)
    header = F.try_element_at(_every(c, FULL_HEADER_LINE), F.lit(-1))
    lines = F.array_join(_every(c, PERIOD_LINE), "\n")  # a line that begins with a span is a line of a period, and few others are
    periods = F.regexp_replace(F.array_join(_every(lines, SPAN_LINE), "\n"), _JOINER, " hasta el día ")
    return _block(header, pad_date_time(periods), pad_hours(F.try_element_at(_every(c, LAST_TOTAL_LINE), F.lit(-1))))
