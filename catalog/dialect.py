"""The few SQL spellings that differ between Spark and the checking engine."""

from __future__ import annotations


class Spark:
    name = "spark"

    @staticmethod
    def text(x: str) -> str:
        return f"cast({x} as string)"

    @staticmethod
    def plus_seconds(ts: str, n: str) -> str:
        return f"({ts} + make_dt_interval(0, 0, 0, cast({n} as decimal(18,6))))"

    @staticmethod
    def minute_text(ts: str) -> str:
        return f"date_format({ts}, 'dd/MM/yyyy HH:mm')"

    @staticmethod
    def second_text(ts: str) -> str:
        return f"date_format({ts}, 'dd/MM/yyyy HH:mm:ss')"

    @staticmethod
    def loose_text(ts: str) -> str:
        return f"date_format({ts}, 'd/M/yyyy H:mm:ss')"

    @staticmethod
    def loose_minute_text(ts: str) -> str:
        return f"date_format({ts}, 'dd/MM/yyyy H:mm')"

    @staticmethod
    def hhmm(minutes: str) -> str:
        return f"format_string('%02d:%02d', cast(({minutes}) div 60 as bigint), cast(({minutes}) % 60 as bigint))"

    @staticmethod
    def div(a: str, b: int) -> str:
        return f"(({a}) div {b})"

    @staticmethod
    def ntz(ts: str) -> str:
        return f"cast({ts} as timestamp_ntz)"

    newline = "'\\n'"


class Duck(Spark):
    name = "duck"

    @staticmethod
    def text(x: str) -> str:
        return f"cast({x} as varchar)"

    @staticmethod
    def plus_seconds(ts: str, n: str) -> str:
        return f"({ts} + to_seconds({n}))"

    @staticmethod
    def minute_text(ts: str) -> str:
        return f"strftime({ts}, '%d/%m/%Y %H:%M')"

    @staticmethod
    def second_text(ts: str) -> str:
        return f"strftime({ts}, '%d/%m/%Y %H:%M:%S')"

    @staticmethod
    def loose_text(ts: str) -> str:
        return f"strftime({ts}, '%-d/%-m/%Y %-H:%M:%S')"

    @staticmethod
    def loose_minute_text(ts: str) -> str:
        return f"strftime({ts}, '%d/%m/%Y %-H:%M')"

    @staticmethod
    def hhmm(minutes: str) -> str:
        return f"printf('%02d:%02d', cast(({minutes}) // 60 as bigint), cast(({minutes}) % 60 as bigint))"

    @staticmethod
    def div(a: str, b: int) -> str:
        return f"(({a}) // {b})"

    @staticmethod
    def ntz(ts: str) -> str:
        return f"cast({ts} as timestamp)"

    newline = "chr(10)"
