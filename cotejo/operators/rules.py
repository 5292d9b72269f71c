"""Rules as data: named checks with messages, evaluated in one pass.

A rule fails a row when any of its checks does not hold.  All rules of a set
become one array expression over the row, so the rows are read once however
many rules there are, and only failing rows leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.numbers import fail_count, holds

MASK_BITS = 60


@dataclass(frozen=True)
class Check:
    """``ok`` must hold; ``message`` is added to the finding when it does not."""

    name: str
    ok: Column
    message: Column


@dataclass(frozen=True)
class Rule:
    """Checks under one code.  ``seq`` orders findings; ``when`` limits the rows."""

    code: str
    seq: int | Column
    checks: Sequence[Check]
    when: Column | None = None

    def passed(self) -> Column:
        ok = F.lit(True)
        for c in self.checks:
            ok = ok & holds(c.ok)
        return ok if self.when is None else ~holds(self.when) | ok

    def failures(self) -> Column:
        return fail_count(*[c.ok for c in self.checks])


def flag(df: DataFrame, rule: Rule) -> DataFrame:
    """One boolean column per check, ``validation_ok`` and ``fail_count``."""
    flags = {c.name: holds(c.ok) for c in rule.checks}
    return df.withColumns({**flags, "validation_ok": rule.passed(), "fail_count": rule.failures()})


def evaluate(
    df: DataFrame,
    rules: Sequence[Rule],
    key: str = "nro_incidencia",
    kind: str = "tipo_reporte",
    row: Column | None = None,
) -> DataFrame:
    """Findings in long form: key, mensaje, objetivo, TIPO REPORTE, seq, row.

    ``row`` is the place of the input row, used to order findings of one rule.
    """
    checks = [c for r in rules for c in r.checks]
    place = (F.lit(0) if row is None else row).cast("bigint")
    # Every check is worked out once, as a bit, on the rows of its rule; outcomes and messages read the bits.
    masks, passed = {}, {}
    limits = [r.when for r in rules for _ in r.checks]
    for i, c in enumerate(checks):
        name, bit = f"_failed{i // MASK_BITS}", 1 << (i % MASK_BITS)
        failed = ~holds(c.ok) if limits[i] is None else holds(limits[i]) & ~holds(c.ok)
        term = F.when(failed, F.lit(bit)).otherwise(F.lit(0)).cast("bigint")
        masks[name] = masks[name] + term if name in masks else term
        passed[id(c)] = F.col(name).bitwiseAND(F.lit(bit).cast("bigint")) == 0
    df = df.withColumns({"_row": place, **masks})

    def finding(r: Rule) -> Column:
        ok = F.lit(True)
        for c in r.checks:
            ok = ok & passed[id(c)]
        failed = ~ok
        message = F.concat(*[F.when(passed[id(c)], F.lit("")).otherwise(c.message) for c in r.checks])
        return F.when(
            failed,
            F.struct(
                message.alias("mensaje"),
                F.lit(r.code).alias("objetivo"),
                F.lit(r.seq).cast("int").alias("seq"),
            ),
        )

    found = F.array(*[finding(r) for r in rules])
    return (
        df.select(F.col(key), F.col(kind).alias("TIPO REPORTE"), F.col("_row").alias("row"), F.explode(found).alias("_f"))
        .where(F.col("_f").isNotNull())
        .select(key, "_f.mensaje", "_f.objetivo", "TIPO REPORTE", "_f.seq", "row")
    )
