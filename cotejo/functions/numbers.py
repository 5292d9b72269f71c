"""Numbers, comparisons and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the hour bands.
BANDS = ("Menor a 1h", "Entre 1h a 4h", "Entre 4h a 8h", "Entre 8h a 24h", "Mayor a 24h")


def number_or_zero(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(n)


def holds(condition: Column) -> Column:
    """A check over missing values does not hold."""
    return F.coalesce(condition, F.lit(False))


def same(a: Column, b: Column) -> Column:
    return holds(a == b)


def not_negative(c: Column) -> Column:
    return holds(c >= 0)


def within(a: Column, b: Column, tolerance: float = 1) -> Column:
    return holds(F.abs(a - b) <= tolerance)


def hour_band(hours: Column) -> Column:
    return (
        F.when(hours == 0, BANDS[0])
        .when(hours.isin(1, 2, 3), BANDS[1])
        .when(hours.isin(4, 5, 6, 7), BANDS[2])
        .when(hours.between(8, 23), BANDS[3])
        .otherwise(BANDS[4])
    )


def fail_count(*checks: Column) -> Column:
    total = F.lit(0)
    for ok in checks:
        total = total + (~holds(ok)).cast("int")
    return total


def fill_by_type(df: DataFrame, text: str = "", real: float = 0.0) -> DataFrame:
    """Text and real columns lose their nulls; times and integers keep them."""
    fill = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            fill[f.name] = text
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            fill[f.name] = real
    return df.fillna(fill) if fill else df
