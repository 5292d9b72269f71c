"""Rosters landed as cells ``(sheet, row, col, value)``, without header or schema.

Row 0 holds the day labels.  The n-th label owns one shift column, at a fixed
stride from the first; names sit in one column of the body rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.text import let, shift_start
from cotejo.functions.times import date_in_label
from cotejo.functions.unicode import strip_marks
from cotejo.operators.joins import DEALT

# Layout of the two rosters.
DESK = {"name_col": 0, "first_col": 3, "stride": 2}
GENERAL = {"name_col": 1, "first_col": 2, "stride": 3}
DESK_BODY_ROW = 2
LABEL_ROWS = ("Turno", "Personal FO/BO")


@dataclass(frozen=True)
class Layout:
    """Where a roster has its names and shifts; without ``body_row`` its body begins below the first gap in column 0."""

    name_col: int
    first_col: int
    stride: int
    body_row: int | None = None
    exclude: tuple[str, ...] = ()


#: The two rosters, by the names that attendance gives them.
LAYOUTS = {"Mesa": Layout(**DESK, body_row=DESK_BODY_ROW), "General": Layout(**GENERAL, exclude=LABEL_ROWS)}
#: Rows of a sheet whose filled cells of column 0 are looked at together.
GAP_ROWS = 1 << 16


def body_start(cells: DataFrame) -> DataFrame:
    """Per sheet: two rows below the first gap in column 0, or row 0 without a gap.

    The gap is found by joining each filled row to the next row, so no sheet is
    gathered in one place.
    """
    filled = cells.where("col = 0 and value is not null").select("sheet", "row").distinct()
    last = cells.groupBy("sheet").agg(F.max("row").alias("_last"))
    gaps = (
        filled.select("sheet", (F.col("row") + 1).alias("row"))
        .join(filled.hint(DEALT), ["sheet", "row"], "left_anti")
        .groupBy("sheet")
        .agg(F.min("row").alias("_gap"))
    )
    return last.join(gaps.hint(DEALT), "sheet", "left").select(
        "sheet",
        F.when(F.col("_gap") <= F.col("_last"), F.col("_gap") + 2).otherwise(F.lit(0)).alias("body_row"),
    )


def unpivot(
    cells: DataFrame,
    name_col: int,
    first_col: int,
    stride: int,
    body: DataFrame | int,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """(sheet, row, day, label, name, shift): one row per name, day and filled shift.

    Label numbering is a window per sheet over its header row, which is as wide
    as a sheet, not as long.  Labels and body rows are joined by dealing both sides: cells come from
    an explode, and of two sides that both look small Spark may broadcast the longer one.
    """
    filled = cells.where(F.col("value").isNotNull())
    across = Window.partitionBy("sheet").orderBy("col")
    days = (
        filled.where((F.col("row") == 0) & (F.col("col") >= first_col))
        .withColumn("day", F.row_number().over(across) - 1)
        .select("sheet", "day", F.col("value").alias("label"), (F.lit(first_col) + F.col("day") * stride).alias("col"))
    )
    names = filled.where(F.col("col") == name_col).select("sheet", "row", F.col("value").alias("name"))
    if exclude:
        names = names.where(~F.col("name").isin(*exclude))
    if isinstance(body, int):
        names = names.where(F.col("row") >= body)
    else:
        names = names.join(body.hint(DEALT), "sheet").where("row >= body_row").drop("body_row")
    shifts = filled.select("sheet", "row", "col", F.col("value").alias("shift")).join(days.hint(DEALT), ["sheet", "col"])
    return shifts.join(names.hint(DEALT), ["sheet", "row"]).select("sheet", "row", "day", "label", "name", "shift")


def _tops(cells: DataFrame, first: Column, wanted: Callable[[Callable[[Layout], object]], Column]) -> DataFrame:
    """(roster, sheet, labels, body_row) from one pass over the cells.

    A slice of a sheet's rows tells its day labels, its last row, and the first and last filled row of column 0 with the
    first gap between; a sheet's slices then tell the first gap of all.
    """
    filled = F.when((F.col("col") == 0) & F.col("value").isNotNull(), F.col("row"))
    label = F.when((F.col("row") == 0) & (F.col("col") >= first) & F.col("value").isNotNull(), F.struct("col", "value"))
    slices = cells.groupBy("roster", "sheet", F.floor(F.col("row") / GAP_ROWS).alias("_slice")).agg(
        F.max("row").alias("_last"), F.collect_list(label).alias("_labels"), F.array_sort(F.collect_set(filled)).alias("_filled")
    )
    gap = lambda a: F.array_min(F.transform(a, lambda r, i: F.when(F.get(a, i + 1) != r + 1, r + 1)))
    part = let(F.col("_filled"), lambda a: F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"), gap(a).alias("gap")))
    sheets = slices.withColumn("_part", F.when(F.size("_filled") > 0, part)).groupBy("roster", "sheet").agg(
        F.max("_last").alias("_last"),
        F.transform(F.array_sort(F.flatten(F.collect_list("_labels"))), lambda x: x["value"]).alias("labels"),
        F.array_sort(F.collect_list("_part")).alias("_parts"),
    )

    def first_gap(parts: Column) -> Column:
        after = lambda p, i: F.when(~F.coalesce(F.get(parts, i + 1)["lo"] == p["hi"] + 1, F.lit(False)), p["hi"] + 1)
        return F.array_min(F.transform(parts, lambda p, i: F.coalesce(p["gap"], after(p, i))))

    sheets = sheets.withColumn("_gap", let(F.col("_parts"), first_gap))
    below = F.when(F.col("_gap") <= F.col("_last"), F.col("_gap") + 2).otherwise(F.lit(0))
    given = wanted(lambda x: x.body_row)
    return sheets.select("roster", "sheet", "labels", F.coalesce(given, below).alias("body_row"))


def unpivot_layouts(cells: DataFrame, layouts: Mapping[str, Layout] = LAYOUTS) -> DataFrame:
    """``(roster, sheet, row, col, value)`` of several rosters to (roster, sheet, row, day, label, name, shift).

    As ``unpivot``, for all rosters together: the cells are read twice, once for the tops of the sheets
    and once for the rows, which are put together as wide as a sheet and joined with the tops.
    """

    def wanted(of: Callable[[Layout], object]) -> Column:
        out = F.lit(None)
        for name, layout in layouts.items():
            out = F.when(F.col("roster") == name, F.lit(of(layout))).otherwise(out)
        return out

    cells = cells.where(F.col("roster").isin(*layouts))
    first, stride = wanted(lambda x: x.first_col), wanted(lambda x: x.stride)
    tops = _tops(cells, first, wanted)
    shift = F.when((F.col("col") >= first) & F.col("value").isNotNull(), F.struct("col", F.col("value").alias("shift")))
    rows = cells.groupBy("roster", "sheet", "row").agg(
        F.max(F.when(F.col("col") == wanted(lambda x: x.name_col), F.col("value"))).alias("name"), F.collect_list(shift).alias("shifts")
    )
    excluded = F.lit(False)
    for name, layout in layouts.items():
        if layout.exclude:
            excluded = excluded | ((F.col("roster") == name) & F.col("name").isin(*layout.exclude))
    rows = rows.where(F.col("name").isNotNull() & ~excluded).join(tops, ["roster", "sheet"]).where("row >= body_row")
    each = rows.select("roster", "sheet", "row", "name", "labels", F.explode("shifts").alias("s"))
    at = F.col("s.col") - first
    each = each.where(at % stride == 0).withColumn("day", (at / stride).cast("int"))
    each = each.withColumn("label", F.get("labels", F.col("day"))).where(F.col("day") < F.size("labels"))
    return each.select("roster", "sheet", "row", "day", "label", "name", F.col("s.shift").alias("shift"))


def roster_rows(unpivoted: DataFrame, user: Column | None = None) -> DataFrame:
    """Date from the label, upper-case unaccented user, shift and its start."""
    name = F.upper(F.col("name")) if user is None else user
    return unpivoted.select(
        *[c for c in ("roster",) if c in unpivoted.columns],
        "sheet",
        "row",
        "day",
        date_in_label(F.col("label")).alias("date"),
        strip_marks(name).alias("user"),
        "shift",
        shift_start(F.col("shift")).alias("shift_start"),
    )
