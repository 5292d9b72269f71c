"""Reconciling joins.

No join carries a broadcast hint, and joins of reports with one another ask for a sort-merge join: a
file's size says little about its rows once they are built, and a side broadcast for its small file is collected
by the driver.  Lookup tables are joined plainly, and Spark splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The join whose sides are both dealt by the key and sorted, whatever their estimated size.
DEALT = "merge"
#: In a mark join: whether a row stands beside a right row, or for its left row alone.
PAIRED = "_paired"


def suffix_overlap(df: DataFrame, other: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Rename the columns that ``other`` also has, apart from the keys."""
    clash = set(other.columns) - set(on)
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in clash})


def matched(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    suffixes: tuple[str, str] = ("_left", "_right"),
) -> DataFrame:
    """Rows present on both sides; clashing names get the suffixes."""
    a = suffix_overlap(left, right, on, suffixes[0])
    b = suffix_overlap(right, left, on, suffixes[1])
    return a.join(b.hint(DEALT), list(on), "inner")


def only_left(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).hint(DEALT), list(on), "left_anti")


def only_right(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return only_left(right, left, on)


def enrich(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    defaults: Mapping[str, object] | None = None,
    suffixes: tuple[str, str] = ("_left", "_right"),
    dealt: Sequence[str] | None = None,
) -> DataFrame:
    """Every left row, with right columns where found and ``defaults`` where not; ``dealt`` as in ``beside``."""
    a = suffix_overlap(left, right, on, suffixes[0])
    b = suffix_overlap(right, left, on, suffixes[1])
    out = beside(a, b, on, on if dealt is None else dealt)
    return out.fillna(dict(defaults)) if defaults else out


def alike(a: Column, b: Column) -> Column:
    """Equality that is judged on pairs of rows, and not made a key of the join."""
    return (a >= b) & (a <= b)


def beside(left: DataFrame, right: DataFrame, on: Sequence[str], dealt: Sequence[str]) -> DataFrame:
    """Left join on ``on``, whose rows are dealt by the keys of ``dealt`` only, so that wide rows already dealt by these stay where they are.

    For further keys that tell apart the few right rows of a dealt key.
    """
    others = [k for k in on if k not in dealt]
    if not others:
        return left.join(right.hint(DEALT), list(on), "left")
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same = [left[k] == named[f"_right_{k}"] for k in dealt] + [alike(left[k], named[f"_right_{k}"]) for k in others]
    return left.join(named.hint(DEALT), same, "left").drop(*[f"_right_{k}" for k in on])


def mark_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    marks: Mapping[str, Column],
    dealt: Sequence[str] | None = None,
    once: tuple[Sequence[str], Column] | None = None,
) -> DataFrame:
    """Every left row once for itself, and once more beside each right row of its key: one left join.

    ``PAIRED`` tells the two apart.  The row that stands for itself bears the ``marks``,
    aggregates over all right rows of its key, which are null where the key has none; so inner, anti and marked
    results of several rule sets come from one pass over one join.  The marks are counted before their shuffle;
    a key that both sides repeat fans out, as in any join.  ``dealt`` as in ``beside``.

    ``once`` is the columns beside ``on`` that must tell the right rows of a key apart, and what is raised where they do not (null
    for rows that may repeat).  It is asked of the keys that are counted for the marks, so no right row is dealt for it; the marks
    may then use these columns only.
    """
    counted = right
    if once:
        columns, message = once
        each = right.groupBy(*on, *columns).agg(F.count("*").alias("_rows"))
        counted = each.where(F.when((F.col("_rows") > 1) & message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
    told = counted.groupBy(*on).agg(*[m.alias(n) for n, m in marks.items()]).withColumn(PAIRED, F.lit(False))
    both = right.withColumn(PAIRED, F.lit(True)).unionByName(told, allowMissingColumns=True)
    return beside(left, both, on, on if dealt is None else dealt).withColumn(PAIRED, F.coalesce(PAIRED, F.lit(False)))


def lookup(left: DataFrame, table: DataFrame, on: str, as_text: bool = False) -> DataFrame:
    """Left join with a lookup table, optionally comparing the key as text."""
    if as_text:
        left = left.withColumn(on, F.col(on).cast("string"))
        table = table.withColumn(on, F.col(on).cast("string"))
    return left.join(table, on, "left")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cardinality(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``n_rows``, ``n_keys``, ``n_repeated`` keys, and ``most`` rows of one key.

    Counted before the shuffle; missing keys are equal.
    """
    counted = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return counted.agg(
        whole(F.sum("n")).alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.count(F.when(F.col("n") > 1, True)).alias("n_repeated"),
        whole(F.max("n")).alias("most"),
    )


def _key_text(keys: Sequence[str] | Mapping[str, str]) -> Column:
    shown = keys if isinstance(keys, Mapping) else {k: k for k in keys}
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for k, c in shown.items()])


def repeated(name: str | Column, keys: Sequence[str] | Mapping[str, str]) -> Column:
    """What is raised for a key that occurs twice; ``keys`` may map the names to show to those that columns have by now."""
    return F.concat(F.lit(name) if isinstance(name, str) else name, F.lit(": more than one row for "), _key_text(keys))


def unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df``, whose plan raises when its rows are made and a key occurs twice; missing keys are equal.

    For the side of any join that must have one row a key.  Rows are numbered inside their key by the shuffle
    and sort that the join needs anyway, row by row, and the keys pass unchanged, so
    the join adds no shuffle of its own and no second job counts.
    """
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    again = F.raise_error(repeated(name, keys)).cast("boolean")
    return df.withColumn("_turn", turn).where(F.when(F.col("_turn") > 1, again).otherwise(True)).drop("_turn")


def unique_beside(df: DataFrame, keys: Sequence[str], name: str, asked: Column) -> DataFrame:
    """As ``unique`` for the ``asked`` rows of wide ones, and all others as they are.

    The keys are counted by themselves, and stand beside the rows where a left join by the same keys deals them
    anyway; so the rows are dealt once, where numbering a part of them would deal that part twice.
    """
    told = df.where(asked).groupBy(*keys).agg(F.count("*").alias("_rows"))
    again = F.raise_error(repeated(name, keys)).cast("boolean")
    out = df.join(told.hint(DEALT), list(keys), "left")
    return out.where(F.when(F.col("_rows") > 1, again).otherwise(True)).select(*[out[c] for c in df.columns])


def spine(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys over all frames."""
    out = None
    for df in frames:
        part = df.select(*keys).distinct()
        out = part if out is None else out.union(part)
    return out.distinct()


def gathered(tagged: DataFrame, keys: Sequence[str], sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per key of ``tagged`` with the columns of all sources; missing keys are equal.

    ``tagged`` has the keys and, per source, a struct column of its name, null on the rows of the others.
    One grouping puts them together and counts: a source with two rows for a key raises when the rows are made.
    """
    found = tagged.groupBy(*keys).agg(
        *[F.first(n, ignorenulls=True).alias(n) for n in sources],
        *[F.count(n).alias(f"_n_{n}") for n in sources],
    )
    checked = F.col(keys[0])
    for n in sources:
        again = F.raise_error(F.concat(F.lit(f"{n}: more than one row for "), _key_text(keys)))
        checked = F.when(F.col(f"_n_{n}") > 1, again).otherwise(checked)
    values = [F.col(n)[c].alias(c) for n, columns in sources.items() for c in columns]
    return found.select(checked.alias(keys[0]), *keys[1:], *values)


def tagged_source(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys and the other columns as one struct, for ``gathered``."""
    return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))


def join_on_spine(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Every key of any frame with the columns of all of them; missing keys are equal.

    Every frame but the last must be unique on the keys.  These are put together by one
    grouping, which also counts: a repeated key raises when the rows are made.
    """
    *single, last = frames
    both = frames[last].select(*keys)
    for n in single:
        both = both.unionByName(tagged_source(frames[n], keys, n), allowMissingColumns=True)
    out = gathered(both, keys, {n: [c for c in frames[n].columns if c not in keys] for n in single})
    other = frames[last].withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [out[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return out.join(other.hint(DEALT), same, "left").drop(*[f"_{k}" for k in keys])
