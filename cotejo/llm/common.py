"""Helpers shared by the operators: column expressions and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"
#: Stands for a missing doc_id where a key must not be null; it sorts before all others.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def appended(items: Column, at: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 256) -> Column:
    """Struct (at, out) of a left fold that carries a number and appends: ``step(at, x)`` gives the new number and an array of ``kind``.

    Appending copies what is there already, so items are folded in blocks and the blocks put
    together at the end: the cost of a long array is its length times ``block``, not its square.
    """
    one, all_ = (F.array().cast(t) for t in (f"array<{kind}>", f"array<array<{kind}>>"))

    def inside(state: Column, x: Column) -> Column:
        number, more = step(state["at"], x)
        return F.struct(number.alias("at"), F.concat(state["out"], more).alias("out"))

    def over(state: Column, b: Column) -> Column:
        part = F.aggregate(F.slice(items, b * block + 1, F.lit(block)), F.struct(state["at"].alias("at"), one.alias("out")), inside)
        return let(part, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    blocks = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(at.alias("at"), all_.alias("out")), over, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))


#: Characters of a chunk of a text that is cut at many places.
CHUNK = 4096


def chunks(text: Column) -> Column:
    """The text in chunks of CHUNK characters, so that a place in it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(cut: Column, a: Column, b: Column) -> Column:
    """Characters from ``a`` up to ``b`` (from 0, end exclusive) of a text in chunks."""

    def parts(i: Column, j: Column) -> Column:
        inside = F.get(cut, i).substr(a % CHUNK + 1, b - a)
        middle = F.array_join(F.slice(cut, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        across = F.concat(F.get(cut, i).substr(a % CHUNK + 1, F.lit(CHUNK)), middle, F.get(cut, j).substr(F.lit(1), b - j * CHUNK))
        return F.when(b <= a, F.lit("")).when(i == j, inside).otherwise(across)

    return let(F.struct(F.floor(a / CHUNK).cast("int").alias("i"), F.floor((b - 1) / CHUNK).cast("int").alias("j")), lambda x: parts(x["i"], x["j"]))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local master gets a folder of its own; any other
    master raises, as its machines would not see such a folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="cotejo-llm-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    What follows starts from files that outlive any executor.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
