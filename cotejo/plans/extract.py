"""Extract assembly: distinct tickets, request batches, union, text clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import only_alphanumeric
from cotejo.operators.batches import BATCH_SIZE, batch_requests, key_batches
from cotejo.operators.findings import union_all
from cotejo.operators.scans import SLICE_ROWS

GENERAL_REPORT = 4  # Fixed value: the report whose narratives are cleaned.
CLEANED = ("remedyobs", "it_medidas_tomadas")


def requests(
    tickets: DataFrame, key: str, order: str, size: int = BATCH_SIZE, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One request text per batch of distinct tickets."""
    return batch_requests(key_batches(tickets, key, order, size, slice_rows), key)


def assemble(parts: Sequence[DataFrame], report: int) -> DataFrame:
    """Union of the returned batches; the general report loses special characters."""
    df = union_all(parts)
    if report == GENERAL_REPORT:
        df = df.withColumns({c: only_alphanumeric(F.col(c)) for c in CLEANED})
    return df
