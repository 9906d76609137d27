"""Arrow batches in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of the batches that a session sends to Python workers, about.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_BYTES`` unless they are smaller already, so that neither the JVM nor a Python worker holds
    thousands of whole texts at once. It is set for good, as the plan runs when its rows are asked for."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order, with at most ``most`` bytes (or list entries) of a column and ``rows`` rows each (a
    row at least), so that memory stays bounded however uneven the texts are."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield batch.slice(start, end - start)
        start = end
