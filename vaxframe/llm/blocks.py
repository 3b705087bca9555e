"""Sums of fixed-size arrays that tasks fill: each task emits its array in blocks, which are added in two steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial arrays are first added within lanes, so that no group holds more than tasks / LANES blocks.
LANES = 64


def to_rows(values: np.ndarray, block: int) -> pa.Table:
    """Rows (block, counts) of a long array whose length is a multiple of ``block``."""
    parts = values.astype(np.int64).reshape(-1, block)
    return pa.table({"block": pa.array(np.arange(len(parts))), "counts": pa.array([x.tobytes() for x in parts], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    parts = table.column("counts")
    total = np.frombuffer(parts[0].as_buffer(), np.int64).copy()
    for part in parts[1:]:
        total += np.frombuffer(part.as_buffer(), np.int64)
    return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def total(rows: DataFrame, length: int) -> np.ndarray:
    """The sum of all arrays of (block, counts); its length is a fixed parameter, so it fits the driver at any input size."""
    schema = "block long, counts binary"
    lanes = rows.select("block", "counts", (F.spark_partition_id() % LANES).alias("lane"))
    out = np.zeros(length, np.int64)
    for block, counts in lanes.groupBy("block", "lane").applyInArrow(_added, schema).groupBy("block").applyInArrow(_added, schema).toLocalIterator():
        part = np.frombuffer(counts, np.int64)
        out[block * len(part) : (block + 1) * len(part)] = part
    return out
