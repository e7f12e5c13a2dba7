"""Which slots the hashes in a column use: a test before a join, of a size that follows the column up to a bound.

A hash whose slot is free isn't in the column; one whose slot is taken may be,
and a join decides. If a bitmap fills up, more rows than needed reach the join,
but none is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm._text import U64, mix

SLICES = 16


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("bits")])
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})


def sized(rows: DataFrame, column: str, count: int, most: int = 28) -> np.ndarray:
    """A bitmap with eight slots for each of `count` hashes, of 128 kB to 32 MB; when it can't grow, more rows pass."""
    bits = 1 << int(np.clip((8 * max(count, 1) - 1).bit_length(), 20, most))

    def mark(batches):
        out = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            at = (mix(b.column(0).to_numpy().view(U64)) & U64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        each = len(out) // SLICES
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([out[s * each : (s + 1) * each].tobytes() for s in range(SLICES)], pa.binary())], names=["slice", "bits"])

    got = rows.select(column).mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(_merge, "slice int, bits binary").collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in got:
        out[r["slice"] * (len(out) // SLICES) : (r["slice"] + 1) * (len(out) // SLICES)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def has(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (mix(h.view(U64)) & U64(len(packed) * 8 - 1)).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
