"""Arrays of integers as compressed binary values, and ranks without a global sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import free_name, shuffle_width


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers in the narrowest type that holds them; ``rising``: as differences."""
    values = np.asarray(values, np.int64)
    if rising and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    top = int(np.abs(values).max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    raw = values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()  # first all low bytes: they compress better apart
    return bytes([np.dtype(kind).itemsize, rising]) + len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """int64 values of ``pack``."""
    raw = pa.Codec("zstd").decompress(data[10:], int.from_bytes(data[2:10], "little"), asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(data[0], -1).T).view(f"<i{data[0]}").ravel().astype(np.int64)
    return np.cumsum(values) if data[1] else values


def joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All values of some packed arrays, and the sizes of the arrays."""
    arrays = [unpack(b) for b in blobs]
    return np.concatenate([*arrays, np.zeros(0, np.int64)]), np.fromiter(map(len, arrays), np.int64, len(arrays))


def ranked(rows: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """``rows``, written, with their places in ``order`` from 0 on: sorted by ranges, whose sizes are added up."""
    taken, at = free_name(rows, "taken_"), free_name(rows, "at_")
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count("*").alias("size_"))
    # One row per range: few, whatever the rows.
    before = F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("part_", F.coalesce(before, F.lit(0)).alias(taken))
    found = placed.withColumn("part_", part).join(F.broadcast(first), "part_")
    return found.select(*rows.columns, (F.col(taken) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
