"""A filter of fixed size before a join: rows that can't meet any key of the other side are not shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27  # of a key's place: 16 MB, whatever the number of keys
SLICE_BITS = 18


def _place(columns: list[str]):
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def bitmap(places: DataFrame) -> np.ndarray:
    """Packed bits of the places ``p`` (of ``BITS`` bits) that keys take."""
    rows = places.select("p").distinct().withColumn("s", F.shiftright("p", SLICE_BITS).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SLICE_BITS, bool)
        bits[t.column("p").to_numpy() & ((1 << SLICE_BITS) - 1)] = True
        return pa.table([pa.array([t.column("s")[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["s", "bits"])

    out = np.zeros((1 << (BITS - SLICE_BITS), 1 << (SLICE_BITS - 3)), np.uint8)
    for r in rows.groupBy("s").applyInArrow(pack, "s int, bits binary").collect():  # 16 MB at most
        out[r.s] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def taken(bits: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1


def parted(rows: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that may have a key among ``keys`` (all that have one, and few others), and the rest, each in the columns they came with.

    The filter has a fixed size; with very many keys it lets more rows through, never fewer.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(keys.select(_place(columns).alias("p"))))

    def side(may: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = taken(shared.value, b.column(0).to_numpy())
                yield b.select(b.schema.names[1:]).filter(pa.array(hit == may))

        return rows.select(_place(columns).alias("__place"), "*").mapInArrow(run, rows.schema)

    return side(True), side(False)


def may_join(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    return parted(rows, keys, columns)[0]
