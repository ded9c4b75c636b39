"""Order and bounds of compound keys as plain column predicates.

Bounds are written out as ORs of ANDs over the key columns, with the leading
bound repeated as a conjunct: that form reaches the Parquet scan as pushed
filters, which a comparison of structs does not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ASCENDING, DESCENDING = "ascending", "descending"


def order(key: Sequence[str], comparator: str, reverse: bool = False) -> list[Column]:
    """Sort order of a table; ``reverse`` gives the opposite one."""
    up = (comparator == ASCENDING) != reverse
    return [F.col(k).asc() if up else F.col(k).desc() for k in key]


def _beyond(key: Sequence[str], at: Mapping[str, Any], up: bool, inclusive: bool) -> Column:
    terms = []
    for i, k in enumerate(key):
        last = i == len(key) - 1
        c, v = F.col(k), F.lit(at[k])
        edge = (c >= v if up else c <= v) if last and inclusive else (c > v if up else c < v)
        terms.append(reduce(lambda a, b: a & b, [F.col(p) == F.lit(at[p]) for p in key[:i]] + [edge]))
    whole = reduce(lambda a, b: a | b, terms)
    if len(key) == 1:
        return whole
    lead = F.col(key[0])
    return (lead >= F.lit(at[key[0]]) if up else lead <= F.lit(at[key[0]])) & whole


def from_key(key: Sequence[str], at: Mapping[str, Any], comparator: str, inclusive: bool = True) -> Column:
    """Rows at or after ``at`` in table order."""
    return _beyond(key, at, comparator == ASCENDING, inclusive)


def to_key(key: Sequence[str], at: Mapping[str, Any], comparator: str, inclusive: bool = True) -> Column:
    """Rows at or before ``at`` in table order."""
    return _beyond(key, at, comparator != ASCENDING, inclusive)


def equals(fields: Sequence[str], at: Mapping[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(at[k]) for k in fields], F.lit(True))


def shard_of(fields: Sequence[str], shards: int, values: Mapping[str, Any] | None = None, schema: StructType | None = None) -> Column:
    """Shard number: the leading 32 bits of the SHA-256 of the hash key, modulo the shards.

    Of ``values`` it is a constant, as the column types of ``schema`` would have it.
    """
    given = {f: F.lit(values[f]).cast(schema[f].dataType) if schema is not None else F.lit(values[f]) for f in fields} if values is not None else {}
    parts = [given.get(f, F.col(f)).cast("string") if given else F.col(f).cast("string") for f in fields]
    digest = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % shards).cast("int")


ROWS_PER_BUCKET = 250_000
MOST_BUCKETS = 512


def with_rank(df: DataFrame, key: Sequence[str], comparator: str, name: str = "rn", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows with their place in table order from 1, without a single-task sort of more than a bucket.

    Bounds taken from a sample of whole keys (of least hash, any type) part the
    rows into buckets by size; counts of the buckets give where each begins,
    and a window ranks inside a bucket only.
    """
    up = comparator == ASCENDING
    by = Window.orderBy(*order(key, comparator))
    n = df.count()
    buckets = min(MOST_BUCKETS, -(-n // rows_per_bucket))
    if buckets <= 1:
        return df.withColumn(name, F.row_number().over(by).cast("long"))
    at = F.struct(*key)
    sample = df.select(at.alias("k")).orderBy(F.xxhash64(*key)).limit(32 * buckets)
    bounds = sample.orderBy("k").agg(F.sort_array(F.collect_set("k")).alias("s")).select(F.expr(f"transform(sequence(1, {buckets - 1}), i -> s[cast(i * size(s) div {buckets} as int)])").alias("__bounds"))
    # how many bounds a row is at or beyond, by halving steps: a handful of comparisons a row, however many buckets
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    beyond = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("__bounds", n + step - 1) <= at, n + step).otherwise(n))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn("__bucket", beyond).drop("__bounds")  # one row of bounds
    placed = placed.withColumn("__bucket", F.col("__bucket") if up else -F.col("__bucket"))
    counts = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order(key, comparator)))
    return placed.withColumn("__i", inside).join(F.broadcast(counts), "__bucket").withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__bucket", "__before", "__i")
