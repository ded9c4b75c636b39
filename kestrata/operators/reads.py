"""Reads over the current rows of a table: points, ranges, pages, prefixes and cursors.

Every function takes a DataFrame of current rows and its TableSpec and returns
a lazy DataFrame; limits become TakeOrderedAndProject, bounds are pushed down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.keys import ASCENDING, equals, from_key, order, shard_of, to_key, with_rank
from ..spec import TableSpec, check_row_key


def _count(n: Any, least: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < least:
        raise ValueError(f"bad count: {n!r}")
    return n


def read(rows: DataFrame, spec: TableSpec, key: Mapping[str, Any]) -> DataFrame:
    return rows.where(equals(spec.key, check_row_key(spec, key)))


MOST_BROADCAST = 100_000  # requested keys
MOST_LISTED = 200  # leading key values that go to the scan as a filter


def read_multi(rows: DataFrame, spec: TableSpec, keys: DataFrame, ordinal: str = "ord") -> DataFrame:
    """A left lookup join: one row for each request, repeats and misses (``found`` false) included.

    Few requests are broadcast against the table and only hits are joined
    back; very few also filter the scan by their leading key values.
    """
    key = list(spec.key)
    hit = rows.withColumn("found", F.lit(True))
    asked = keys.select(*key).limit(MOST_BROADCAST + 1).count()
    if asked <= MOST_BROADCAST:
        if asked <= MOST_LISTED:
            hit = hit.where(F.col(key[0]).isin([r[0] for r in keys.select(key[0]).distinct().collect() if r[0] is not None]))
        hit = hit.join(F.broadcast(keys.select(*key).distinct()), key, "left_semi")
    return keys.join(hit, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def in_range(rows: DataFrame, spec: TableSpec, start: Mapping[str, Any], stop: Mapping[str, Any]) -> DataFrame:
    """The rows from start to stop, both inclusive, in no order."""
    return rows.where(range_bounds(spec, start, stop))


def range_bounds(spec: TableSpec, start: Mapping[str, Any], stop: Mapping[str, Any]) -> Column:
    start, stop = check_row_key(spec, start), check_row_key(spec, stop)
    return from_key(spec.key, start, spec.comparator) & to_key(spec.key, stop, spec.comparator)


def read_range(rows: DataFrame, spec: TableSpec, start: Mapping[str, Any], stop: Mapping[str, Any]) -> DataFrame:
    """From start to stop, both inclusive, in table order (start is the larger key of a descending table)."""
    return in_range(rows, spec, start, stop).orderBy(*order(spec.key, spec.comparator))


read_range_term = read_range


def read_range_page(rows: DataFrame, spec: TableSpec, start: Mapping[str, Any], stop: Mapping[str, Any], chunk: int) -> DataFrame:
    """One page: each shard gives up to ``chunk`` rows; the first unread key of any shard, in table order, cuts the page.

    ``cont_<field>`` name the key where the next page begins, null on the last page.
    """
    _count(chunk, 1)
    key, up = spec.key, spec.comparator == ASCENDING
    start, stop = check_row_key(spec, start), check_row_key(spec, stop)
    sized = rows.where(from_key(key, start, spec.comparator) & to_key(key, stop, spec.comparator)).withColumn("__shard", shard_of(spec.hash_key, spec.num_of_shards))
    # chunk + 1 rows of each shard are enough to know the page and where it ends; the window limits before it shuffles
    head = sized.withColumn("__i", F.row_number().over(Window.partitionBy("__shard").orderBy(*order(key, spec.comparator)))).where(F.col("__i") <= chunk + 1)
    first = (F.min if up else F.max)(F.struct(*key))
    cont = head.where(F.col("__i") == chunk + 1).agg(first.alias("__cont"))
    at = [F.col("__cont")[k] for k in key]
    before = reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [F.col(p) == at[j] for j, p in enumerate(key[:i])] + [(F.col(k) < at[i]) if up else (F.col(k) > at[i])]) for i, k in enumerate(key)],
    )
    page = head.join(F.broadcast(cont), how="left").where(F.col("__cont").isNull() | before)
    names = [c for c in rows.columns]
    return page.orderBy(*order(key, spec.comparator)).select(*names, *[F.col("__cont")[k].alias(f"cont_{k}") for k in key])


def read_range_n(rows: DataFrame, spec: TableSpec, start: Mapping[str, Any], n: int) -> DataFrame:
    """The first n rows at or after start."""
    return rows.where(from_key(spec.key, check_row_key(spec, start), spec.comparator)).orderBy(*order(spec.key, spec.comparator)).limit(_count(n, 0))


def read_range_n_local(rows: DataFrame, spec: TableSpec, start: Mapping[str, Any], n: int, stop: tuple[str, Any] | None = None) -> DataFrame:
    """As read_range_n among the rows that share start's hash key; ``stop`` = (field, value) ends at start with that field replaced."""
    start = check_row_key(spec, start)
    where: Column = equals(spec.hash_key, start) & from_key(spec.key, start, spec.comparator)
    if stop is not None:
        where &= to_key(spec.key, check_row_key(spec, {**start, stop[0]: stop[1]}), spec.comparator)
    if "_shard" in rows.columns:
        where &= F.col("_shard") == shard_of(spec.hash_key, spec.num_of_shards, start, rows.schema)
    return rows.where(where).orderBy(*order(spec.key, spec.comparator)).limit(_count(n, 0))


read_range_n_ts = read_range_n_local


def first(rows: DataFrame, spec: TableSpec) -> DataFrame:
    return rows.orderBy(*order(spec.key, spec.comparator)).limit(1)


def last(rows: DataFrame, spec: TableSpec) -> DataFrame:
    return rows.orderBy(*order(spec.key, spec.comparator, True)).limit(1)


def seek(rows: DataFrame, spec: TableSpec, key: Mapping[str, Any]) -> DataFrame:
    """The row of the key or else the next one in table order."""
    return read_range_n(rows, spec, key, 1)


def after(rows: DataFrame, spec: TableSpec, key: Mapping[str, Any]) -> DataFrame:
    return rows.where(from_key(spec.key, check_row_key(spec, key), spec.comparator, False)).orderBy(*order(spec.key, spec.comparator)).limit(1)


def before(rows: DataFrame, spec: TableSpec, key: Mapping[str, Any]) -> DataFrame:
    return rows.where(to_key(spec.key, check_row_key(spec, key), spec.comparator, False)).orderBy(*order(spec.key, spec.comparator, True)).limit(1)


def neighbours(rows: DataFrame, spec: TableSpec, keys: Sequence[str] | None = None) -> DataFrame:
    """Every row with the keys before and after it among the rows of its hash key, in table order (prev_* and next_*)."""
    w = Window.partitionBy(*spec.hash_key).orderBy(*order(spec.key, spec.comparator))
    rest = [k for k in (keys or spec.key) if k not in spec.hash_key]
    out = rows
    for k in rest:
        out = out.withColumn(f"prev_{k}", F.lag(k).over(w)).withColumn(f"next_{k}", F.lead(k).over(w))
    return out


def neighbours_all(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Every row with its place in table order (``rn``) and the keys before and after it (prev_* and next_*), as a cursor moves over the whole table.

    Places come from ``with_rank``; neighbours meet by place in two joins, so no task holds the table.
    """
    placed = with_rank(rows, spec.key, spec.comparator)
    out = placed
    for side, shift in (("prev", 1), ("next", -1)):
        out = out.join(placed.select((F.col("rn") + shift).alias("rn"), *[F.col(k).alias(f"{side}_{k}") for k in spec.key]), "rn", "left")
    return out
