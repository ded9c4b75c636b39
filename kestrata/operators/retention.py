"""Retention by age and size, and sizes and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(rows: DataFrame, written: str, ttl_seconds: int, as_of: Column) -> DataFrame:
    """Rows written less than ``ttl_seconds`` before ``as_of``."""
    return rows.where(F.col(written) > as_of - F.expr(f"interval {int(ttl_seconds)} seconds"))


def fifo(rows: DataFrame, shard: Column, newest_first: Sequence[Column], size: Column, budget: int, shards: int, place: Column) -> DataFrame:
    """The newest rows of each shard within its share of a byte budget.

    ``place`` is an integer that rises with age's opposite and comes first in
    the order: sums of places tell where the budget ends, and only the rows of
    that one place are summed row by row.
    """
    own = rows.withColumns({"__shard": shard, "__place": place.cast("long"), "__size": size.cast("long")})
    sums = own.groupBy("__shard", "__place").agg(F.sum("__size").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__shard").orderBy(F.desc("__place"))) - F.col("__n")
    share = budget // shards
    sums = sums.withColumn("__before", before).where(F.col("__before") < share).withColumn("__whole", F.col("__before") + F.col("__n") <= share)
    met = own.join(sums.drop("__n"), ["__shard", "__place"])
    w = Window.partitionBy("__shard", "__place").orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    part = met.where(~F.col("__whole")).withColumn("__held", F.col("__before") + F.sum("__size").over(w)).where(F.col("__held") <= share).drop("__held")
    return met.where("__whole").unionByName(part).drop("__shard", "__place", "__size", "__before", "__whole")


def shard_counts(rows: DataFrame, shard: Column, name: str = "shard") -> DataFrame:
    return rows.groupBy(shard.alias(name)).agg(F.count("*").cast("long").alias("n"))


def num_keys(rows: DataFrame, key: Sequence[str], approximate: bool = False) -> DataFrame:
    n = F.approx_count_distinct(F.struct(*key)) if approximate else F.count_distinct(*key)
    return rows.agg(n.cast("long").alias("num_keys"))
