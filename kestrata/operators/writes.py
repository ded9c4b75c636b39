"""Last-write-wins state of a log of puts and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE = "put", "delete"


def current(log: DataFrame, key: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The newest entry of each key; keys whose newest entry is a delete are gone.

    row_number = 1 is limited before the shuffle, so a key written often costs
    one row a task.
    """
    w = Window.partitionBy(*key).orderBy(*newest_first)
    live = log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return live.where(F.col("_op") == PUT).drop("_op") if "_op" in log.columns else live


def upsert(rows: DataFrame, puts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows after whole-row puts (one a key): columns that a put lacks are gone from its row."""
    kept = rows.join(puts.select(*key), list(key), "left_anti")
    return kept.unionByName(puts, allowMissingColumns=True)


def delete(rows: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(keys.select(*key), list(key), "left_anti")


def write_columns(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several shapes in one table whose columns grow as they appear."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
