"""Merging and sorting of keyed lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.keys import DESCENDING, order


def merge_sorted(lists: Sequence[DataFrame], key: Sequence[str], comparator: str, tag: str = "list_no") -> DataFrame:
    """One ordered list of all rows; equal keys stay, the earlier list first."""
    return tagged_union(lists, tag).orderBy(*order(key, comparator), F.col(tag))


def tagged_union(lists: Sequence[DataFrame], tag: str = "list_no") -> DataFrame:
    """All rows with the number of their list, in no order, for those that rank them anew."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(i)) for i, df in enumerate(lists)])


def sort_rows(df: DataFrame, key: Sequence[str], comparator: str = DESCENDING) -> DataFrame:
    return df.orderBy(*order(key, comparator))


def opposite(comparator: str) -> str:
    return "ascending" if comparator == DESCENDING else DESCENDING
