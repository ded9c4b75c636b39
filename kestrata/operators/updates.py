"""Column updates: increments, wrapping counters, overwrites, defaults.

Instructions apply from left to right to the columns of each row; a null
column is absent.  A set of updates is one projection, inside codegen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError

_NONE = object()


@dataclass(frozen=True)
class Increment:
    """Add ``by``; where the sum passes ``threshold`` it goes on from ``wrap_to``, the step beyond counting from there."""

    field: str
    by: Any
    default: Any = _NONE
    threshold: int | None = None
    wrap_to: int | None = None


@dataclass(frozen=True)
class Overwrite:
    """Replace a present value; with a default also set an absent one (to ``value``)."""

    field: str
    value: Any
    default: Any = _NONE


@dataclass(frozen=True)
class Put:
    """Set the value, present or not."""

    field: str
    value: Any


@dataclass(frozen=True)
class Other:
    """An unknown instruction: nothing, but a default fills an absent column."""

    field: str
    default: Any = _NONE


Op = Increment | Overwrite | Put | Other


def _value(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _is_step(by: Any) -> bool:
    return isinstance(by, Column) or (isinstance(by, int) and not isinstance(by, bool))


def stepped(old: Column, op: Increment) -> Column:
    new = old + _value(op.by)
    if op.threshold is None:
        return new
    return F.when(new > op.threshold, op.wrap_to + (new - op.threshold - 1)).otherwise(new)


def apply(rows: DataFrame, ops: Sequence[Op]) -> DataFrame:
    """Rows with the instructions applied; columns that only an instruction names are added."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    for op in ops:
        if isinstance(op, Increment) and _is_step(op.by) and op.field in kinds and not isinstance(kinds[op.field], (T.NumericType, T.NullType)):
            raise TableError((op.field, "not_a_number"))
        old = F.col(op.field) if op.field in kinds else F.lit(None)
        has_default = getattr(op, "default", _NONE) is not _NONE
        start = F.coalesce(old, _value(op.default)) if has_default else old
        if isinstance(op, Put):
            new = _value(op.value)
        elif isinstance(op, Overwrite):
            new = F.when(start.isNotNull(), _value(op.value))
        elif isinstance(op, Increment) and _is_step(op.by):
            new = F.when(start.isNotNull(), stepped(start, op))
        else:
            new = start
        if op.field not in kinds and not has_default and not isinstance(op, Put):
            continue
        rows = rows.withColumn(op.field, new)
        kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows


def changed(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``after`` that differ from ``before``: what an update has to write."""
    values = [c for c in after.columns if c not in key]
    old = before.select(*key, *[(F.col(c) if c in before.columns else F.lit(None)).alias(f"__{c}") for c in values], F.lit(True).alias("__was"))
    same = F.coalesce(F.col("__was"), F.lit(False))
    for c in values:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    void = F.col("__was").isNull()
    for c in values:
        void &= F.col(c).isNull()
    return after.join(old, list(key), "left").where(~same & ~void).select(*after.columns)


def fold_increments(steps: DataFrame, key: Sequence[str], by: str, start: int = 0, threshold: int | None = None, wrap_to: int | None = None, name: str = "value", order_by: str | None = None) -> DataFrame:
    """The counter of each key after all its steps.

    Without a threshold this is a sum.  With one, steps between 0 and the
    period threshold - wrap_to + 1 from a start not above the threshold have a
    closed form over the sum, so hot keys are summed before the shuffle.  With
    ``order_by`` any steps are allowed and each key's are folded in order.
    """
    if threshold is None:
        return steps.groupBy(*key).agg((F.sum(by) + F.lit(start)).cast("long").alias(name))
    if order_by is None:
        period = threshold - wrap_to + 1
        total = (F.sum(by) + F.lit(start)).cast("long")
        wrapped = F.when(total <= threshold, total).otherwise(wrap_to + F.pmod(total - wrap_to, F.lit(period)))
        return steps.groupBy(*key).agg(wrapped.cast("long").alias(name))
    op = Increment(name, None, threshold=threshold, wrap_to=wrap_to)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("at"), F.col(by).cast("long").alias("by"))))
    fold = F.aggregate(ordered, F.lit(start).cast("long"), lambda a, x: stepped(a, Increment(op.field, x["by"], threshold=threshold, wrap_to=wrap_to)))
    return steps.groupBy(*key).agg(fold.alias(name))
