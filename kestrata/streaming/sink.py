"""An upsert sink for streams: every micro-batch becomes one commit of puts.  An extension, marked as such."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..sources.store import Store


def upsert_batches(store: Store, table: str, order_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: of rows with one key in a batch, the last by ``order_by`` counts.

    Puts are idempotent, so a batch that is replayed after a failure changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(table, batch, order_by=order_by)

    return write
