"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seed and ranked within their source; sorted by
fractional rank (rank - 1/2) / (rows of the source), the sources interleave in
proportion, and equal cuts of that order have the mixture of the whole.

Ranks never need a source in one task: the shuffle key's leading bits name a
bucket, counts of (source, bucket) give the rank where each bucket begins, and
a window ranks only within a bucket.  The global position is found likewise by
slices of the fractional rank.

Defined results: a null source is a source of its own; a null text counts as
empty; repeated rows are placed one by one; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, seeded, stratum

ROWS_PER_BUCKET = 2000
SLICES = 4096


def interleave(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, shard and slot of every row; shards differ by one row at most."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        stratum(F.col("source")).alias("stratum"),
        seeded(seed, F.col("doc_id"), F.crc32(raw.cast("binary"))).alias("h"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
    )
    total = docs.count()
    bits = min(24, max(8, math.ceil(math.log2(max(1, total / ROWS_PER_BUCKET)))))
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - bits))

    in_order = Window.partitionBy("stratum").orderBy("bucket")
    counts = (
        rows.groupBy("stratum", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(in_order) - F.col("n"))
        .withColumn("of", F.sum("n").over(Window.partitionBy("stratum")))
    )
    within = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = (
        rows.withColumn("i", F.row_number().over(within))
        .join(counts.drop("n"), ["stratum", "bucket"])
        .withColumn("at", (2 * (F.col("before") + F.col("i")) - 1) / (2 * F.col("of")).cast("double"))
        .withColumn("slice", F.floor(F.col("at") * SLICES).cast("int"))
        .select("doc_id", "size", "text_crc32", "stratum", "h", "at", "slice")
    )
    ranked = cut(ranked)

    slices = ranked.groupBy("slice").agg(F.count("*").alias("n"))
    slices = slices.withColumn("before", F.sum("n").over(Window.orderBy("slice")) - F.col("n")).drop("n")
    # sub-slices keep a window's group small however many rows a slice has
    fine = max(1, total // (SLICES * ROWS_PER_BUCKET))
    ranked = ranked.withColumn("sub", F.floor((F.col("at") * SLICES - F.col("slice")) * fine).cast("int"))
    subs = ranked.groupBy("slice", "sub").agg(F.count("*").alias("n"))
    subs = subs.withColumn("offset", F.sum("n").over(Window.partitionBy("slice").orderBy("sub")) - F.col("n")).drop("n")
    place = Window.partitionBy("slice", "sub").orderBy("at", "h", "stratum", "doc_id", "text_crc32", "size")
    pos = F.col("before") + F.col("offset") + F.row_number().over(place) - 1
    out = ranked.join(subs.join(slices, "slice"), ["slice", "sub"]).withColumn("pos", pos.cast("long"))
    return (
        out.withColumn("shard", F.expr(f"cast((pos * {n_shards}L) div {max(1, total)}L as int)"))
        .withColumn("slot", F.col("pos") - F.expr(f"(cast(shard as long) * {max(1, total)}L + {n_shards - 1}L) div {n_shards}L"))
        .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long"))
    )
