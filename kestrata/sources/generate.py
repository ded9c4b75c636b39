"""Load generators: rows made where they are used, as many as asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the shape of the range and retention workloads
RANGE_KEYS = 10_000
RANGE_VALUE, RANGE_STEP = 123, 23


def range_load(spark: SparkSession, rows: int, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """key (1..10000, by a seeded hash), ts (increasing), value and incs; the same rows on every run."""
    ids = spark.range(rows, numPartitions=tasks) if tasks else spark.range(rows)
    return ids.select((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(RANGE_KEYS)) + 1).alias("key"), F.col("id").alias("ts"), F.lit(RANGE_VALUE).cast("long").alias("value"), F.lit(RANGE_STEP).cast("long").alias("incs"))


def ttl_load(spark: SparkSession, rows: int, kilobytes: int, seed: int = 0) -> DataFrame:
    """i and value: ``kilobytes`` of pseudorandom bytes a row."""
    blocks = F.transform(F.sequence(F.lit(1), F.lit(kilobytes * 32)), lambda b: F.unhex(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), b.cast("string")), 256)))
    return spark.range(rows).select(F.col("id").alias("i"), F.aggregate(blocks, F.lit(b""), lambda a, x: F.concat(a, x)).alias("value"))
