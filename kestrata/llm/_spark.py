"""Shared Spark helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20  # of an Arrow batch, where rows are long; it takes several times that in the JVM and in Python


def small_batches(spark: SparkSession) -> None:
    """Session settings for work on whole texts, where the session has Spark's own defaults.

    Arrow batches hold some megabytes of text, however long the rows, rather
    than ten thousand whole texts or 64 MB, and shuffle files go when the job that wrote them ends: steps are
    cut by checkpoints and tables, so none is read again.
    """
    settings = (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "64MB", str(BATCH_BYTES)),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true"),
    )
    for name, default, ours in settings:
        if spark.conf.get(name, None) in (None, default):  # None where nothing is set
            spark.conf.set(name, ours)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only in one process that names none, as in tests."""
    small_batches(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kestrata-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that later steps survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path, for steps that know when they no longer need it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stratum(source: Column) -> Column:
    """A key without nulls that tells the null source from every named one."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def seeded(seed: int, *ids: Column) -> Column:
    """60 pseudorandom bits from a seed and ids, the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tables(spark, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(df: DataFrame, most: int) -> DataFrame:
    """``df``, a checkpointed side of a join, to be broadcast if it has at most ``most`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
