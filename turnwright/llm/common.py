"""Tables, shared storage and small column helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MAX_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local master gets a new temporary folder, as in tests."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_turnwright_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="turnwright-")
        spark.sparkContext._turnwright_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def bounded_batches(spark: SparkSession) -> None:
    """Let texts reach Python BATCH_BYTES at a time, unless the session has a bound of its own: workers then stay small."""
    if spark.conf.get(MAX_BATCH, None) in (None, "67108864b"):  # Spark's default
        spark.conf.set(MAX_BATCH, str(BATCH_BYTES))


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at the files, which outlive executors.

    Once they are written, nothing reads the shuffle files of the plan that made them, so Spark is asked to drop those.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/turnwright/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._turnwright_path = path
    return back


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it unlike every column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of cut() frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_turnwright_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)
