"""Columns that are costly to make and depend on few values: made once for each value, and joined back to its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tasks_for(session: SparkSession) -> int:
    """How many tasks work is dealt over that its bytes don't tell: one for each core at least."""
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df's rows dealt over all tasks by a hash of `by`: a file's row groups, which else set the tasks, can be few and hold much work."""
    return df.repartition(tasks_for(df.sparkSession), *by)


def made_once(df: DataFrame, keys: dict[str, Column], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `make` adds to a table of the distinct values of keys, which has their names.

    Nulls are values as any other. Values are counted down before they are shuffled and dealt anew, as a task may hold few
    bytes of them and much work; a hot value's rows are a join key that AQE splits.
    """
    session = df.sparkSession
    keyed = df.withColumn("__key", F.struct(*[c.alias(n) for n, c in keys.items()]))
    values = keyed.select(F.col("__key").alias("__value")).distinct().repartition(tasks_for(session), "__value")
    made = make(values.select("__value", *[F.col("__value")[n].alias(n) for n in keys])).drop(*keys)
    return keyed.join(made, F.col("__key") == F.col("__value")).drop("__key", "__value")
