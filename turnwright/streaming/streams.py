"""Structured Streaming: stability of partials, flushes after silence, and a language cache with a time to live."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or tempfile.mkdtemp(prefix="turnwright-")).rstrip("/")


PARTIALS = "call_id string, seq long, text string, is_final boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_files(spark: SparkSession, schema: str | StructType, path: str, per_batch: int = 64) -> DataFrame:
    """A stream of Parquet files, at most per_batch in a micro-batch: stateful operators sort a call's rows of one in memory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def stability(stream: DataFrame, key: str = "call_id", order: str = "seq", text: str = "text", final: str = "is_final") -> DataFrame:
    """stream with stable_count: how many equal texts in a row end here. State: one text and one number for each call, cleared by a final.

    Rows of a call within a micro-batch are counted in the order of `order`; those of later micro-batches come after them.
    """
    kinds = StructType([*stream.schema.fields, StructField("stable_count", IntegerType())])

    def count(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        counts = []
        for said, ends in zip(rows[text], rows[final], strict=True):
            said = said if isinstance(said, str) else ""
            n = n + 1 if n and said == last else 1
            last = said
            counts.append(n)
            if ends is True or ends == 1:
                last, n = "", 0
        if n:
            state.update((last, n))
        elif state.exists:
            state.remove()
        yield rows.assign(stable_count=counts)[kinds.names]

    return stream.groupBy(key).applyInPandasWithState(count, kinds, "last string, n int", "append", GroupStateTimeout.NoTimeout)


def inactivity_flushes(stream: DataFrame, key: str, ts: str, gap: str = "350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A row for each buffer that a silence of `gap` ends: key, started, ended, n. ended is the last row's time plus the gap."""
    sessions = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def language_cache(stream: DataFrame, ttl_ms: int = 600_000, fallback: str = "hi", late: str = "10 seconds") -> DataFrame:
    """session, seq, language, language_source. stream: session, seq, ts, detected, client, is_final.

    A session's language lives ttl_ms of its rows' time after it was detected; the watermark clears sessions that ended.
    """

    def resolve(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, since = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, ts, detected, client, final in zip(rows["seq"], rows["ts"], rows["detected"], rows["client"], rows["is_final"], strict=True):
            now = ts.value // 1_000_000
            known = known if known and now - since <= ttl_ms else None
            source = "client" if isinstance(client, str) else "cache" if known else "detected" if isinstance(detected, str) else "fallback"
            out.append((key[0], seq, {"client": client, "cache": known, "detected": detected, "fallback": fallback}[source], source))
            if not known and isinstance(detected, str):
                known, since = detected, now
            known = None if final else known
        if known:
            state.update((known, since))
            state.setTimeoutTimestamp(max(since + ttl_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "seq", "language", "language_source"])

    kept = stream.withWatermark("ts", late).groupBy("session")
    return kept.applyInPandasWithState(resolve, "session string, seq long, language string, language_source string", "language string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, provider: str | None = None) -> DataFrame:
    """All that is there now, written to path and read back. provider: the state store's class, for this query only."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    if provider:
        spark.conf.set(PROVIDER, provider)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
