"""Session logic over whole tables: the batch counterparts of the streams in `streaming`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("double")


def stability(rows: DataFrame, key: str, order: list[str], text: str, final: str | None = None) -> DataFrame:
    """rows with stable_count: how many equal texts in a row end here; counting starts anew after a final."""
    by = Window.partitionBy(key).orderBy(*order)
    changed = ~F.col(text).eqNullSafe(F.lag(text).over(by)) | (F.row_number().over(by) == 1)
    if final:
        changed = changed | F.coalesce(F.lag(final).over(by), F.lit(False))
    islands = rows.withColumn("__island", F.sum(changed.cast("int")).over(by))
    return islands.withColumn("stable_count", F.row_number().over(Window.partitionBy(key, "__island").orderBy(*order))).drop("__island")


def inactivity_sessions(rows: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """key, session_no, started, ended, n: rows no further apart than the gap."""
    by = Window.partitionBy(key).orderBy(ts)
    apart = _seconds(ts) - F.lag(_seconds(ts)).over(by)
    marked = rows.withColumn("__new", F.coalesce((apart > gap_seconds).cast("int"), F.lit(1))).withColumn("session_no", F.sum("__new").over(by))
    return marked.groupBy(key, "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))


def cached_language(rows: DataFrame, key: str, order: str, detected: str, client: str | None = None, ttl_seconds: float = 600.0, fallback: str = "hi") -> DataFrame:
    """rows with language and source: the client's, the last one detected within the time to live, or the fallback."""
    by = Window.partitionBy(key).orderBy(order)
    last = F.last(F.when(F.col(detected).isNotNull(), F.struct(F.col(detected).alias("lang"), F.col(order).alias("at"))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    staged = rows.withColumn("__last", last)
    fresh = _seconds(order) - _seconds("__last.at") <= ttl_seconds
    asked = F.col(client) if client else F.lit(None).cast("string")
    source = F.when(asked.isNotNull(), "client").when(F.coalesce(fresh, F.lit(False)), "cache").when(F.col(detected).isNotNull(), "detected").otherwise("fallback")
    staged = staged.withColumn("language_source", source)
    by_source = F.when(source == "client", asked).when(source == "cache", F.col("__last.lang")).when(source == "detected", F.col(detected)).otherwise(fallback)
    return staged.withColumn("language", by_source).drop("__last")


def expired_jobs(jobs: DataFrame, now: str, ttl_seconds: float = 14_400.0) -> DataFrame:
    """Finished jobs older than the time to live: jobs (status, created_at) as of column `now`."""
    return jobs.filter(F.col("status").isin("complete", "failed") & (_seconds(now) - _seconds("created_at") > ttl_seconds))


def flushed_sessions(rows: DataFrame, models: tuple[str, ...] = ()) -> DataFrame:
    """session, seq, event, transcript, n_chunks, seconds: what sessions in flush mode answer (`streaming.live`), over a whole table.

    rows: session, seq, kind, payload, rate, model. A control row ends the part of its session that it answers, so a
    part's sound is gathered by one grouping.
    """
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    unknown = F.coalesce(~F.col("model").isin(*models), F.lit(False)) if models else F.lit(False)
    event = F.when(F.col("kind") == "flush", "data").when(F.col("kind") == "start", F.when(unknown, "error").otherwise("ready")).when(F.col("kind") == "stop", "done")
    staged = rows.withColumn("event", event)
    ends = F.coalesce(F.col("event").isin("done", "error").cast("int"), F.lit(0))
    parts = F.coalesce(F.sum(F.col("event").isNotNull().cast("int")).over(before), F.lit(0))
    staged = staged.withColumns({"__ended": F.coalesce(F.sum(ends).over(before), F.lit(0)), "__part": parts, "__rate": F.coalesce(F.last("rate", ignorenulls=True).over(upto), F.lit(16_000))}).filter("__ended = 0")
    answered = F.when(F.col("event").isNotNull(), F.struct("seq", "event", "__rate"))
    sound = F.when(F.octet_length("payload") > 0, F.struct("seq", "payload"))
    by_part = staged.groupBy("session", "__part").agg(F.max(answered).alias("a"), F.array_sort(F.collect_list(sound)).alias("held")).filter("a is not null")
    held = F.when(F.col("a.event") == "data", F.transform("held", lambda c: c["payload"])).otherwise(F.array().cast("array<binary>"))
    total = F.aggregate("held", F.lit(0).cast("long"), lambda n, c: n + F.octet_length(c))
    return by_part.withColumn("held", held).select("session", "a.seq", "a.event", F.array_join(F.transform("held", lambda c: c.cast("string")), " ").alias("transcript"), F.size("held").cast("int").alias("n_chunks"), (total / (2.0 * F.col("a.__rate"))).alias("seconds"))
