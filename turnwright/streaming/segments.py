"""Normalisation of a stream of transcript segments, each under its tenant's policy; the same rows as the batch form gives.

A stream's row is one hypothesis of a call: partials, then a final, then the next segment's partials. The only state is the
stability of the partials (one text and one number for each call); it is cleared by a final, so a final's result never
depends on the partials before it. Everything after it is a row's own: the tenant's policy by a join with a small static
table, then the column pipeline of `operators.itn`.

Failures never lose a transcript: a row whose tokens are out of range passes through, with its raw text on all surfaces,
deferred, without spans, and `error` says why. Unknown and missing tenants get the default one's policy.

Scale: one shuffle by call for the state, as a stream; policies are at most MAX_TENANTS rows, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scripts
from ..functions.spans import SPAN
from ..operators import itn, sessions
from ..operators.once import made_once
from .streams import stability

MAX_TENANTS = 10_000
DATE_ORDERS = ("DMY", "MDY", "YMD")
#: What a segment's row has; tokens may be null.
SEGMENT = "call_id string, seq long, text string, is_final boolean, lang_hint string, tenant string, tokens array<struct<text:string,start_ms:long,end_ms:long,conf:double>>"
RESULT = ("call_id", "seq", "is_final", "stable_count", "raw_text", "canonical_text", "display_text", "spans", "deferred", "lang", "script", "itn_version", "tenant", "error")


@dataclass(frozen=True)
class Policies:
    """Date order by tenant; the default tenant's holds for all others. enabled: whether grammars rewrite spans at all."""

    date_orders: Mapping[str, str]
    default: str = "default"
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.default not in self.date_orders:
            raise ValueError(f"default tenant {self.default!r} is not among {sorted(self.date_orders)}")
        wrong = {t: o for t, o in self.date_orders.items() if o not in DATE_ORDERS}
        if wrong:
            raise ValueError(f"unsupported date orders {wrong}; known: {list(DATE_ORDERS)}")
        if not isinstance(self.enabled, bool):
            raise ValueError(f"enabled must be true or false, not {self.enabled!r}")
        if len(self.date_orders) > MAX_TENANTS:
            raise ValueError(f"at most {MAX_TENANTS} tenants")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.date_orders.items()), "__tenant string, __date_order string")


def token_error(tokens: Column) -> Column:
    """What is wrong with a segment's tokens, or null: times below zero, confidences outside of 0 to 1, missing values."""
    wrong = lambda t: t.isNull() | t["text"].isNull() | F.coalesce(t["start_ms"] < 0, F.lit(True)) | F.coalesce(t["end_ms"] < 0, F.lit(True)) | F.coalesce((t["conf"] < 0) | (t["conf"] > 1) | F.isnan(t["conf"]), F.lit(True))
    return F.when(F.exists(F.coalesce(tokens, F.array().cast("array<struct<text:string,start_ms:long,end_ms:long,conf:double>>")), wrong), F.lit("invalid_tokens"))


def _plain(segments: DataFrame) -> DataFrame:
    """Segments without their tokens, which only count by their least confidence."""
    known = segments.select("call_id", "seq", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("is_final", F.lit(False)).alias("is_final"), "lang_hint", "tenant", itn.token_confidence(F.col("tokens")).alias("asr_conf"), token_error(F.col("tokens")).alias("error"))
    return known.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("lang_hint", "tenant")})


def _normalized(counted: DataFrame, policies: Policies, once: bool) -> DataFrame:
    """once: normalise equal hypotheses once; a stream can't, as it would need a state of all that were said."""
    table = F.broadcast(policies.table(counted.sparkSession))
    with_policy = counted.join(table, F.col("tenant") == F.col("__tenant"), "left")
    with_policy = with_policy.withColumns({"tenant": F.coalesce("__tenant", F.lit(policies.default)), "__order": F.coalesce("__date_order", F.lit(policies.date_orders[policies.default]))})
    classifier = itn.grammar_classifier(F.col("__order")) if policies.enabled else itn.default_classifier

    def made(rows: DataFrame, stable: str) -> DataFrame:
        return itn.normalize_segments(rows, is_final=F.col("is_final"), stable=F.col(stable), lang_hint=F.col("lang_hint"), asr_conf=F.col("asr_conf"), classifier=classifier)

    if once:
        # All that a result depends on; counts from STABLE_AT on do the same.
        asked = {c: F.col(c) for c in ("text", "is_final", "lang_hint", "asr_conf", "__order")} | {"__stable": F.least("stable_count", F.lit(itn.STABLE_AT))}
        done = made_once(with_policy, asked, lambda values: made(values, "__stable"))
    else:
        done = made(with_policy, "stable_count")
    failed = F.col("error").isNotNull()
    instead = {"canonical_text": F.col("raw_text"), "display_text": F.col("raw_text"), "spans": F.array().cast(f"array<{SPAN}>"), "deferred": F.lit(True), "lang": F.coalesce("lang_hint", F.lit("und")), "script": scripts.script_of(F.col("raw_text"))}
    return done.withColumns({c: F.when(failed, value).otherwise(F.col(c)) for c, value in instead.items()}).select(*RESULT)


def normalized_stream(segments: DataFrame, policies: Policies) -> DataFrame:
    """RESULT of every row of a stream of SEGMENT rows, in append mode."""
    return _normalized(stability(_plain(segments)), policies, once=False)


def normalized_calls(segments: DataFrame, policies: Policies) -> DataFrame:
    """RESULT of every row of a table of SEGMENT rows, in the order of seq."""
    return _normalized(sessions.stability(_plain(segments), "call_id", ["seq"], "text", "is_final"), policies, once=True)


def flickers(results: DataFrame) -> DataFrame:
    """Spans that were shown and are gone in the next shown result of the same segment: call_id, seq, cls, canonical, start, end.

    Results that were deferred show nothing; a segment ends with its final.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("call_id").orderBy("seq")
    segment = F.coalesce(F.sum(F.col("is_final").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shape = F.transform("spans", lambda s: F.struct(s["cls"].alias("cls"), s["canonical"].alias("canonical"), s["start"].alias("start"), s["end"].alias("end")))
    shown = results.withColumns({"__segment": segment, "__shown": shape}).filter("not deferred")
    later = F.lead("__shown").over(Window.partitionBy("call_id", "__segment").orderBy("seq"))
    gone = shown.withColumn("__later", later).filter(F.col("__later").isNotNull())
    return gone.select("call_id", "seq", F.explode(F.array_except("__shown", "__later")).alias("s")).select("call_id", "seq", "s.*")
