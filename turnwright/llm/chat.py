"""Chat formatting: cumulative-snapshot collapse, then rendering (DataFrame operations only).

A log that is written after every turn holds a conversation many times, each time as a prefix of a longer one. Every
conversation's turns are numbered in order; the rolling hash of a prefix is the sum of its turns' hashes, each taken
with its turn's place, so that it needs no ordered fold over a whole conversation. Conversations equal to another keep
the smallest id; those whose (length, hash) is an inner prefix of some other conversation are removed by an anti-join.
What stays is rendered, in parts of PART turns.

Scale: numbering and sums work on blocks of PART turn numbers first and on block totals second, so no task needs all
turns of a conversation; text moves only once, when parts are joined. Prefix rows are distinct before the anti-join
and equal conversations are one row before it, so a very common first turn is one row on either side.

Defined cases: rows without conv_id or turn belong to no conversation and are left out; null role is `unknown`; null
text is empty; repeated rows count once; turns that share a number are ordered by role, then by
their text's SHA-256; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PART = 256


KEYS = ["conv_id", "turn", "role", "sha"]


def clean_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, sha."""
    text = F.coalesce("text", F.lit(""))
    return turns.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("sha"))


def numbered_turns(turns: DataFrame, part: int = PART) -> DataFrame:
    """KEYS of distinct turns, place (from 0), p1, p2: the sums of hashes of this and all earlier turns."""
    rows = clean_turns(turns).select(*KEYS).distinct()
    rows = rows.withColumn("block", F.floor(F.col("turn") / part))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "sha")
    rows = rows.withColumn("in_block", F.row_number().over(within))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = rows.join(starts, ["conv_id", "block"]).withColumn("place", F.col("start") + F.col("in_block") - 1)
    digest = F.sha2(F.concat_ws("\u0001", F.col("place").cast("string"), "role", "sha"), 256)
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)")
    rows = rows.withColumns({"h1": half(1), "h2": half(16)})
    sums = rows.groupBy("conv_id", "block").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"s{i}").over(before), zero).alias(f"b{i}") for i in (1, 2)])
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"w{i}": F.sum(f"h{i}").over(upto) for i in (1, 2)}).join(sums, ["conv_id", "block"])
    return rows.select(*KEYS, "place", *[(F.col(f"w{i}") + F.col(f"b{i}")).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_logged (equal conversations, itself included) of conversations that are no other's prefix."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("place").alias("last"))
    marked = prefixes.join(sizes, "conv_id")
    ends = marked.filter("place = last").groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    inner = marked.filter("place < last").select("place", "p1", "p2").distinct()
    return ends.join(inner, ["place", "p1", "p2"], "left_anti").select("conv_id", (F.col("place") + 1).alias("n_turns"), "n_logged")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part (from 0), n_turns of the conversation, n_logged, chat: up to `part` rendered turns."""
    rows = cut(numbered_turns(turns, part), "chat-prefixes")
    stay = maximal_conversations(rows.select("conv_id", "place", "p1", "p2"))
    texts = clean_turns(turns).dropDuplicates(KEYS)
    kept = rows.select(*KEYS, "place").join(stay, "conv_id").join(texts, KEYS).select("conv_id", "place", "n_turns", "n_logged", rendered(F.col("role"), F.col("text")).alias("piece"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"])
    return kept.groupBy("conv_id", F.floor(F.col("place") / part).alias("part"), "n_turns", "n_logged").agg(F.array_join(in_order, "").alias("chat"))
