"""Speaker turns: overlaps, cross-talk, merging, roles, languages, slices and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.spans import SPAN

LABELS = {"customer": "👤 Customer", "agent": "🎧 Agent"}
HEADER = "### 📞 Call Transcript\n\n| Time (s) | Speaker | Transcript |\n| :--- | :--- | :--- |\n"


def mark_overlaps(turns: DataFrame, keys: list[str], speaker: str = "speaker", start: str = "start_sec", end: str = "end_sec", bucket: float = 60.0) -> DataFrame:
    """turns with overlap_flag: another speaker's turn of the same keys shares time with it, more than a point.

    Turns meet in time buckets of `bucket` seconds by an equi-join, not each with each; a turn is compared only inside the
    buckets it covers. keys name a call; turns that are equal in all compared columns share one answer.
    """
    cols = [*keys, speaker, start, end]
    mine = turns.select(*cols).distinct()
    spread = F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.greatest(F.col(start), F.col(end)) / bucket)))
    left, right = mine.withColumn("__b", spread), mine.select(*[F.col(c).alias(f"__{c}") for c in cols], spread.alias("__rb"))
    same = (F.col("__b") == F.col("__rb")) & (F.col(speaker) != F.col(f"__{speaker}"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    met = left.join(right, same & (F.least(F.col(end), F.col(f"__{end}")) > F.greatest(F.col(start), F.col(f"__{start}"))), "left_semi").select(*cols).distinct()
    return turns.join(met.withColumn("overlap_flag", F.lit(True)), cols, "left").withColumn("overlap_flag", F.coalesce("overlap_flag", F.lit(False)))


def merge_channels(turns: DataFrame, keys: list[str], channel: str = "channel") -> DataFrame:
    """Turns of single channels as one timeline: the channel is the speaker."""
    named = turns.withColumn("speaker", F.concat(F.lit("speaker_"), F.col(channel).cast("string")))
    return mark_overlaps(named, keys)


def merged_and_labelled(turns: DataFrame, key: str, order: str, speaker: str = "speaker", text: str = "text", start: str | None = None, end: str | None = None, flags: list[str] = (), spans: str | None = None) -> DataFrame:
    """One row per run of turns of one speaker: key, place, speaker_id, speaker (role), text, and what is named.

    Blank turns go first, so that the turns around one may join. The first speaker of a call is the customer, all others
    are agents. Span offsets of joined turns move with their text.
    """
    by_call = Window.partitionBy(key).orderBy(order)
    said = turns.filter(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\\p{Z}]+", "") != "")
    said = said.withColumn("__new", F.coalesce((F.lag(speaker).over(by_call) != F.col(speaker)).cast("int"), F.lit(1)))
    said = said.withColumn("__island", F.sum("__new").over(by_call)).withColumn("__first", F.first(speaker).over(by_call))
    fields = [order, text, *([spans] if spans else [])]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    out = [F.first(speaker).alias("speaker_id"), F.first("__first").alias("__first"), ordered.alias("__parts")]
    out += [F.min_by(start, order).alias(start)] if start else []
    out += [F.max_by(end, order).alias(end)] if end else []
    out += [F.bool_or(f).alias(f) for f in flags]
    runs = said.groupBy(key, F.col("__island").alias("place")).agg(*out)
    joined = F.trim(F.array_join(F.transform("__parts", lambda p: p[text]), " "))
    runs = runs.withColumn("text", joined)
    if spans:
        first = F.struct(F.lit(0).alias("shift"), F.array().cast(f"array<{SPAN}>").alias("out"))
        moved = lambda acc, p: F.transform(p[spans], lambda s: s.withField("start", s["start"] + acc["shift"]).withField("end", s["end"] + acc["shift"]))
        runs = runs.withColumn(spans, F.aggregate("__parts", first, lambda acc, p: F.struct((acc["shift"] + F.length(p[text]) + 1).alias("shift"), F.concat(acc["out"], moved(acc, p)).cast(f"array<{SPAN}>").alias("out")), lambda acc: acc["out"]))
    role = F.when(F.col("speaker_id") == F.col("__first"), "customer").otherwise("agent")
    return runs.withColumn("speaker", role).drop("__first", "__parts")


def label(speaker: Column) -> Column:
    out = F.when(F.coalesce(speaker, F.lit("")) == "", "Speaker").otherwise(F.initcap(speaker))
    for name, shown in LABELS.items():
        out = F.when(speaker == name, shown).otherwise(out)
    return out


def markdown(turns: DataFrame, key: str, order: str, start: str = "start_sec", end: str = "end_sec", text: str = "canonical_text", fallback: str = "text", speaker: str = "speaker", overlap: str | None = "overlap_flag") -> DataFrame:
    """key, markdown: one table per call, a row per turn that says something."""
    shown = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.col(text)).otherwise(F.coalesce(F.col(fallback), F.lit("")))
    cell = F.trim(F.replace(F.replace(F.col("__text"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    flag = F.when(F.col(overlap), " · overlap").otherwise("") if overlap else F.lit("")
    row = F.concat(F.lit("| "), F.format_string("%.2f–%.2f", F.col(start).cast("double"), F.col(end).cast("double")), flag, F.lit(" | "), label(F.col(speaker)), F.lit(" | "), cell, F.lit(" |"))
    rows = turns.withColumn("__text", shown).withColumn("__row", F.when(F.trim("__text") != "", row))
    body = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct(order, F.col("__row").alias("row")))), lambda r: r["row"].isNotNull()), lambda r: F.concat(r["row"], F.lit("\n"))), "")
    return rows.groupBy(key).agg(F.concat(F.lit(HEADER), body).alias("markdown"))


def flat(turns: DataFrame, key: str, order: str, text: str = "text", speaker: str | None = None) -> DataFrame:
    """key, transcript: `speaker: text` lines, or texts joined by spaces where no speaker is named."""
    piece = F.concat_ws(": ", speaker, text) if speaker else F.col(text)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"])
    return turns.groupBy(key).agg(F.array_join(ordered, "\n" if speaker else " ").alias("transcript"))


def majority(rows: DataFrame, key: str, value: str, order: str, first: int | None = None) -> DataFrame:
    """key, value, n: the most frequent value, the one seen first where counts are equal; of the first `first` rows only, if given."""
    if first is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__n") <= first)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    best = counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("__first"))).alias("b"))
    return best.select(key, F.col("b")[value].alias(value), F.col("b")["n"].alias("n"))


def fixed_slices(turns: DataFrame, start: str, end: str, seconds: float = 25.0) -> DataFrame:
    """turns with slice_no, slice_start, slice_end: whole turns up to `seconds`, else pieces of that length and a rest."""
    length = F.col(end) - F.col(start)
    n = F.greatest(F.ceil(length / seconds), F.lit(1)).cast("int")
    cut = turns.withColumn("slice_no", F.explode(F.sequence(F.lit(0), n - 1)))
    begin = F.col(start) + F.col("slice_no") * seconds
    return cut.withColumn("slice_start", begin).withColumn("slice_end", F.least(begin + seconds, F.col(end)))


def gate_crosstalk(turns: DataFrame, loudness: DataFrame, key: str, margin: float = 3.0, keep: float = 0.5, floor: float = 30.0, frame: float = 0.03, channel: str = "channel") -> DataFrame:
    """Turns that are their own channel's speech. loudness: key, channel, db array<double> (a frame every `frame` seconds).

    Over its own speech frames a turn must be within `margin` of the loudest other channel for `keep` of them. Turns
    without frames, without a known channel, or in calls of one channel stay.
    """
    call = loudness.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(channel, "db"))).alias("__db"), F.min(F.size("db")).alias("__frames"))
    staged = turns.join(call, key, "left").withColumn("__a", F.greatest(F.floor(F.col("start_sec") / frame).cast("int"), F.lit(0)))
    staged = staged.withColumn("__b", F.least(F.col("__frames"), F.bround(F.col("end_sec") / frame).cast("int")))
    cut = lambda db: F.slice(db, F.col("__a") + 1, F.greatest(F.col("__b") - F.col("__a"), F.lit(0)))
    others = F.transform(F.map_values(F.map_filter("__db", lambda c, _: c != F.col(channel))), cut)
    mine = cut(F.try_element_at("__db", F.col(channel)))

    def stays(c: Column) -> Column:
        # Each frame meets the other channels once; values that all frames share are written once, as a filter would make them anew for every frame.
        loudest = lambda i: F.coalesce(F.array_max(F.transform(c["others"], lambda o: F.get(o, i))), F.lit(-120.0))
        frames = F.transform(c["mine"], lambda v, i: F.struct(v.alias("v"), F.when(v > c["least"], loudest(i)).alias("loud")))
        own = lambda x: F.size(F.filter(x, lambda f: f["v"] >= f["loud"] - margin)) / F.size(x) >= keep
        return let(F.filter(frames, lambda f: f["v"] > c["least"]), lambda x: c["mine"].isNull() | (c["channels"] < 2) | (F.size(c["mine"]) == 0) | (F.size(x) == 0) | own(x))

    held = F.struct(mine.alias("mine"), others.alias("others"), (F.array_max(mine) - floor).alias("least"), F.size("__db").alias("channels"))
    return staged.filter(let(held, stays)).drop("__db", "__frames", "__a", "__b")


def attribute(words: DataFrame, turns: DataFrame, key: str, bucket: float = 60.0) -> DataFrame:
    """words (key, word_no, start_sec, end_sec) with the speaker of most shared time and confidence, its part of the word.

    Of turns that share as much the first one counts. A turn never shares more than one that holds it, so in each bucket
    only turns that no other holds are kept: in the order of their starts their ends go up too. Those that meet a word are
    then a run, whose best is one of the turns at its ends or the longest of those inside the word, which is found in
    blocks of 1, 2, 4, ... turns. However many turns meet a word, it asks for a few of them and two blocks of a size, so
    work grows with words and turns times the logarithm of a bucket's turns.
    """
    spread = lambda: F.explode(F.sequence(F.floor(F.col("start_sec") / bucket), F.floor(F.col("end_sec") / bucket)))
    by = Window.partitionBy("__k", "__b")
    held = F.max("te").over(by.orderBy("ts", F.desc("te"), "speaker").rowsBetween(Window.unboundedPreceding, -1))
    own = turns.select(F.col(key).alias("__k"), "speaker", F.col("start_sec").alias("ts"), F.col("end_sec").alias("te"), spread().alias("__b"))
    outer = own.withColumn("__held", held).filter(F.col("__held").isNull() | (F.col("te") > F.col("__held")))
    outer = outer.withColumns({"__i": F.row_number().over(by.orderBy("ts")) - 1, "__n": F.count(F.lit(1)).over(by)})
    shifted = lambda c, level: F.call_function("shiftright", c, level)
    blocks = outer.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2("__n")).cast("int"))))
    blocks = blocks.groupBy("__k", "__b", "level", shifted(F.col("__i"), F.col("level")).alias("at")).agg(F.max_by(F.struct("speaker", "ts", "te"), F.struct(F.col("te") - F.col("ts"), -F.col("ts"))).alias("t"))

    # How many turns start and end before a word's start, or at it, and before its end.
    word = F.struct(F.col("word_no"), F.col("start_sec").alias("ws"), F.col("end_sec").alias("we"))
    marks = words.select(F.col(key).alias("__k"), word.alias("w"), spread().alias("__b")).withColumn("late", F.explode(F.array(F.lit(False), F.lit(True))))
    marks = marks.withColumns({"x": F.when(F.col("late"), F.col("w.ws")).otherwise(F.col("w.we")), "one": F.lit(0)})

    def counted(edge: str) -> DataFrame:
        both = marks.unionByName(outer.select("__k", "__b", F.col(edge).alias("x"), F.lit(1).alias("one")), allowMissingColumns=True)
        # Turns at x stand before a word's start and behind its end.
        order = by.orderBy("x", F.when(F.col("one") == 1, 1).when(F.col("late"), 2).otherwise(0)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("n", F.sum("one").over(order).cast("int")).filter("one = 0").withColumn("edge", F.lit(edge))

    at = lambda edge, late: F.max(F.when((F.col("edge") == edge) & (F.col("late") == late), F.col("n")))
    reach = counted("ts").unionByName(counted("te")).groupBy("__k", "__b", "w").agg(at("ts", True).alias("begun"), at("te", True).alias("over"), at("te", False).alias("within"), at("ts", False).alias("met"))
    reach = reach.withColumns({"lo": F.greatest("begun", "over"), "hi": F.least("within", "met")})

    def level_blocks(level: Column) -> Column:
        """The blocks of a size at the two ends of the run that larger ones leave."""
        left, right = shifted(F.col("lo") - 1, level) + 1, shifted(F.col("hi"), level)
        left = F.when(F.col("lo") == 0, 0).otherwise(left)
        odd = lambda c: (left < right) & (c % 2 == 1)
        return F.array(F.when(odd(left), F.struct(level.alias("level"), left.alias("at"))), F.when(odd(right), F.struct(level.alias("level"), (right - 1).alias("at"))))

    inside = F.when(F.col("lo") < F.col("hi"), F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("hi") - F.col("lo"))).cast("int")), level_blocks)))
    ends = F.array(*[F.struct(F.lit(0).alias("level"), c.alias("at")) for c in (F.col("begun") - 1, F.col("within"), F.col("over"))])
    asked = reach.select("__k", "__b", "w", F.explode(F.concat(ends, F.coalesce(inside, F.slice(ends, 1, 0)))).alias("p")).filter("p is not null").select("__k", "__b", "w", "p.*").distinct()
    met = asked.join(blocks, ["__k", "__b", "level", "at"]).select("__k", "w.*", "t.*").filter((F.col("ws") < F.col("te")) & (F.col("ts") < F.col("we")))
    shared = met.withColumn("share", F.least("we", "te") - F.greatest("ws", "ts"))
    best = shared.groupBy(F.col("__k").alias(key), "word_no").agg(F.max_by(F.struct("speaker", (F.col("share") / (F.col("we") - F.col("ws"))).alias("confidence")), F.struct("share", -F.col("ts"))).alias("best"))
    return words.join(best, [key, "word_no"], "left").select(*words.columns, "best.speaker", "best.confidence")
