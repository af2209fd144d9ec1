"""Request contexts: what callers give, the candidates and packs made of it, and whether phrases came through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import devanagari
from ..functions.clean import composed
from ..functions.grammar import let
from .phrases import display, distinct_variants, general_variants, phrase_pack, plain_display, ranked, variant_key, variants_by_row

SCALARS = ("debtor_name", "agent_name", "lender", "product", "city", "branch")
LISTS = ("account_terms", "prior_call_entities", "campaign_vocabulary", "amounts", "dates")
MOST_SHOWN = 8


def split_list(text: Column) -> Column:
    """Items between commas, but for commas between digits; blank ones are left out."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), "(?<!\\p{Nd}),|,(?!\\p{Nd})"), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def list_values(items: Column) -> Column:
    """Items (in compatibility form) as they are shown, without empty ones and those whose key came before."""
    return distinct_variants(F.coalesce(items, F.array().cast("array<string>")))


def parse_context(raw: Column) -> Column:
    """struct of all fields from a JSON object; lists may be arrays or text with commas; anything else gives empty fields."""
    safe = F.translate(raw, "\uff02\uff3c", "  ")  # in compatibility form these would end or escape a JSON string
    given = F.from_json(composed(safe, "NFKC"), "map<string,string>")

    def values(m: Column) -> Column:
        held = lambda f: F.try_element_at(m, F.lit(f))
        listed = lambda f: list_values(F.coalesce(F.from_json(F.when(held(f).startswith("["), held(f)), "array<string>"), split_list(held(f))))
        return F.struct(*[plain_display(held(f)).alias(f) for f in SCALARS], *[listed(f).alias(f) for f in LISTS])

    return let(F.coalesce(given, F.create_map().cast("map<string,string>")), values)


def provided_fields(context: Column) -> Column:
    """Names of the fields of a context that hold something, in a fixed order."""
    names = [F.when(context[f] != "", f) for f in SCALARS] + [F.when(F.size(context[f]) > 0, f) for f in LISTS]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def candidates(requests: DataFrame, request: str, context: str = "context", hindi: bool | Column = False) -> DataFrame:
    """request, pos, key, field, canonical, variants, explicit: one row per value of a request's context."""
    scalars = [F.array(F.struct(F.lit(f).alias("field"), F.col(f"{context}.{f}").alias("value"))) for f in SCALARS]
    named = lambda f: lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    lists = [F.transform(F.col(f"{context}.{f}"), named(f)) for f in LISTS]
    rows = requests.select("*", F.posexplode(F.filter(F.concat(*scalars, *lists), lambda x: x["value"] != "")).alias("pos", "x"))
    made = variants_by_row(rows.withColumns({"field": F.col("x.field"), "value": F.col("x.value")}), "value", F.col("field"), hindi=hindi).filter(F.size("variants") > 0)
    first = F.get("variants", F.lit(0))
    return made.select(request, "pos", variant_key(first).alias("key"), "field", first.alias("canonical"), "variants", F.lit(True).alias("explicit"))


def request_packs(requests: DataFrame, base: DataFrame, request: str, most: int, context: str = "context", hindi: bool | Column = False) -> DataFrame:
    """request, lines, n_base, n_before, n_after, n_total, top, fields of every request that gives something.

    base (key, place, variants) is the pack that all requests share; lines are those of the request's own and merged
    groups, as the rest of base is the same for all. n_base and n_total count all groups.
    """
    known = requests.withColumn("fields", provided_fields(F.col(context))).filter(F.size("fields") > 0)
    all_ = candidates(known, request, context, hindi)
    best = ranked(all_, request, most)
    lines = phrase_pack(base, best, request).groupBy(request).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    before = all_.groupBy(request).agg(F.count_distinct("key").alias("n_before"))
    shown = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "canonical"))), 1, MOST_SHOWN), lambda x: x["canonical"])
    taken = best.groupBy(request).agg(F.count(F.lit(1)).alias("n_after"), shown.alias("top"))
    added = best.select(request, "key").join(base.select("key").distinct(), "key", "left_anti").groupBy(request).agg(F.count(F.lit(1)).alias("n_new"))
    n_base = F.lit(base.select("key").distinct().count())
    out = known.select(request, "fields").join(lines, request, "left").join(before, request, "left").join(taken, request, "left").join(added, request, "left")
    out = out.fillna(0, ["n_before", "n_after", "n_new"]).withColumn("n_total", n_base + F.col("n_new"))
    none = F.array().cast("array<string>")
    return out.select(request, F.coalesce("lines", none).alias("lines"), F.greatest(F.col("n_total") - F.col("n_after"), F.lit(0)).alias("n_base"), "n_before", "n_after", "n_total", F.coalesce("top", none).alias("top"), "fields")


def flat_phrases(lines: Column) -> Column:
    """The phrases of pack lines, each once in any case, without those that only spell letters out."""
    parts = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, "_"))), lambda p: F.trim(p)), lambda p: p != "")
    names = F.array(*[F.lit(n) for n in sorted(set(devanagari.LETTER_NAMES.values()))])
    spelled = lambda p: let(F.split(p, "\\s+"), lambda ts: (F.size(ts) > 1) & F.forall(ts, lambda t: (F.length(t) == 1) | F.array_contains(names, t)))
    kept = F.filter(parts, lambda p: ~spelled(p))
    lows = lambda ps: F.transform(ps, lambda p: F.lower(p))
    return let(kept, lambda ps: let(lows(ps), lambda ls: F.filter(ps, lambda p, i: F.array_position(ls, F.get(ls, i)) == i + 1)))


def with_surfaced(rows: DataFrame, text: str, value: str, out: str = "surfaced") -> DataFrame:
    """rows with whether the value, in any of its Latin or Devanagari forms, stands in the text, in any case."""
    staged = rows.withColumn("__shown", display(F.col(value)))
    low = F.lower(F.coalesce(text, F.lit("")))
    forms = distinct_variants(general_variants(F.col("__shown"), F.lit(True)))
    found = F.when((low == "") | (F.coalesce(value, F.lit("")) == ""), False).otherwise(F.exists(forms, lambda v: F.contains(low, F.lower(v))))
    return staged.withColumn(out, found).drop("__shown")
