"""Typed spans in texts: where patterns match, which of them stay, and the text with their canonical forms.

A span is a struct (SPAN); a text's spans are one array, so that no row is exploded. Offsets count characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<cls:string,raw:string,canonical:string,rule_id:string,conf:double,ambiguous:boolean,start:int,end:int,fallback_reason:string>"
_WORD = "[\\p{L}\\p{N}_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SPACE = "[\\s\\x{85}\\p{Z}\\x{1c}-\\x{1f}]"
_DIGIT = "\\p{Nd}"

#: Written forms in order of precedence. b, s and d stand for a word edge, white space and a digit.
_WRITTEN = {
    "url": r"(?i)(?:(?:https?|ftp)://[^{s}<>\"']+|{b}www\.[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?:/[^{s}<>\"']*)?)",
    "email": r"{b}[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+{b}",
    "ifsc": r"(?i){b}[A-Z]{4}0[A-Z0-9]{6}{b}",
    "pan": r"(?i){b}[A-Z]{5}{d}{4}[A-Z]{b}",
    "aadhaar": r"(?<!\+){b}[2-9]{d}{3}(?:{s}|-)?{d}{4}(?:{s}|-)?{d}{4}{b}",
    "phone": r"(?<![A-Za-z]|{d})(?:(?:\+|00)?91(?:{s}|[\-.])?|0(?=[6-9]))?[6-9]{d}{9}(?![A-Za-z]|{d})",
    "date": r"{b}(?:0?[1-9]|[12]{d}|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.]{d}{2}(?:{d}{2})?{b}",
    "time": r"(?<![A-Za-z:]|{d})(?:[01]?{d}|2[0-3]):[0-5]{d}(?::[0-5]{d})?(?:{s}?(?:AM|PM|am|pm|a\.m\.|p\.m\.))?(?![A-Za-z:]|{d})",
    "amount": r"(?i)(?:₹|Rs\.?|INR|US\$|\$|USD|£|GBP|€|EUR){s}?{d}{1,3}(?:,{d}{2,3})*(?:\.{d}{1,2})?",
    "percent": r"{b}{d}+(?:\.{d}+)?{s}?%",
}
PATTERNS = {cls: p.replace("[^{s}", "[^\\s\\x{85}\\p{Z}\\x{1c}-\\x{1f}").replace("{s}", _SPACE).replace("{b}", _EDGE).replace("{d}", _DIGIT) for cls, p in _WRITTEN.items()}


_FOUND = "array<struct<start:int,end:int,raw:string>>"


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<start, end, raw>> of all matches, from the gaps between them and the matches themselves.

    guard: a cheap test that holds wherever the pattern may match; other texts are not searched. What this builds on is
    written once, and no lambda holds another: analysis takes twice the time for each level of them.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["raw"])
        more = F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["raw"].alias("raw")))).alias("out"))
        return F.when(x["raw"].isNull(), acc).otherwise(more)  # the last gap has no match behind it

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("raw")))
    there = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(there, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_FOUND))


def span(cls: Column, raw: Column, start: Column, end: Column, rule_id: Column, conf: float = 1.0, canonical: Column | None = None) -> Column:
    return F.struct(
        cls.alias("cls"), raw.alias("raw"), (raw if canonical is None else canonical).alias("canonical"), rule_id.alias("rule_id"), F.lit(conf).alias("conf"),
        F.lit(False).alias("ambiguous"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(None).cast("string").alias("fallback_reason"),
    )


def selected(candidates: Column, keys: str) -> Column:
    """Greedy choice of spans that do not overlap, in the order of an array of (keys..., span) structs; by start then."""
    meets = lambda x, y: (x["span"]["start"] < y["span"]["end"]) & (y["span"]["start"] < x["span"]["end"])
    none = F.array().cast(f"array<struct<{keys},span:{SPAN}>>")
    return _in_order(F.aggregate(F.array_sort(candidates), none, lambda acc, x: F.when(F.exists(acc, lambda y: meets(x, y)), acc).otherwise(F.concat(acc, F.array(x)))))


def _in_order(kept: Column) -> Column:
    by_start = F.array_sort(F.transform(kept, lambda x: F.struct(x["span"]["start"].alias("at"), x["span"].alias("span"))))
    return F.transform(by_start, lambda x: x["span"])


def text_has_digit(text: Column) -> Column:
    return text.rlike("\\p{Nd}")


#: Cheap tests of what a written form cannot be without; the others hold a digit.
_GUARDS = {"url": lambda text: text.contains("://") | text.rlike("[wW]{3}\\."), "email": lambda text: text.contains("@"), "percent": lambda text: text.contains("%"), "time": lambda text: text.contains(":")}


def _ranked(rank: int, cls: str):
    rule = f"prefilter.{cls}.v1"
    return lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("at"), span(F.lit(cls), m["raw"], m["start"], m["end"], F.lit(rule)).alias("span"))


def prefilter(text: Column) -> Column:
    """Spans of written forms that do not overlap: the earlier pattern wins, then the earlier place."""
    found = []
    for rank, (cls, pattern) in enumerate(PATTERNS.items(), 1):
        found.append(F.transform(matches(text, pattern, _GUARDS.get(cls, text_has_digit)(text)), _ranked(rank, cls)))
    return F.when(text.rlike("[\\p{Nd}@]|www|WWW|//|[wW]{3}"), selected(F.concat(*found), "rank:int,at:int")).otherwise(F.array().cast(f"array<{SPAN}>"))


def applied(text: Column, spans: Column) -> Column:
    """The text with every located span's canonical form; a span that begins before the last one ended is left out."""
    located = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    ordered = F.array_sort(F.transform(located, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["canonical"].alias("canonical"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, s["canonical"])).alias("out")))

    whole = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, first, step, whole)).otherwise(text)
