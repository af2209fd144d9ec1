"""Hindi dates and cardinals that stand in where no grammar is at hand, and cardinals in Latin letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import lookup
from .spans import SPAN, matches, span

#: The numbers that stand-ins know.
NUMBERS = {
    "शून्य": 0, "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "पाँच": 5, "पांच": 5, "छह": 6, "सात": 7, "आठ": 8, "नौ": 9, "दस": 10,
    "ग्यारह": 11, "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15, "सोलह": 16, "सत्रह": 17, "अठारह": 18, "उन्नीस": 19, "बीस": 20,
    "इक्कीस": 21, "बाईस": 22, "तेईस": 23, "चौबीस": 24, "पच्चीस": 25, "छब्बीस": 26, "सत्ताईस": 27, "अट्ठाईस": 28, "उनतीस": 29, "तीस": 30, "इकतीस": 31,
}
LATIN_NUMBERS = {"nau": 9, "naur": 9, "tees": 30}
THOUSAND = ("हजार", "हज़ार", "hazar", "haazar")
MONTHS = {
    "जनवरी": 1, "फरवरी": 2, "फ़रवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितंबर": 9, "सितम्बर": 9,
    "अक्टूबर": 10, "नवंबर": 11, "नवम्बर": 11, "दिसंबर": 12, "दिसम्बर": 12,
}
LATIN_CARDINAL = "(?i)(?<![A-Za-z])(?:nau|naur)\\s+(?:hazar|haazar)\\s+tees(?![A-Za-z])"
DATE_RULE, CARDINAL_RULE, LATIN_RULE = "offline.hi.date_monthword.v1", "offline.hi.cardinal.v1", "offline.hi.cardinal.romanized.v1"
CONF = 0.99


def clean(raw: Column) -> Column:
    """Lower case, one space between words and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(raw), "[\\s\\x{85}\\p{Z}\\x{1c}-\\x{1f}]+", " "))


def _word(text: Column, i: int) -> Column:
    return F.get(F.split(text, " ", -1), F.lit(i))


def small_cardinal(text: Column, first: int = 0) -> Column:
    """The number of one known word of a cleaned text, or of one before a thousand and perhaps one behind it; else null. first: the word to begin with."""
    n = F.size(F.split(text, " ", -1)) - first
    latin = ~text.rlike("[^\\x00-\\x7F]") if first == 0 else F.lit(False)
    value = lambda i: F.when(latin, lookup(LATIN_NUMBERS, _word(text, i + first))).otherwise(lookup(NUMBERS, _word(text, i + first))).cast("int")
    tail = F.when(n == 2, F.lit(0)).otherwise(value(2))
    thousands = F.when(n.isin(2, 3) & _word(text, first + 1).isin(*THOUSAND), value(0) * 1000 + tail)
    return F.when(n == 1, value(0)).otherwise(thousands)


def month_date(text: Column) -> Column:
    """DD/MM of a day's and a month's word of a cleaned text, with /YY if a year from 1900 to 2099 stands behind them; else null."""
    day, month = lookup(NUMBERS, _word(text, 0)).cast("int"), lookup(MONTHS, _word(text, 1)).cast("int")
    n, year = F.size(F.split(text, " ", -1)), small_cardinal(text, 2)
    short = F.when((day >= 1) & month.isNotNull(), F.format_string("%02d/%02d", day, month))
    return F.when(n == 2, short).when((n > 2) & year.between(1900, 2099), F.concat(short, F.format_string("/%02d", year % 100)))


def with_stand_ins(df: DataFrame, spans: str, hindi: Column, out: str) -> DataFrame:
    """df with spans of which the Hindi dates and cardinals that a stand-in reads are its own, if they have no reason or no grammar was there."""

    def read(s: Column, text: Column) -> Column:
        return F.when(s["cls"] == "date", month_date(text)).when(s["cls"] == "cardinal", small_cardinal(text).cast("string"))

    def outcome(s: Column, value: Column) -> Column:
        free = (F.coalesce(s["fallback_reason"], F.lit("")) == "") | s["fallback_reason"].contains("wfst_unavailable")
        changed = F.struct(
            s["cls"].alias("cls"), s["raw"].alias("raw"), value.alias("canonical"), F.when(s["cls"] == "date", DATE_RULE).otherwise(CARDINAL_RULE).alias("rule_id"), F.lit(CONF).alias("conf"), F.lit(False).alias("ambiguous"),
            s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("fallback_reason"),
        )
        return F.when(value.isNotNull() & free, changed.cast(SPAN)).otherwise(s.cast(SPAN))

    # Each step is a column of its own: lambdas in lambdas are costly to analyse.
    staged = df.withColumn("__cleaned", F.when(hindi, F.transform(spans, lambda s: clean(s["raw"]))).otherwise(F.array().cast("array<string>")))
    staged = staged.withColumn("__values", F.zip_with(spans, "__cleaned", read))
    return staged.withColumn(out, F.zip_with(spans, "__values", outcome)).drop("__cleaned", "__values")


def latin_cardinals(text: Column) -> Column:
    """Spans of the cardinals that are known in Latin letters."""

    def one(m: Column) -> Column:
        return span(F.lit("cardinal"), m["raw"], m["start"], m["end"], F.lit(LATIN_RULE), CONF, small_cardinal(clean(m["raw"])).cast("string"))

    return F.transform(matches(text, LATIN_CARDINAL), one).cast(f"array<{SPAN}>")
