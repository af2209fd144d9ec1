"""A strict parser of dates in digits and month names: all readings of the fields are tried, and one must stand out."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, lookup
from .lexicon import EN_MONTHS, HI_MONTHS

ORDERS = ("DMY", "MDY", "YMD")
MIN_CONFIDENCE = 0.85
#: Months by language, and words that may stand beside a date.
MONTHS = {"en": {w.lower(): m for m, names in enumerate(EN_MONTHS, 1) for w in names.split()}, "hi": {w: m for m, names in enumerate(HI_MONTHS, 1) for w in names.split()}}
BESIDE = {
    "en": "the of on date dated day monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun".split(),
    "hi": "को तारीख तारीख़ दिनांक सोमवार मंगलवार बुधवार गुरुवार शुक्रवार शनिवार रविवार".split(),
}
NUMERIC = "^\\s*\\p{Nd}{1,4}\\s*[/\\-.]\\s*\\p{Nd}{1,2}\\s*[/\\-.]\\s*\\p{Nd}{1,4}\\s*$"
_DEVANAGARI, _ASCII = "०१२३४५६७८९", "0123456789"


def fields(raw: Column, languages: tuple[str, ...] = ("hi", "en")) -> Column:
    """array<struct<n, width, month>>: numbers and months in order; a null for a word that is neither nor may stand beside a date.

    Ordinal endings, separators and a break between letters and digits are taken out.
    """
    months = {w: m for code in languages for w, m in MONTHS[code].items()}
    beside = [w for code in languages for w in BESIDE[code]]
    low = F.translate(F.lower(raw), _DEVANAGARI, _ASCII)
    plain = F.regexp_replace(low, "(?<=[0-9])(?:st|nd|rd|th)(?![\\p{L}\\p{M}])", "")
    apart = F.regexp_replace(plain, "(?<=[0-9])(?=[\\p{L}])|(?<=[\\p{L}\\p{M}])(?=[0-9])", " ")
    parts = F.filter(F.split(apart, "[\\s\\p{Z},/.\\-]+"), lambda p: (p != "") & ~p.isin(*beside))

    def field(p: Column) -> Column:
        number = F.struct(p.cast("int").alias("n"), F.length(p).alias("width"), F.lit(None).cast("int").alias("month"))
        name = F.struct(F.lit(None).cast("int").alias("n"), F.lit(0).alias("width"), lookup(months, p).cast("int").alias("month"))
        return F.when(p.rlike("^[0-9]{1,4}$") & ~p.rlike("^[0-9]{3}$"), number).when(p.isin(*months), name)

    return F.transform(parts, field)


def _reading(fs: Column, order: str) -> Column:
    """The date if the three fields are read in this order and are one; else null."""
    day, month, year = (F.get(fs, F.lit(order.index(c))) for c in "DMY")
    full = F.when(year["width"] == 4, year["n"]).when(year["width"] == 2, F.when(year["n"] < 69, year["n"] + 2000).otherwise(year["n"] + 1900))
    d, m = F.when(day["width"].between(1, 2), day["n"]), F.coalesce(month["month"], F.when(month["width"].between(1, 2), month["n"]))
    made = F.when((d >= 1) & (m.between(1, 12)) & (full >= 1), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", full, m, d), F.lit("yyyy-MM-dd")))
    return F.date_format(made, "dd/MM/yyyy")


def strict_date(raw: Column, order: Column, languages: tuple[str, ...] = ("hi", "en")) -> Column:
    """DD/MM/YYYY if day, month and year are all there, and either one date can be read or the order says which; else null.

    A month's name is the month and four digits the year, wherever they stand. A year of four digits before two numbers is
    followed by month and day. Two digits are a year from 1969 to 2068. With a month's name, two digits each for day and year
    are day first, but year first under YMD.
    """

    def read(fs: Column) -> Column:
        whole = (F.size(fs) == 3) & ~F.exists(fs, lambda f: f.isNull())
        named = F.exists(fs, lambda f: f["month"].isNotNull())
        first_year = F.get(fs, F.lit(0))["width"] == 4
        by = {"".join(p): _reading(fs, "".join(p)) for p in permutations("DMY")}
        every = F.filter(F.array_distinct(F.array(*by.values())), lambda x: x.isNotNull())
        own = F.when(order == "DMY", by["DMY"]).when(order == "MDY", by["MDY"]).when(order == "YMD", by["YMD"])
        month_last = F.when(order == "YMD", F.coalesce(by["YMD"], by["YDM"], by["MYD"])).otherwise(F.coalesce(by["DMY"], by["MDY"], by["DYM"]))
        chosen = F.when(first_year & ~named, by["YMD"]).when(F.size(every) == 1, F.get(every, F.lit(0))).when(named, month_last).otherwise(own)
        return F.when(whole, chosen)

    return let(fields(raw, languages), read)


def parsed_date(
    raw: Column, order: Column, classifier_conf: Column, asr_conf: Column, context: Column | None = None, cue: Column | None = None, languages: tuple[str, ...] = ("hi", "en"),
    classifier_min: float = MIN_CONFIDENCE, asr_min: float = MIN_CONFIDENCE,
) -> Column:
    """struct(canonical, reason); the reason is low_confidence, missing_date_cue, dateparser_unavailable or dateparser_no_parse.

    Tests come in that order. Numbers with separators need no cue under DMY. A language without a table of months makes the
    parser unavailable. Nulls: a confidence is low, a text without a cue.
    """
    from ..operators.itn import has_date_cue

    if cue is None:
        cue = has_date_cue(F.coalesce(context, raw) if context is not None else raw)
    low = ~(F.coalesce(classifier_conf >= classifier_min, F.lit(False)) & F.coalesce(asr_conf >= asr_min, F.lit(False)))
    allowed = F.coalesce(cue, F.lit(False)) | F.coalesce((order == "DMY") & raw.rlike(NUMERIC), F.lit(False))
    known = all(code in MONTHS for code in languages)
    value = F.when(~low & allowed, strict_date(raw, order, languages)) if known else F.lit(None).cast("string")
    reason = lambda v: F.when(low, "low_confidence").when(~allowed, "missing_date_cue").when(F.lit(not known), "dateparser_unavailable").when(v.isNull(), "dateparser_no_parse")
    return let(value, lambda v: F.struct(v.alias("canonical"), reason(v).alias("reason")))
