"""Language labels and codes, sets of languages, and which currency words a language and tenant take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import let, lookup

#: Names of languages by code; `<code>-in` stands for the code, too.
LANGUAGE_NAMES = {
    "hi": ("hindi", "hin"), "te": ("telugu", "tel"), "ta": ("tamil", "tam"), "mr": ("marathi", "mar"), "gu": ("gujarati", "guj"), "kn": ("kannada", "kan"), "ml": ("malayalam", "mal"), "pa": ("punjabi", "pan"),
    "bn": ("bengali", "ben"), "ur": ("urdu", "urd"), "or": ("odia",), "as": ("assamese",), "kok": ("konkani",), "sa": ("sanskrit",), "ne": ("nepali", "nep"), "sd": ("sindhi", "snd"),
}
ALIASES = {name: code for code, names in LANGUAGE_NAMES.items() for name in (*names, f"{code}-in")}
#: By language or language and region, the words and signs for the currency and its hundredth, and the written sign.
CURRENCY_CUES = {
    "hi": (("रुपये", "रुपया", "रू", "₹", "Rs", "Rs.", "INR"), "₹", ("पैसे", "पैसा")),
    "mr": (("रुपये", "रुपया", "रू", "₹", "Rs", "Rs.", "INR"), "₹", ("पैसे", "पैसा")),
    "bn": (("টাকা", "রুপি", "রুপী", "রুপিয়া", "₹", "Rs", "Rs.", "INR"), "₹", ("পয়সা", "পয়সে")),
    "bn-BD": (("টাকা", "৳", "BDT", "Tk", "Tk."), "৳", ("পয়সা", "পয়সে")),
}


def clean_label(label: Column) -> Column:
    """Lower case, runs of anything but a-z as one hyphen, none at the ends."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, "[^a-z]+", "-"), "^-|-$", "")


def supported_code(label: Column, supported: Column) -> Column:
    """The first of a label, its part before a hyphen and what both stand for that is in the array `supported`; else null."""

    def among(clean: Column) -> Column:
        base = F.substring_index(clean, "-", 1)
        asked = F.array(clean, base, lookup(ALIASES, clean), lookup(ALIASES, base))
        return F.get(F.filter(asked, lambda c: c.isNotNull() & (c != "") & F.array_contains(supported, c)), F.lit(0))

    return let(clean_label(label), among)


def effective_languages(known: Column, asked: Column) -> Column:
    """The asked languages that are known, sorted; all known ones if none are asked; null, an error to the caller, if none of those asked is known."""
    both = F.array_sort(F.array_intersect(known, asked))
    return F.when(F.coalesce(F.size(asked), F.lit(0)) <= 0, F.array_sort(known)).when(F.size(both) > 0, both)


def ignored_languages(known: Column, asked: Column) -> Column:
    """The asked languages that are not known, sorted."""
    return F.array_sort(F.array_except(F.coalesce(asked, F.array().cast("array<string>")), known))


def currency_sign(language: Column, region: Column) -> Column:
    """The written sign by language and region, else by language, else null: the default rule then holds."""
    signs = {key: sign for key, (_, sign, _) in CURRENCY_CUES.items()}
    return F.coalesce(lookup(signs, F.concat_ws("-", language, F.nullif(region, F.lit("")))), lookup(signs, language))


def has_currency_cue(text: Column, language: Column, region: Column) -> Column:
    """Whether one of the words or signs for the language's and region's currency stands in the text; null without a rule."""
    words = {key: "\x1f".join(accept) for key, (accept, _, _) in CURRENCY_CUES.items()}
    mine = F.coalesce(lookup(words, F.concat_ws("-", language, F.nullif(region, F.lit("")))), lookup(words, language))
    return F.exists(F.split(mine, "\x1f"), lambda w: text.contains(w))


DECODERS = ("ctc", "rnnt")
LEAST_CONFIDENCE = 0.7


def asked_language(label: Column, supported: Column) -> Column:
    """A request's language, trimmed and in lower case; null for none or `auto`; an error for one that is not in the array `supported`."""

    def checked(code: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit("unsupported language "), code, F.lit("; supported: "), F.array_join(F.array_sort(supported), ", ")))
        return F.when(~code.isin("", "auto"), F.when(F.array_contains(supported, code), code).otherwise(wrong))

    return let(F.lower(F.trim(F.coalesce(label, F.lit("")))), checked)


def decoder(asked: Column, default: str = "rnnt") -> Column:
    """The asked decoder if it is known, else the default if that is known, else rnnt."""
    known = default.strip().lower() if default.strip().lower() in DECODERS else "rnnt"
    return let(F.lower(F.trim(F.coalesce(asked, F.lit("")))), lambda d: F.when(d.isin(*DECODERS), d).otherwise(known))


def accepted_language(label: Column, confidence: Column, supported: Column, otherwise: str | None = None) -> Column:
    """The supported language of a detected label if the confidence is 0.7 or more and there is one; else `otherwise`. Nulls are not accepted."""
    return F.coalesce(F.when(confidence >= LEAST_CONFIDENCE, supported_code(label, supported)), F.lit(otherwise))
