"""Script histogram, Hindi or Marathi by weighted words, and the language a segment is routed to."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import let

#: Scripts and the languages they stand for. Latin gives way to another script with as many characters.
SCRIPT_LANGS = {"Devanagari": "hi", "Bengali": "bn", "Gurmukhi": "pa", "Gujarati": "gu", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Arabic": "ur", "Latin": "en"}
TRUSTED = ("hi", "mr", "bn", "ta", "te", "kn", "ml", "gu", "pa", "ur", "en")
#: Words that speak for a language, by weight.
MR_CUES = {
    2.0: "वाजता वाजून संध्याकाळी दीड अडीच पावणे टक्के पाचशे दोनशे तीनशे चारशे सहाशे सातशे आठशे नऊशे एकशे जानेवारी फेब्रुवारी जुलै ऑगस्ट सप्टेंबर ऑक्टोबर नोव्हेंबर डिसेंबर",
    1.5: "मिनिटे मिनिटं सकाळी दुपारी रात्री साडे टक्का कोटी सोळा शंभर दशांश एप्रिल",
    1.0: "सव्वा दोन सहा नऊ दहा अकरा बारा तेरा चौदा पंधरा सतरा अठरा",
}
HI_CUES = {
    2.0: "बजे बजकर डेढ़ ढाई पौने फीसदी फ़ीसदी जनवरी फरवरी फ़रवरी अप्रैल जुलाई अगस्त सितंबर सितम्बर अक्टूबर नवंबर नवम्बर दिसंबर दिसम्बर",
    1.5: "साढ़े करोड़",
    1.0: "ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह उन्नीस",
}
MARGIN = 0.5


_OTHERS = "[" + "".join(f"\\p{{Is{s}}}" for s in SCRIPT_LANGS if s != "Latin") + "]"


def script_of(text: Column) -> Column:
    """The script of most characters; `Common` if no character is of a known script.

    Characters are counted only where there are some of another script than Latin; what is not of a script is taken out in runs.
    """
    held = lambda s: F.length(F.regexp_replace(text, f"\\P{{Is{s}}}+", ""))
    counts = F.array(*[F.struct((-held(s)).alias("n"), F.lit(int(s == "Latin")).alias("late"), F.lit(s).alias("script")) for s in SCRIPT_LANGS])
    return F.when(text.rlike(_OTHERS), F.array_min(counts)["script"]).when(text.rlike("\\p{IsLatin}"), "Latin").otherwise("Common")


def cue_score(text: Column, cues: dict[float, str]) -> Column:
    """Sum of weights of the words found, the longest at each place."""
    weights = {w: weight for weight, words in cues.items() for w in words.split()}
    pattern = "|".join(re.escape(w) for w in sorted(weights, key=lambda w: (-len(w), w)))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(found, F.lit(0.0), lambda acc, w: acc + F.element_at(table, w))


def routed(text: Column, hint: Column | None = None, romanized: Column | None = None) -> Column:
    """struct(lang, script, source, needs_lid)."""
    none = F.lit(None).cast("string")
    hint, romanized = hint if hint is not None else none, romanized if romanized is not None else none
    by_script = F.create_map(*[F.lit(x) for pair in SCRIPT_LANGS.items() for x in pair], F.lit("Common"), F.lit("und"))

    def route(script: Column) -> Column:
        latin = script == "Latin"
        cues = F.when(script == "Devanagari", cue_score(text, MR_CUES) - cue_score(text, HI_CUES))
        source = (
            F.when(hint.isin(*TRUSTED), "asr_hint").when(latin & romanized.isin(*TRUSTED), "romanized_hint")
            .when(cues > MARGIN, "script_majority_mr_keywords").when(script == "Common", "unknown").otherwise("script_majority")
        )

        def named(s: Column) -> Column:
            lang = F.when(s == "asr_hint", hint).when(s == "romanized_hint", romanized).when(s == "script_majority_mr_keywords", "mr").otherwise(F.element_at(by_script, script))
            needs = s.isin("script_majority", "unknown") & (latin | (script == "Common"))
            return F.struct(lang.alias("lang"), script.alias("script"), s.alias("source"), needs.alias("needs_lid"))

        return let(source, named)

    return let(script_of(text), route)
