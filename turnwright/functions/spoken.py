"""Hindi number phrases in texts, by patterns over token classes.

Every token becomes one letter that says what it is, so a text becomes a short string in which phrases are patterns and
a letter's place is the token's number. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import DIGIT_WORDS
from .grammar import lookup
from .lexicon import HI, HI_MONTHS, HI_NUMBERS, PAISE, RUPEES
from .spans import SPAN, matches, span

TOKEN = "[^\\s\\x{85}\\p{Z}\\x{1c}-\\x{1f},.;:!?()\\[\\]\"'।]+"
_NATIVE = {w for n, words in HI_NUMBERS.items() for w in (words[:2] if n in (5, 6) else words[:1] if n < 11 else words)}
_BORROWED = {w for words in HI_NUMBERS.values() for w in words} - _NATIVE
#: Token classes in letters; a token has the first class that names it.
CLASSES = {
    "d": _NATIVE & set(DIGIT_WORDS),
    "z": {"जीरो", "ज़ीरो"},
    "n": _NATIVE - set(DIGIT_WORDS),
    "s": {"सौ", "हज़ार", "हजार", "लाख", "करोड़", "करोड", "अरब"},
    "c": _BORROWED,
    "x": set(HI.hundred[1:]) | set(HI.thousand[2:]),
    "p": {"सवा", "डेढ़", "डेढ", "ढाई", "साढ़े", "साढे", "पौने"},
    "m": {"दशमलव"},
    "R": {*RUPEES, "rupee", "rupees", "₹"},
    "A": set(PAISE),
    "P": {"प्रतिशत", "फीसदी", "फ़ीसदी", "percent", "%"},
    "T": {"सुबह", "दोपहर", "शाम", "रात", "am", "pm", "a.m.", "p.m."},
    "B": {"बजे"},
    "K": {"बजकर"},
    "I": {"मिनट"},
    "F": {"phone", "mobile", "number", "otp", "फ़ोन", "फोन", "मोबाइल", "नंबर", "नम्बर", "ओटीपी"},
    "M": {w for words in HI_MONTHS for w in words.split()},
    "G": {"तारीख", "तारीख़", "दिनांक", "date"},
}
NATIVE, ANY = "[dnspm]", "[dnspmcx]"


def _letters(tokens: Column) -> Column:
    table = {w: code for code, words in CLASSES.items() for w in sorted(words)}
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(lookup(table, F.lower(t["raw"])), F.lit("."))), "")


def _places(letters: Column, pattern: str, cls: str, after: str = "", needs: str = "") -> Column:
    """Structs (cls, a, b) of token places; `after` is what else the phrase takes if it stands behind the match, `needs` a letter it has."""
    more = lambda m: F.length(F.regexp_extract(F.substr(letters, m["end"] + 1), f"^(?:{after})", 0)) if after else F.lit(0)
    return F.transform(matches(letters, pattern, letters.contains(needs) if needs else None), lambda m: F.struct(F.lit(cls).alias("cls"), m["start"].alias("a"), (m["end"] + more(m)).alias("b")))


def phrases(letters: Column) -> Column:
    runs = _places(letters, f"{ANY}+", "cardinal")

    def number(r: Column) -> Column:
        run = F.substr(letters, r["a"] + 1, r["b"] - r["a"])
        marker = F.instr(run, "m")
        fine = F.when(marker > 0, (marker > 1) & (marker < F.length(run))).otherwise(~run.rlike("^d{5,}$")) & (F.length(run) <= 8)
        return F.when(fine, F.struct(F.when(marker > 0, "decimal").otherwise("cardinal").alias("cls"), r["a"].alias("a"), r["b"].alias("b")))

    ten = F.filter(_places(letters, "(?<![dz])[dz]{10}(?![dz])", "phone", needs="F"), lambda r: F.substr(letters, F.greatest(r["a"] - 3, F.lit(1)), r["b"] + 5 - F.greatest(r["a"] - 3, F.lit(1))).contains("F"))
    return F.concat(
        _places(letters, f"{NATIVE}{{1,8}}R", "amount", f"{NATIVE}{{1,2}}A", "R"), _places(letters, f"R{NATIVE}{{1,8}}", "amount", needs="R"),
        _places(letters, f"{ANY}{{1,8}}P", "percent", needs="P"), _places(letters, f"T?{ANY}{{1,4}}B", "time", "T", "B"), _places(letters, f"T?{ANY}{{1,2}}K{ANY}{{1,2}}I", "time", "T", "K"),
        _places(letters, "[dn]M", "date", f"{ANY}{{0,4}}", "M"), _places(letters, f"(?<=G){ANY}{{1,4}}", "date", needs="G"), ten, F.filter(F.transform(runs, number), lambda r: r.isNotNull()),
    )


def spoken_spans(text: Column, tokens: Column, letters: Column) -> Column:
    """tokens: matches(text, TOKEN); letters: their classes. Distinct spans of all phrases, overlapping ones too."""
    found = F.array_distinct(F.transform(phrases(letters), lambda r: F.struct(r["cls"].alias("cls"), F.get(tokens, r["a"])["start"].alias("start"), F.get(tokens, r["b"] - 1)["end"].alias("end"))))
    return F.transform(found, lambda r: span(r["cls"], F.substr(text, r["start"] + 1, r["end"] - r["start"]), r["start"], r["end"], F.concat(F.lit("spoken."), r["cls"], F.lit(".v1")))).cast(f"array<{SPAN}>")


def with_spoken(df, text: str, lang: str, out: str):
    """df with spans of number phrases where the language is Hindi, else none."""
    hindi = F.when(F.col(lang) == "hi", F.col(text)).otherwise("")
    staged = df.withColumn("__tokens", matches(hindi, TOKEN)).withColumn("__letters", _letters(F.col("__tokens")))
    return staged.withColumn(out, spoken_spans(F.col(text), F.col("__tokens"), F.col("__letters"))).drop("__tokens", "__letters")
