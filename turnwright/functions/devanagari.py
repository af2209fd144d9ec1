"""Devanagari forms of Latin names and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import DEVANAGARI, LATIN
from .grammar import let, lookup

#: Vowels by themselves and as signs behind a consonant.
VOWELS = {"a": "अ", "aa": "आ", "ai": "ऐ", "au": "औ", "e": "ए", "ee": "ई", "i": "इ", "ii": "ई", "o": "ओ", "oa": "ओ", "oo": "ऊ", "ou": "औ", "u": "उ", "uu": "ऊ"}
VOWEL_SIGNS = {"a": "", "aa": "ा", "ai": "ै", "au": "ौ", "e": "े", "ee": "ी", "i": "ि", "ii": "ी", "o": "ो", "oa": "ो", "oo": "ू", "ou": "ौ", "u": "ु", "uu": "ू"}
#: Consonants.
CONSONANTS = {
    "b": "ब", "bh": "भ", "c": "क", "ch": "च", "chh": "छ", "d": "द", "dh": "ध", "f": "फ", "g": "ग", "gh": "घ", "h": "ह", "j": "ज", "jh": "झ", "k": "क", "kh": "ख", "ksh": "क्ष", "l": "ल", "m": "म",
    "n": "न", "p": "प", "ph": "फ", "q": "क", "r": "र", "s": "स", "sh": "श", "t": "त", "th": "थ", "v": "व", "w": "व", "x": "क्स", "y": "य", "z": "ज",
}
#: Names of letters.
LETTER_NAMES = {
    "A": "ए", "B": "बी", "C": "सी", "D": "डी", "E": "ई", "F": "एफ", "G": "जी", "H": "एच", "I": "आई", "J": "जे", "K": "के", "L": "एल", "M": "एम", "N": "एन", "O": "ओ", "P": "पी", "Q": "क्यू",
    "R": "आर", "S": "एस", "T": "टी", "U": "यू", "V": "वी", "W": "डब्ल्यू", "X": "एक्स", "Y": "वाई", "Z": "जेड",
}
#: Months, each with all its spellings.
MONTHS = {1: ("जनवरी",), 2: ("फरवरी", "फ़रवरी"), 3: ("मार्च",), 4: ("अप्रैल",), 5: ("मई",), 6: ("जून",), 7: ("जुलाई",), 8: ("अगस्त",), 9: ("सितंबर", "सितम्बर"), 10: ("अक्टूबर",), 11: ("नवंबर", "नवम्बर"), 12: ("दिसंबर", "दिसम्बर")}
VIRAMA, MOST_VARIANTS = "्", 4
_UNITS = "|".join([*sorted(VOWELS, key=len, reverse=True), *sorted(CONSONANTS, key=len, reverse=True)])
_TOKEN = "[A-Za-z]+"
_NONE = "array<string>"


def digits(text: Column) -> Column:
    """The text with Devanagari digits."""
    return F.translate(text, LATIN, DEVANAGARI)


def rendered(word: Column) -> Column:
    """A lower-case Latin word by its longest vowels and consonants; consonants that meet are joined."""
    is_vowel = lambda u: F.substring(u, 1, 1).isin("a", "e", "i", "o", "u")

    def spelled(units: Column) -> Column:
        def unit(u: Column, i: Column) -> Column:
            before, after = F.get(units, i - 1), F.get(units, i + 1)
            sign = F.when((i > 0) & ~is_vowel(before), lookup(VOWEL_SIGNS, u)).otherwise(lookup(VOWELS, u))
            joined = F.concat(lookup(CONSONANTS, u), F.when(after.isNotNull() & ~is_vowel(after), VIRAMA).otherwise(""))
            return F.when(is_vowel(u), sign).otherwise(joined)

        return F.array_join(F.transform(units, unit), "")

    return let(F.regexp_extract_all(word, F.lit(_UNITS), F.lit(0)), spelled)


def token_variants(token: Column) -> Column:
    """The ways to write a token of Latin letters: names of letters for short capitals, else by sound and common endings."""
    names = F.transform(F.split(token, ""), lambda c: lookup(LETTER_NAMES, c))
    acronym = F.array(F.array_join(names, ""), F.array_join(names, " "))

    def by_sound(low: Column) -> Column:
        def forms(out: Column) -> Column:
            drop = lambda n: F.substring(out, F.lit(1), F.length(out) - n)
            return F.array(
                out, F.when(low.startswith("a") & (F.length(low) >= 5) & out.startswith("अ"), F.concat(F.lit("आ"), F.substring(out, F.lit(2), F.length(out)))),
                F.when(low.endswith("iya") & out.endswith("य"), F.concat(out, F.lit("ा"))), F.when(low.endswith("umar") & out.endswith("मर"), F.concat(drop(2), F.lit("मार"))),
                F.when(low.endswith("rma") & out.endswith("र्म"), F.concat(out, F.lit("ा"))),
            )

        return let(rendered(low), forms)

    return F.array_distinct(F.filter(F.when(token.rlike("^[A-Z]{2,8}$"), acronym).otherwise(let(F.lower(token), by_sound)), lambda v: v.isNotNull()))


def script_variants(text: Column, most: int = MOST_VARIANTS) -> Column:
    """The first `most` ways to write a text's Latin tokens in Devanagari, other characters as they are; none without such tokens."""
    tokens, gaps = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.split(text, _TOKEN, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(tokens)), tokens, lambda g, t: F.struct(g.alias("gap"), token_variants(t).alias("ways")))
    longer = lambda acc, x: F.slice(F.array_distinct(F.flatten(F.transform(acc, lambda p: F.transform(x["ways"], lambda w: F.concat(p, x["gap"], w))))), 1, most)
    made = F.aggregate(steps, F.array(F.lit("")), longer)
    ended = F.transform(made, lambda v: F.trim(F.concat(v, F.element_at(gaps, -1))))
    kept = F.filter(F.array_distinct(ended), lambda v: (v != "") & (v != F.trim(text)))
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) > 0, kept).otherwise(F.array().cast(_NONE))


def date_variants(day: Column) -> Column:
    """Written Hindi forms of a day: five numeric ones, and day, month and year in both orders and digits for each spelling."""
    number = lambda x: x.cast("string")
    d, m, y, padded = number(F.dayofmonth(day)), number(F.month(day)), number(F.year(day)), F.date_format(day, "dd")
    numeric = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "dd-MM-yyyy"), F.concat_ws("/", d, m, y), F.concat_ws("-", d, m, y)]
    months = F.get(F.array(*[F.array(*map(F.lit, names)) for names in MONTHS.values()]), F.month(day) - 1)

    def spelled(name: Column) -> Column:
        latin = [F.concat_ws(" ", d, name, y), F.concat_ws(" ", padded, name, y), F.concat_ws(" ", name, d, y), F.concat_ws(" ", name, padded, y)]
        return F.array(*latin, *map(digits, latin))

    return F.concat(F.array(*map(digits, numeric)), F.flatten(F.transform(months, spelled)))
