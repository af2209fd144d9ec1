"""Identifiers, phone numbers and amounts as column expressions; null where a string has not the asked form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grammar import let, lookup

#: Digits said as words, in phone numbers.
DIGIT_WORDS = {"शून्य": "0", "जीरो": "0", "ज़ीरो": "0", "एक": "1", "दो": "2", "तीन": "3", "चार": "4", "पाँच": "5", "पांच": "5", "छह": "6", "छः": "6", "सात": "7", "आठ": "8", "नौ": "9"}
#: Words that announce an identifier.
ID_CUES = (
    "account", "acct", "a/c", "ac", "policy", "loan", "customer", "cust", "reference", "ref", "id", "number", "no",
    "खाता", "खाते", "अकाउंट", "अकाउण्ट", "पॉलिसी", "पालिसी", "लोन", "ऋण", "ग्राहक", "कस्टमर", "रेफरेंस", "रेफ़रेंस", "संदर्भ", "आईडी", "नंबर",
)
DEVANAGARI, LATIN = "०१२३४५६७८९", "0123456789"


def indian_grouping(digits: Column, sep: str = ",") -> Column:
    """Three digits, then twos; an error where the string is no integer without leading zeros."""
    fine = digits.rlike("^(?:0|[1-9][0-9]*)$")
    spaced = F.regexp_replace(digits, "(?<=[0-9])(?=(?:[0-9][0-9])+[0-9]$)", sep)
    return F.when(digits.isNull() | fine, spaced).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), digits)))


def inr(amount: Column) -> Column:
    return F.concat(F.lit("₹"), indian_grouping(amount.cast("long").cast("string")))


def indian_mobile(text: Column) -> Column:
    """+91 XXXXX XXXXX."""
    seps = "[ .()-]+"
    tokens = F.split(F.trim(F.regexp_replace(text, "[\\s\\p{Z}]+", " ")), " ")

    def digits(t: Column) -> Column:
        bare = F.regexp_replace(F.translate(t, DEVANAGARI, LATIN), seps, "")
        return F.coalesce(lookup(DIGIT_WORDS, t), let(bare, lambda b: F.when(b.rlike("^(?:|\\+?\\p{Nd}+)$"), b)))

    joined = let(F.transform(tokens, digits), lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, "")))
    form = "^(?:\\+91|91|0)?([6-9][0-9]{4})([0-9]{5})$"
    return let(joined, lambda j: F.when(j.rlike(form), F.regexp_replace(j, form, "+91 $1 $2")))


def pan(text: Column) -> Column:
    up = F.upper(F.trim(text))
    return F.when(up.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), up)


def ifsc(text: Column) -> Column:
    up = F.upper(F.trim(text))
    return F.when(up.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), up)


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of a pentagon; 0 to 4 turn, 5 to 9 mirror."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permutations() -> list[list[int]]:
    """Powers of the check's digit permutation (1 5 8 9 4 2 7 0)(3 6)."""
    step = {1: 5, 5: 8, 8: 9, 9: 4, 4: 2, 2: 7, 7: 0, 0: 1, 3: 6, 6: 3}
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([step[d] for d in rows[-1]])
    return rows


def verhoeff_remainder(digits: Column, first: int = 0) -> Column:
    """0 for a number with a right check digit; first=1 for a number whose check digit is still to come."""
    product = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    turned = F.array(*[F.lit(x) for row in _permutations() for x in row])
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.get(turned, F.pmod(i + first, F.lit(8)) * 10 + d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, d: F.get(product, acc * 10 + d))


def verhoeff_digit(digits: Column) -> Column:
    return F.get(F.array(*[F.lit(next(b for b in range(10) if _dihedral(a, b) == 0)) for a in range(10)]), verhoeff_remainder(digits, 1)).cast("string")


def aadhaar(text: Column, checked: bool = True) -> Column:
    """XXXX XXXX XXXX."""
    bare = F.when(F.trim(text).rlike("^[0-9 -]+$"), F.regexp_replace(text, "[ -]", ""))
    number = F.when(bare.rlike("^[0-9]{12}$"), bare)
    right = F.when(verhoeff_remainder(number) == 0, number) if checked else number
    return F.regexp_replace(right, "^(.{4})(.{4})(.{4})$", "$1 $2 $3")


def generic_id(text: Column, before: Column, window: int = 5) -> Column:
    """before: the tokens before the candidate, the nearest last; one of the last `window` must be a cue."""
    bare = lambda t: F.lower(F.regexp_replace(t, "[\\p{P}&&[^/]]", ""))
    recent = F.slice(before, F.greatest(F.size(before) - window, F.lit(0)) + 1, window)
    compact = F.upper(F.regexp_replace(F.trim(text), "[ ./-]", ""))
    return F.when(F.exists(recent, lambda t: bare(t).isin(*ID_CUES)) & compact.rlike("^[A-Z0-9]{4,20}$"), compact)


#: Fixed values.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _under_hundred(n: Column) -> Column:
    words = [*_ONES, *(t if not o else f"{t} {_ONES[o]}" for t in _TENS for o in range(10))]
    return F.get(F.array(*map(F.lit, words)), n.cast("int"))


def _under_thousand(n: Column) -> Column:
    rest = F.pmod(n, F.lit(100))
    head = F.when(n >= 100, F.concat(_under_hundred(F.floor(n / 100)), F.lit(" hundred")))
    return F.concat_ws(" ", head, F.when((rest > 0) | (n == 0), _under_hundred(rest)))


def indian_words(n: Column) -> Column:
    """English words with crore, lakh and thousand; zero and less are `zero`; null from 1000 crore."""
    pieces = []
    for unit, span, name in ((10_000_000, 1000, "crore"), (100_000, 100, "lakh"), (1_000, 100, "thousand")):
        d = F.pmod(F.floor(n / unit), F.lit(span))
        pieces.append(F.when(d > 0, F.concat(_under_thousand(d), F.lit(f" {name}"))))
    rest = F.pmod(n, F.lit(1000))
    pieces.append(F.when(rest > 0, _under_thousand(rest)))
    return F.when(n <= 0, F.lit("zero")).when(n < 10_000_000_000, F.concat_ws(" ", *pieces))


#: Where the ten digits of each script begin.
ZEROS = {"Devanagari": 0x966, "Bengali": 0x9E6, "Gurmukhi": 0xA66, "Gujarati": 0xAE6, "Odia": 0xB66, "Tamil": 0xBE6, "Telugu": 0xC66, "Kannada": 0xCE6, "Malayalam": 0xD66, "Arabic": 0x6F0}


def latin_digits(text: Column) -> Column:
    """The text with the digits of ten scripts in Latin ones."""
    return F.translate(text, "".join(chr(z + i) for z in ZEROS.values() for i in range(10)), "0123456789" * len(ZEROS))
