"""Spoken to written forms as column expressions: numbers, money, percentages, dates and times.

Each function takes a string column and a lexicon and gives the written form, or null where the whole string is not of
that class. A class is a regular relation, so each form is one anchored pattern whose groups are looked up in a map.

The string is written many times in these expressions: hand over a column or a variable, not an expression. Lambdas stand only
where a made value is used again, as each takes the driver some ten calls to build and Spark twice the time to analyse.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, let_text, lookup
from .lexicon import AM, PAISE, PM, RUPEE_SIGNS, RUPEES, Lexicon


ARAB = 1_000_000_000


def any_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def part(raw: Column, pattern: str, group: int = 1) -> Column:
    """The group of a match of the whole string; null if there is no match or the group is empty."""
    return F.get(F.array_remove(F.regexp_extract_all(raw, F.lit(f"^(?:{pattern})$"), F.lit(group)), ""), F.lit(0))


def grouped(digits: Column) -> Column:
    """Indian digit groups (three, then twos) of a string of at most ten digits without a leading zero; else null."""
    return let_text(digits, lambda d: F.when(d.rlike("^(?:[0-9]|[1-9][0-9]{1,9})$"), F.regexp_replace(d, "(?<=[0-9])(?=(?:[0-9][0-9])+[0-9]$)", ",")))


def _steps(lex: Lexicon, behind: str) -> tuple[str, list[tuple[dict[str, int], int]]]:
    """A pattern of a number below an arab, each of its words in a group, and what each group's words are and weigh; behind: what ends a word."""
    step = lambda unit: f"(?:([^ ]+) (?:{any_of(unit)}){behind})?"
    hundreds, heads = (step(lex.hundred), (lex.values(1, 9), 100)) if lex.hundred else (f"(?:({any_of(lex.hundred_heads)}){behind})?", (lex.hundred_heads, 100))
    return step(lex.crore) + step(lex.lakh) + step(lex.thousand) + hundreds, [(lex.values(1, 99), w) for w in (10_000_000, 100_000, 1_000)] + [heads]


def cardinal(raw: Column, lex: Lexicon) -> Column:
    """Digits of a number below 10^18; a number below an arab may stand before the word for one."""
    # A word's place says what it may be, so groups take any word and the tables say whether it is known.
    (head, head_values), (tail, tail_values) = _steps(lex, " "), _steps(lex, "(?: |$)")
    arab = any_of(lex.arab)
    pattern = f"^(?!.* $)(?=.)(?:(?=.* (?:{arab})(?: |$))(?!(?:{arab}) ){head}(?:([^ ]+) )?(?:{arab})(?: |$))?{tail}([^ ]+)?$"
    groups_of = [(v, w * ARAB) for v, w in [*head_values, (lex.values(1, 99), 1)]] + [*tail_values, (lex.values(), 1)]

    def spelled(r: Column) -> Column:
        # One match gives all groups; what does not match comes back whole.
        groups = F.split(F.regexp_replace(r, pattern, "\u0001".join(f"${i}" for i in range(1, len(groups_of) + 1))), "\u0001", -1)

        def total(g: Column) -> Column:
            terms = [F.when(F.get(g, F.lit(i)) == "", F.lit(0).cast("long")).otherwise(lookup(v, F.get(g, F.lit(i))).cast("long") * w) for i, (v, w) in enumerate(groups_of)]
            return F.when((F.size(g) == len(groups_of)) & ~r.contains("\u0001"), sum(terms[1:], terms[0]).cast("string"))

        return let_text(groups, total)

    return F.coalesce(part(raw, "(0|[1-9][0-9]*)"), spelled(raw), _scaled_compound(raw, lex))


def _scaled_compound(raw: Column, lex: Lexicon) -> Column:
    """A quarter or half more or less of a scale."""
    out = []
    for names, scale, most in ((lex.compound_hundred, 100, 9), (lex.thousand, 1_000, 99), (lex.lakh, 100_000, 99), (lex.crore, 10_000_000, 99)):
        unit = f"(?:{any_of(names)})"
        for words, value in ((lex.quarter_more, scale + scale // 4), (lex.one_and_half, scale + scale // 2), (lex.two_and_half, 2 * scale + scale // 2)):
            out.append(F.when(raw.rlike(f"^(?:{any_of(words)}) {unit}$"), F.lit(str(value))))
        for words, low, extra in ((lex.half_more, 3, scale // 2), (lex.quarter_less, 1, -(scale // 4))):
            heads = lex.values(low, most)
            out.append(lookup({w: n * scale + extra for w, n in heads.items()}, part(raw, f"(?:{any_of(words)}) ({any_of(heads)}) {unit}")))
    starts = any_of(lex.quarter_more + lex.one_and_half + lex.two_and_half + lex.half_more + lex.quarter_less)
    return F.when(raw.rlike(f"^(?:{starts}) "), F.coalesce(*out))


def decimal(raw: Column, lex: Lexicon) -> Column:
    marker = f"(.+) (?:{any_of(lex.point)}) (.+)"

    def digits(after: Column) -> Column:
        words = F.transform(F.split(after, " "), lambda w: lookup(lex.values(0, 9), w))
        return F.coalesce(part(after, "([0-9]+)"), let_text(words, lambda d: F.when(~F.exists(d, lambda x: x.isNull()), F.array_join(d, ""))))

    def forms(r: Column) -> Column:
        out = [F.when(r.rlike(marker), F.concat(let_text(part(r, marker, 1), lambda n: cardinal(n, lex)), F.lit("."), let_text(part(r, marker, 2), digits)))]
        for words, low, shift, tail in ((lex.quarter_more, 1, 0, ".25"), (lex.half_more, 3, 0, ".5"), (lex.quarter_less, 1, -1, ".75")):
            heads = lex.values(low, 99)
            out.append(lookup({w: f"{n + shift}{tail}" for w, n in heads.items()}, part(r, f"(?:{any_of(words)}) ({any_of(heads)})")))
        for words, value in ((lex.one_and_half, "1.5"), (lex.two_and_half, "2.5")):
            out.append(F.when(r.rlike(f"^(?:{any_of(words)})$"), F.lit(value)))
        return F.coalesce(part(r, "((?:0|[1-9][0-9]*)\\.[0-9]+)"), *out)

    return forms(raw)


def percent(raw: Column, lex: Lexicon) -> Column:
    number = part(raw, f"(.*?)(?: (?:{any_of(lex.percent)})| ?%)")
    return let_text(number, lambda n: F.concat(F.coalesce(cardinal(n, lex), decimal(n, lex)), F.lit("%")))


def money(raw: Column, lex: Lexicon) -> Column:
    rupees, paise = f"(?:{any_of(RUPEES)})", f"(?:{any_of(PAISE)})"
    with_paise = f"(.+) {rupees} (.+) {paise}"
    signs = f"(?:{any_of(RUPEE_SIGNS)}) ?([0-9,]+)(\\.[0-9]+)?"

    def spoken(n: Column) -> Column:
        pointed = lambda d: F.concat(grouped(part(d, "([0-9]+)\\.[0-9]+")), part(d, "[0-9]+(\\.[0-9]+)"))
        return F.coalesce(grouped(cardinal(n, lex)), let_text(decimal(n, lex), pointed))

    def forms(r: Column) -> Column:
        cents = let_text(part(r, with_paise, 2), lambda c: F.coalesce(F.lpad(lookup(lex.values(1, 99), c), 2, "0"), part(c, "([0-9][0-9])")))
        plain = F.concat(grouped(F.regexp_replace(part(r, signs, 1), ",", "")), F.regexp_extract(r, f"^{signs}$", 2))
        whole = F.concat(let_text(part(r, with_paise, 1), lambda n: grouped(cardinal(n, lex))), F.lit("."), cents)
        return F.coalesce(plain, whole, let_text(F.coalesce(part(r, f"(.+) {rupees}"), part(r, f"{rupees} (.+)")), spoken))

    return F.concat(F.lit("₹"), forms(raw))


def date_monthword(raw: Column, lex: Lexicon) -> Column:
    days = {w: f"{n:02d}" for w, n in lex.values(1, 31).items()} | {form: f"{n:02d}" for n in range(1, 32) for form in (str(n), f"{n:02d}")}
    months = {w: f"{m:02d}" for m, words in lex.months.items() for w in words}
    pattern = f"({any_of(days)}) ({any_of(months)})(?: (.+))?"

    def forms(r: Column) -> Column:
        short = F.concat(lookup(days, part(r, pattern, 1)), F.lit("/"), lookup(months, part(r, pattern, 2)))
        year = lambda y: F.when(y.isNull(), "").otherwise(F.concat(F.lit("/"), part(cardinal(y, lex), "([0-9]{4})")))
        return F.when(r.rlike(f"^{pattern}$"), F.concat(short, let_text(part(r, pattern, 3), year)))

    return forms(raw)


def date_numeric(raw: Column) -> Column:
    pattern = "(0?[1-9]|[12][0-9]|3[01])[/.-](0?[1-9]|1[0-2])[/.-]([0-9]{2}|[0-9]{4})"
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.concat(F.lpad(part(raw, pattern, 1), 2, "0"), F.lit("/"), F.lpad(part(raw, pattern, 2), 2, "0"), F.lit("/"), let_text(part(raw, pattern, 3), full))


def date(raw: Column, lex: Lexicon, date_order: Column | str = "DMY") -> Column:
    """Month words always; numbers only where the policy says day first."""
    order = F.lit(date_order) if isinstance(date_order, str) else date_order
    return F.coalesce(F.when(order == "DMY", date_numeric(raw)), date_monthword(raw, lex))


def date_rejection(raw: Column, lex: Lexicon, date_order: Column | str) -> Column:
    """`ambiguous_numeric_date` where only the policy stands against a numeric date; else null."""
    order = F.lit(date_order) if isinstance(date_order, str) else date_order
    shape = raw.rlike("^\\p{Nd}{1,2}[/.-]\\p{Nd}{1,2}[/.-]\\p{Nd}{2}(?:\\p{Nd}{2})?$")
    return F.when((order != "DMY") & shape & date_monthword(raw, lex).isNull(), F.lit("ambiguous_numeric_date"))


def _clock(raw: Column, lex: Lexicon) -> Column:
    """Twelve-hour forms without a part of the day."""
    hours = {w: str(n) for w, n in lex.values(1, 12).items()} | {form: str(n) for n in range(1, 13) for form in (str(n), f"{n:02d}")}
    minutes = {w: f"{n:02d}" for w, n in lex.values(0, 59).items()} | {form: f"{n:02d}" for n in range(60) for form in (str(n), f"{n:02d}")}
    at = f"(?:{any_of(lex.oclock)})"
    past = f"({any_of(hours)}) (?:{any_of(lex.past)}) ({any_of(minutes)}) (?:{any_of(lex.minute)})"

    def forms(r: Column) -> Column:
        out = [F.concat(lookup(hours, part(r, f"({any_of(hours)}) {at}")), F.lit(":00"))]
        for words, low, shift, tail in ((lex.half_more, 3, 0, ":30"), (lex.quarter_more, 1, 0, ":15"), (lex.quarter_less, 1, -1, ":45")):
            heads = {w: f"{(n + shift - 1) % 12 + 1}{tail}" for w, n in lex.values(low, 12).items()}
            out.append(lookup(heads, part(r, f"(?:{any_of(words)}) ({any_of(heads)}) {at}")))
        for words, value in ((lex.one_and_half, "1:30"), (lex.two_and_half, "2:30")):
            out.append(F.when(r.rlike(f"^(?:{any_of(words)}) {at}$"), F.lit(value)))
        out.append(F.concat(lookup(hours, part(r, past, 1)), F.lit(":"), lookup(minutes, part(r, past, 2))))
        return F.coalesce(*out)

    return forms(raw)


def time(raw: Column, lex: Lexicon) -> Column:
    first = f"(?:{any_of(lex.morning + AM)})", f"(?:{any_of(lex.later + PM)})"

    def forms(r: Column) -> Column:
        day = "|".join(first)
        core = F.coalesce(part(r, f"(.+) (?:{day})"), part(r, f"(?:{day}) (.+)"), r)
        suffix = F.lit("")
        for words, name in zip(first, (" AM", " PM"), strict=True):
            suffix = F.when(r.rlike(f"^(?:{words} .+|.+ {words})$"), name).otherwise(suffix)
        latin = F.when(r.rlike(f"^0?(?:[1-9]|1[0-2]):[0-5][0-9] (?:{day})$"), F.regexp_extract(r, "^0?([1-9][0-9]?:[0-5][0-9])", 1))
        said = let_text(core, lambda c: _clock(c, lex))
        return F.coalesce(F.concat(F.coalesce(latin, said), suffix), part(r, "((?:[01][0-9]|2[0-3]):[0-5][0-9])"))

    return forms(raw)


CLASSES = {"cardinal": cardinal, "decimal": decimal, "percent": percent, "money": money, "date": date, "time": time}


def normalize(raw: Column, cls: str, lex: Lexicon) -> Column:
    """The written form of class cls, or null; null for empty strings."""
    if cls not in CLASSES:
        raise ValueError(f"unknown class {cls!r}; known: {sorted(CLASSES)}")
    return F.when(raw != "", CLASSES[cls](raw, lex))


def tagged(raw: Column, cls: str, lex: Lexicon) -> Column:
    """The same with its class around it."""
    value = normalize(raw, cls, lex)
    if cls == "money":
        return F.concat(F.lit('money { currency: "INR" amount: "'), F.substring(value, 2, 100), F.lit('" }'))
    bare = F.regexp_replace(value, "%$", "") if cls == "percent" else value
    return F.concat(F.lit(f'{cls} {{ value: "'), bare, F.lit('" }'))


def _spoken_pieces(n: Column, lex: Lexicon) -> list[Column]:
    """The words of an integer below an arab, in order; none for zero."""
    words = F.split(F.lit("\n".join(lex.word(i) for i in range(100))), "\n")
    at = lambda x: F.get(words, x.cast("int"))
    pieces = []
    for unit, name in ((10_000_000, lex.crore[0]), (100_000, lex.lakh[0]), (1_000, lex.thousand[0])):
        d = F.pmod(F.floor(n / unit), F.lit(100))
        pieces.append(F.when(d > 0, F.concat(at(d), F.lit(f" {name}"))))
    d = F.pmod(F.floor(n / 100), F.lit(10))
    heads = {i: w for w, i in reversed(list(lex.hundred_heads.items()))}
    hundreds = F.concat(at(d), F.lit(f" {lex.hundred[0]}")) if lex.hundred else F.get(F.split(F.lit("\n".join(["", *(heads[i] for i in range(1, 10))])), "\n"), d.cast("int"))
    rest = F.pmod(n, F.lit(100))
    return [*pieces, F.when(d > 0, hundreds), F.when(rest > 0, at(rest))]


def spoken_integer(n: Column, lex: Lexicon) -> Column:
    """The words of an integer from 0 to below 10^18: the inverse of cardinal(). Arabs are counted in words of their own."""
    low = F.pmod(n, F.lit(ARAB))
    arabs = F.round((n - low) / ARAB).cast("long")
    head = F.when(n >= ARAB, F.concat_ws(" ", *_spoken_pieces(arabs, lex), F.lit(lex.arab[0])))
    return F.concat_ws(" ", head, *_spoken_pieces(low, lex), F.when(n == 0, lex.word(0)))


def permissive_cardinal(raw: Column, lex: Lexicon) -> Column:
    """A number from known words in any order: hundreds multiply what came before, larger scales add it up; else null."""
    scales = {w: n for words, n in ((lex.thousand, 1_000), (lex.lakh, 100_000), (lex.crore, 10_000_000), (lex.arab, 1_000_000_000)) for w in words}
    values = lex.values()
    begin = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(acc: Column, word: Column) -> Column:
        one = F.when(acc["now"] == 0, F.lit(1).cast("long")).otherwise(acc["now"])
        value, scale = lookup(values, word).cast("long"), lookup(scales, word).cast("long")
        made = F.when(word.isin(*lex.hundred), F.struct(acc["total"].alias("total"), (one * 100).alias("now")))
        made = made.when(scale.isNotNull(), F.struct((acc["total"] + one * scale).alias("total"), F.lit(0).cast("long").alias("now")))
        return made.when(value.isNotNull(), F.struct(acc["total"].alias("total"), (acc["now"] + value).alias("now")))

    words = F.filter(F.split(F.trim(F.coalesce(raw, F.lit(""))), "\\s+"), lambda w: w != "")
    return let_text(words, lambda ws: F.when(F.size(ws) > 0, F.aggregate(ws, begin, step, lambda acc: (acc["total"] + acc["now"]).cast("string"))))
