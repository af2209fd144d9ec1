"""Context phrases: variants of names, amounts and dates, ranking, and phrase packs per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import devanagari
from ..functions.clean import composed
from ..functions.formats import indian_words
from ..functions.grammar import let, lookup

#: What a field's phrases weigh.
FIELD_WEIGHTS = {"debtor_name": 120.0, "lender": 105.0, "product": 100.0, "amounts": 90.0, "dates": 88.0, "account_terms": 86.0, "city": 72.0, "branch": 70.0, "agent_name": 68.0, "prior_call_entities": 58.0, "campaign_vocabulary": 54.0}
OTHER_WEIGHT = 50.0
#: Single words that say little.
AMBIGUOUS = ("account", "agent", "amount", "branch", "call", "city", "date", "loan", "name", "payment", "product")
#: Routing codes and spoken brands, and code endings.
BRANDS = {"UGRO_CAPITAL": "Ugro Capital", "MOBIKWIK": "MobiKwik", "MONEYVIEW": "Money View", "CASHE": "CASHe", "KREDITBEE": "KreditBee", "BOBCARD": "BOB Card", "HDBFS": "HDB Financial", "PAYME": "PayMe", "IARC": "IARC", "PAHAL_FINANCE": "Pahal Finance", "BAJAJ": "Bajaj", "SMFG": "SMFG", "AGRIM": "Agrim"}
SUFFIXES = ("_SPL", "_SOUTH", "_NACL", "_PL", "_RURAL", "_AUTO")
#: Labels of Hindi.
HINDI_MARKERS = ("hi", "hi-in", "hi in", "hindi", "hin", "हिंदी", "हिन्दी")
DATE_FORMS = ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "d M yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")


def display(text: Column) -> Column:
    """Compatibility form, underscores and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.translate(composed(F.coalesce(text, F.lit("")), "NFKC"), "_", " "), "[\\s\\p{Z}]+", " "))


def plain_display(text: Column) -> Column:
    """display() for text that is in compatibility form already, such as variants made here."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "_", " "), "[\\s\\p{Z}]+", " "))


def variant_key(shown: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(shown, "[\\p{P}]", " "), "[\\s\\p{Z}]+", " ")))


def distinct_variants(values: Column) -> Column:
    """Values in order, without empty ones and those whose key came before."""
    keyed = F.filter(F.transform(values, lambda v: let(plain_display(v), lambda d: F.struct(variant_key(d).alias("k"), d.alias("v")))), lambda x: x["k"] != "")
    kept = F.aggregate(keyed, F.slice(keyed, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x["v"])


def general_variants(shown: Column, hindi: Column | None = None) -> Column:
    """shown: display() text. Lower case, joined and spelled-out forms, and in Hindi those in its script."""
    words = F.regexp_extract_all(shown, F.lit("[0-9A-Za-z]+"), F.lit(0))
    joined = F.array_join(words, "")
    joins = (F.size(words) > 1) & F.length(joined).between(3, 32)
    acronym, spelled = shown.rlike("^[A-Z0-9]{2,6}$"), shown.rlike("^(?:[A-Za-z0-9]\\s+){1,5}[A-Za-z0-9]$")
    low = F.lower(shown)
    latin = F.filter(
        F.array(shown, F.when(low != shown, low), F.when(joins, joined), F.when(joins, F.lower(joined)), F.when(acronym, low), F.when(acronym, F.array_join(F.split(low, ""), " ")), F.when(spelled, F.lower(F.replace(shown, F.lit(" "), F.lit(""))))),
        lambda v: v.isNotNull() & (v != ""),
    )
    return latin if hindi is None else F.concat(latin, F.when(hindi, devanagari.script_variants(shown)).otherwise(F.array().cast("array<string>")))


def amount_variants(shown: Column, hindi: Column | None = None) -> Column:
    """Digits, groups of three and words of an amount, with rupees where the text says so and it is from 1 to below 10^12."""
    hint = shown.rlike("(?i)₹|rs\\.?|inr|rupees?")
    bare = F.regexp_replace(F.regexp_replace(shown, "(?i)₹|rs\\.|rs|inr|rupees|rupee", ""), "[,\\s]", "")
    none = F.array().cast("array<string>")

    def forms(number: Column) -> Column:
        value = number.try_cast("decimal(38,10)")
        whole = F.when(value == F.floor(value), F.floor(value).cast("long"))
        commas = F.regexp_replace(whole.cast("string"), "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
        spoken = (whole > 0) & (whole < 10**12)
        words = F.when(spoken, indian_words(whole))
        said = lambda x: F.when(hint, F.concat(x, F.lit(" rupees")))
        extra = F.array(number, commas, words, F.when(spoken, said(whole.cast("string"))), F.when(spoken, said(commas)), said(words), F.when(whole.isNull(), said(number)))
        if hindi is not None:
            local = []
            for form in (number, commas):
                local.append(devanagari.digits(form))
                for word in ("रुपये", "रुपए"):
                    for x in (form, devanagari.digits(form)):
                        local += [F.when(hint, F.concat(x, F.lit(f" {word}"))), F.when(hint, F.concat(F.lit(f"{word} "), x))]
            extra = F.concat(extra, F.when(hindi, F.array(*local)).otherwise(none))
        return F.filter(extra, lambda v: v.isNotNull())

    number = F.when(bare.rlike("^[0-9]+(?:\\.[0-9]+)?$"), bare)
    return F.concat(general_variants(shown), F.when(number.isNull(), none).otherwise(let(number, forms)))


def date_variants(shown: Column, hindi: Column | None = None) -> Column:
    """Five written forms of a date, and in Hindi those with its digits and months."""
    clean = F.replace(shown, F.lit(","), F.lit(""))
    none = F.array().cast("array<string>")

    def forms(day: Column) -> Column:
        written = F.array(*[F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd MMMM yyyy", "MMMM dd yyyy")])
        both = written if hindi is None else F.concat(written, F.when(hindi, devanagari.date_variants(day)).otherwise(none))
        return F.when(day.isNull(), none).otherwise(both)

    return F.concat(general_variants(shown), let(F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in DATE_FORMS]), forms))


def variants(df: DataFrame, text: str, field: Column | str, out: str = "variants", hindi: bool | Column = False) -> DataFrame:
    """df with distinct variants of a value, by its field; hindi says whether the request's language is Hindi.

    A value's forms are made once for all rows that show it the same way, and joined back to them; a hot value's rows are a
    join key that AQE splits.
    """
    kind = F.lit(field) if isinstance(field, str) else field
    spoken = F.lit(bool(hindi)) if isinstance(hindi, bool) else F.coalesce(hindi, F.lit(False))
    # The key is never null: unknown fields are as any other, and null values are shown as empty.
    known = F.when(kind.isin("amounts", "dates"), kind).otherwise("")
    keyed = df.withColumn("__shown", display(F.col(text))).withColumn("__form", F.struct(F.col("__shown").alias("shown"), known.alias("kind"), spoken.alias("hindi"))).drop("__shown")
    shown, kind, local = F.col("__value.shown"), F.col("__value.kind"), None if hindi is False else F.col("__value.hindi")
    made = F.when(kind == "amounts", amount_variants(shown, local)).when(kind == "dates", date_variants(shown, local)).otherwise(general_variants(shown, local))
    # Taken as an aggregate, the forms can't be written into the filter that an explode infers, which would make them anew for every row.
    forms = keyed.select(F.col("__form").alias("__value")).distinct().withColumn("__made", made)
    forms = forms.groupBy("__value").agg(F.get(F.collect_list(distinct_variants(F.col("__made"))), F.lit(0)).alias(out))
    return keyed.join(forms, F.col("__form") == F.col("__value")).drop("__form", "__value")


def variants_by_row(df: DataFrame, text: str, field: Column, out: str = "variants", hindi: bool | Column = False) -> DataFrame:
    """The same without a join, for plans that use the result many times and would hold the join as often."""
    spoken = (F.lit(True) if hindi else None) if isinstance(hindi, bool) else hindi
    staged = df.withColumn("__shown", display(F.col(text)))
    shown = F.col("__shown")
    made = F.when(field == "amounts", amount_variants(shown, spoken)).when(field == "dates", date_variants(shown, spoken)).otherwise(general_variants(shown, spoken))
    return staged.withColumn("__made", made).withColumn(out, distinct_variants(F.col("__made"))).drop("__shown", "__made")


def rank_tokens(text: Column) -> Column:
    return F.filter(F.split(variant_key(text), " "), lambda t: t != "")


def score(field: Column, canonical: Column, explicit: Column) -> Column:
    weight = F.coalesce(lookup(FIELD_WEIGHTS, field).cast("double"), F.lit(OTHER_WEIGHT))

    def total(words: Column) -> Column:
        n, joined = F.size(words), F.length(F.array_join(words, ""))
        one = F.get(words, F.lit(0))
        short = F.when(joined <= 2, 70.0).when(joined <= 3, 40.0).when((n == 1) & (joined <= 4), 22.0).otherwise(0.0)
        vague = F.when((n == 1) & one.isin(*AMBIGUOUS), 26.0).otherwise(0.0) + F.when((n == 1) & one.rlike("^\\p{Nd}{1,2}$"), 20.0).otherwise(0.0)
        penalty = F.when(n == 0, 100.0).otherwise(short + vague)
        return weight + F.least(n, F.lit(4)) * 2.0 + F.when(n > 1, 3.0).otherwise(0.0) + F.when(canonical.rlike("\\p{Nd}"), 1.5).otherwise(0.0) + F.when(explicit, 1.0).otherwise(0.0) - penalty

    return let(rank_tokens(canonical), total)


def merged_candidates(candidates: DataFrame, request: str) -> DataFrame:
    """One row per request and key: the field and canonical form of most weight (the first of equals), all variants.

    candidates: request, pos, key, field, canonical, variants, explicit; rows with an empty key are left out.
    """
    weight = F.coalesce(lookup(FIELD_WEIGHTS, F.col("field")).cast("double"), F.lit(OTHER_WEIGHT))
    rows = candidates.filter(F.coalesce("key", F.lit("")) != "")
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "variants"))), lambda x: x["variants"]))
    out = rows.groupBy(request, "key").agg(F.max_by(F.struct("field", "canonical"), F.struct(weight, -F.col("pos"))).alias("best"), lists.alias("all"), F.bool_or("explicit").alias("explicit"), F.min("pos").alias("pos"))
    first = F.aggregate("all", F.slice("all", 1, 0), lambda acc, v: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))))
    return out.select(request, "key", "pos", "best.field", "best.canonical", first.alias("variants"), "explicit")


def ranked(candidates: DataFrame, request: str, most: int) -> DataFrame:
    """The best `most` candidates of every request: request, rank, key, field, canonical, variants, score."""
    scored = merged_candidates(candidates, request).withColumn("score", score(F.col("field"), F.col("canonical"), F.col("explicit")))
    order = Window.partitionBy(request).orderBy(F.desc("score"), F.desc(F.size(rank_tokens(F.col("canonical")))), F.lower("canonical"), "pos")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(request, "rank", "key", "field", "canonical", "variants", "score")


def phrase_pack(base: DataFrame, selected: DataFrame, request: str) -> DataFrame:
    """request, place, key, line: a request's candidates, joined to the base group (key, place, variants) of their key.

    Base groups that a request adds nothing to are the same for all requests and stay in `base`.
    """
    groups = base.select("key", F.col("place").cast("long").alias("place"), "variants")
    mine = selected.select(request, "key", (F.col("rank") + (1 << 40)).alias("place"), "variants")
    named = mine.select(request, "key").join(groups, "key").select(request, "key", "place", "variants").unionByName(mine)
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "variants"))), lambda x: x["variants"]))
    return named.groupBy(request, "key").agg(F.min("place").alias("place"), lists.alias("all")).select(request, "place", "key", F.array_join(distinct_variants(F.col("all")), "_").alias("line"))


def brand_of(code: Column) -> Column:
    """A routing code's spoken brand."""
    up = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    bare = F.regexp_replace(up, f"(?:{'|'.join(SUFFIXES)})$", "")
    return F.coalesce(lookup(BRANDS, up), lookup(BRANDS, bare), F.initcap(F.translate(bare, "_", " ")))


def is_hindi(language: Column) -> Column:
    marker = F.translate(F.lower(F.trim(F.coalesce(language, F.lit("")))), "_", "-")
    return marker.isin(*HINDI_MARKERS) | (F.substring_index(marker, "-", 1) == "hi")


def clean_amount(value: Column) -> Column:
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(~text.isin("", "0", "0.0", "0.00"), text)


def row_context(df: DataFrame, name: str, institute: str, due: str, due_date: str) -> DataFrame:
    """df with context: struct of debtor_name, lender, amounts and dates."""
    amount, day = clean_amount(F.col(due)), F.substring_index(F.trim(F.coalesce(F.col(due_date).cast("string"), F.lit(""))), " ", 1)
    none = F.array().cast("array<string>")
    return df.withColumn("context", F.struct(F.nullif(F.trim(F.col(name)), F.lit("")).alias("debtor_name"), F.nullif(brand_of(F.col(institute)), F.lit("")).alias("lender"), F.when(amount.isNotNull(), F.array(F.concat(amount, F.lit(" rupees")))).otherwise(none).alias("amounts"), F.when(day != "", F.array(day)).otherwise(none).alias("dates")))
