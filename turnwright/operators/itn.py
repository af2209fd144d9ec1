"""Inverse text normalisation of transcript segments: spans, gates and the canonical text, one select chain per table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar, scripts
from ..functions.clean import working_copy
from ..functions.domain import domain_terms
from ..functions.formats import indian_mobile
from ..functions.lexicon import LEXICONS
from ..functions.spans import SPAN, applied, prefilter, selected
from ..functions.spoken import with_spoken

VERSION = "0.0.0"
#: Least confidence of classifier and recogniser, whether a cue is needed, whether partials wait.
THRESHOLDS = {
    "domain_term": (0.95, 0.70, False, True), "cardinal": (0.85, 0.70, False, False), "decimal": (0.85, 0.75, True, False), "percent": (0.85, 0.75, True, False),
    "currency": (0.90, 0.80, True, False), "money": (0.90, 0.80, True, False), "time": (0.90, 0.80, True, True), "date": (0.90, 0.80, True, True),
    "phone": (0.95, 0.85, True, True), "id": (0.95, 0.90, True, True), "health_dose": (0.95, 0.90, True, True),
}
PARTIAL_SAFE = ("cardinal", "money", "percent")
STABLE_AT = 2
#: Which class goes first where spans overlap.
MERGE_ORDER = ("url", "email", "ifsc", "pan", "aadhaar", "phone", "date", "time", "amount", "percent", "decimal", "cardinal")
REWRITTEN = {"amount": "money", "percent": "percent", "time": "time", "cardinal": "cardinal", "decimal": "decimal"}
#: Cues in a span or around it.
CUES = {
    "money": "(?iu)₹|Rs\\.?|INR|US\\$|\\$|USD|£|GBP|€|EUR|rupees?|रुपये|रुपया|रू",
    "percent": "(?iu)%|percent|प्रतिशत|टक्के|टक्का",
    "decimal": "(?iu)\\b(?:point|dot|decimal)\\b|दशमलव",
    "time": "(?iu)\\b(?:AM|PM|A\\.M\\.|P\\.M\\.)\\b|बजे|बजकर|मिनट|सुबह|दोपहर|शाम|रात",
    "phone": "(?iu)\\b(?:phone|mobile|number|otp)\\b|फ़ोन|फोन|मोबाइल|नंबर|नम्बर|ओटीपी",
}
#: Words that speak of dates; English ones in any letter case.
DATE_CUES = (
    "जनवरी फरवरी फ़रवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर सितम्बर अक्टूबर नवंबर नवम्बर दिसंबर दिसम्बर "
    "तारीख तारीख़ दिनांक साल वर्ष महीना माह सोमवार मंगलवार बुधवार गुरुवार शुक्रवार शनिवार रविवार "
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "date dated day month year monday tuesday wednesday thursday friday saturday sunday"
).split()
#: Words and phrases that take back what was said.
CORRECTIONS = "no sorry actually wait oops scratch मतलब गलत ग़लत नहीं नही माफ़ माफ क्षमा अरे".split()
CORRECTION_PHRASES = ("i mean", "no sorry", "no no", "scratch that", "मेरा मतलब", "गलत है", "गलती हो")
WINDOW = 6


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, "[\\s\\x{85}\\p{Z}\\x{1c}-\\x{1f}]+"), lambda t: t != "")


def has_date_cue(text: Column) -> Column:
    bare = lambda t: F.lower(F.regexp_replace(t, "^[,.;:!?()\\[\\]\"']+|[,.;:!?()\\[\\]\"']+$", ""))
    return F.exists(_tokens(text), lambda t: bare(t).isin(*DATE_CUES))


def has_cue(s: Column, text: Column) -> Column:
    by_class = F.lit(False)
    for cls in ("percent", "decimal", "time"):
        by_class = F.when(s["cls"] == cls, s["raw"].rlike(CUES[cls])).otherwise(by_class)
    by_class = F.when(s["cls"].isin("amount", "currency", "money"), s["raw"].rlike(CUES["money"])).otherwise(by_class)
    by_class = F.when(s["cls"] == "phone", s["rule_id"].startswith("fmt.") | text.rlike(CUES["phone"])).otherwise(by_class)
    return F.when(s["cls"] == "date", has_date_cue(s["raw"]) | has_date_cue(text) | s["rule_id"].rlike("^(?:wfst|dateparser)\\.")).otherwise(by_class)


def gated(s: Column, text: Column, asr_conf: Column, partial: Column, thresholds: dict = THRESHOLDS) -> Column:
    """The span, or the span with its raw text as canonical and the reasons, those it had first."""
    pick = lambda i: F.element_at(F.create_map(*[x for c, t in thresholds.items() for x in (F.lit(c), F.lit(t[i]))]), s["cls"])
    known = s["cls"].isin(*thresholds)
    when = lambda test, reason: F.when(F.coalesce(test, F.lit(False)), reason)
    of = lambda i: F.when(known, pick(i))
    reasons = F.array(
        when(s["ambiguous"], F.lit("ambiguous")), when(known & (s["conf"] < of(0)), F.format_string("classifier_conf<%.2f", of(0))), when(known & (asr_conf < of(1)), F.format_string("asr_conf<%.2f", of(1))),
        when(known & of(2) & ~has_cue(s, text), F.lit("missing_lex_cue")), when(known & of(3) & partial, F.lit("defer_on_partial")),
    )
    new = F.filter(reasons, lambda r: r.isNotNull())
    had = F.filter(F.split(F.coalesce(s["fallback_reason"], F.lit("")), ";"), lambda r: r != "")
    failed = s.withField("canonical", s["raw"]).withField("fallback_reason", F.array_join(F.concat(had, F.filter(new, lambda r: ~F.array_contains(had, r))), ";"))
    return F.when(F.size(new) > 0, failed).otherwise(s)


def with_candidates(df: DataFrame, text: str, lang: str, out: str) -> DataFrame:
    """df with written and spoken spans that do not overlap: by class, longest, then first."""
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(MERGE_ORDER, 1) for x in (c, i)])
    keyed = lambda s: F.struct(F.element_at(rank, s["cls"]).alias("rank"), (s["start"] - s["end"]).alias("less"), s["start"].alias("at"), s.alias("span"))
    staged = with_spoken(df.withColumn("__written", prefilter(F.col(text)).cast(f"array<{SPAN}>")), text, lang, "__spoken")
    return staged.withColumn("__ranked", F.transform(F.concat("__written", "__spoken"), keyed)).withColumn(out, selected(F.col("__ranked"), "rank:int,less:int,at:int")).drop("__written", "__spoken", "__ranked")


def _dated(raw: Column) -> Column:
    """Dates with an explicit form that no grammar takes; a bounded stand-in for a free date parser."""
    forms = ("d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyy-MM-dd", "yyyy/MM/dd")
    shaped = F.when(raw.rlike("^[0-9A-Za-z ,/-]{6,40}$"), raw)
    return F.date_format(F.coalesce(*[F.try_to_timestamp(shaped, F.lit(f)) for f in forms]), "dd/MM/yyyy")


def rewritten(s: Column, lang: Column, text: Column, date_order: Column) -> Column:
    """A candidate span with its canonical form, or ambiguous with a reason."""
    known = lang.isin(*LEXICONS)
    by_lang = lambda f: F.coalesce(*[F.when(lang == code, f(lex)) for code, lex in LEXICONS.items()])
    target = F.coalesce(grammar.lookup(REWRITTEN, s["cls"]), s["cls"])
    value = F.when(s["cls"] == "phone", indian_mobile(s["raw"])).when(s["cls"] == "date", by_lang(lambda lex: grammar.date(s["raw"], lex, date_order)))
    for cls, to in REWRITTEN.items():
        value = value.when(s["cls"] == cls, by_lang(lambda lex, to=to: grammar.normalize(s["raw"], to, lex)))
    free = F.when((s["cls"] == "date") & known & has_date_cue(text), _dated(s["raw"]))
    refused = F.when(s["cls"] == "date", by_lang(lambda lex: grammar.date_rejection(s["raw"], lex, date_order)))

    def outcome(v: Column) -> Column:
        parser = (s["cls"] == "date") & known & v["value"].isNull() & v["refused"].isNull() & has_date_cue(text)
        rule = F.when(s["cls"] == "phone", "fmt.phone").when(parser, "dateparser.date").otherwise(F.concat(F.lit("wfst."), target))
        reason = F.when(s["cls"] == "phone", "fmt_no_parse").when(~known, "wfst_unavailable").when(v["refused"].isNotNull(), v["refused"]).when(parser, "dateparser_no_parse").otherwise("wfst_no_parse")
        found = F.coalesce(v["value"], F.when(v["refused"].isNull(), v["free"]))
        return F.struct(
            target.alias("cls"), s["raw"].alias("raw"), F.coalesce(found, s["raw"]).alias("canonical"), rule.alias("rule_id"), s["conf"].alias("conf"), (s["ambiguous"] | found.isNull()).alias("ambiguous"),
            s["start"].alias("start"), s["end"].alias("end"), F.when(found.isNull(), reason).alias("fallback_reason"),
        )

    return grammar.let(F.struct(value.alias("value"), free.alias("free"), refused.alias("refused")), outcome)


def _takes_back(gap: Column) -> Column:
    words = F.filter(F.transform(_tokens(gap), lambda t: F.lower(F.regexp_replace(t, "^\\p{P}+|\\p{P}+$", ""))), lambda t: t != "")
    joined = F.array_join(words, " ")
    phrase = F.lit(False)
    for p in CORRECTION_PHRASES:
        phrase = phrase | joined.contains(p)
    return (F.size(words) > 0) & (F.size(words) <= WINDOW) & (F.exists(words, lambda w: w.isin(*CORRECTIONS)) | phrase)


def corrected(text: Column, spans: Column) -> Column:
    """Spans with both ends of every self-correction marked: a span and the first later one of its class it gives way to."""

    def pair(s: Column, i: Column) -> Column:
        later = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda j: (j > i) & (F.get(spans, j)["cls"] == s["cls"]) & (F.get(spans, j)["start"] > s["end"]) & _takes_back(F.substr(text, s["end"] + 1, F.get(spans, j)["start"] - s["end"])))
        return F.when(F.size(later) > 0, F.array(i, F.get(later, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    unsafe = F.flatten(F.transform(spans, pair))
    marked = F.transform(spans, lambda s, i: F.when(F.array_contains(unsafe, i), s.withField("ambiguous", F.lit(True)).withField("fallback_reason", F.lit("self_correction"))).otherwise(s))
    return F.when(F.size(spans) > 1, marked).otherwise(spans)


def default_classifier(df: DataFrame, text: str, lang: str, out: str) -> DataFrame:
    """Written forms only, as they are."""
    return df.withColumn(out, prefilter(F.col(text)).cast(f"array<{SPAN}>"))


def grammar_classifier(date_order: str | Column = "DMY") -> Callable[[DataFrame, str, str, str], DataFrame]:
    """Written and spoken forms rewritten by the language's grammar; other classes are dropped."""
    order = F.lit(date_order) if isinstance(date_order, str) else date_order

    def classify(df: DataFrame, text: str, lang: str, out: str) -> DataFrame:
        kept = lambda s: s["cls"].isin("phone", "date", *REWRITTEN)
        staged = with_candidates(df, text, lang, "__candidates").withColumn("__candidates", F.filter("__candidates", kept))
        return staged.withColumn(out, F.transform("__candidates", lambda s: rewritten(s, F.col(lang), F.col(text), order))).drop("__candidates")

    return classify


def normalize_segments(
    df: DataFrame, text: str = "text", is_final: Column | None = None, stable: Column | None = None, lang_hint: Column | None = None, asr_conf: Column | None = None,
    classifier: Callable[[DataFrame, str, str, str], DataFrame] = default_classifier, thresholds: dict = THRESHOLDS, display: Callable[[Column, Column], Column] = lambda text, lang: text, domain: bool = False,
) -> DataFrame:
    """df with raw_text, canonical_text, display_text, spans, deferred, lang, script, itn_version.

    stable counts equal partials in a row; a partial below STABLE_AT is deferred: raw text on all surfaces and no spans.
    Null texts are empty. The raw text is never changed.
    """
    final = F.lit(True) if is_final is None else F.coalesce(is_final, F.lit(False))
    waits = ~final & (F.coalesce(stable, F.lit(0)) < STABLE_AT if stable is not None else F.lit(True))
    staged = df.withColumn("raw_text", F.coalesce(F.col(text), F.lit(""))).withColumns({"deferred": waits, "__partial": ~final, "__conf": F.coalesce(asr_conf, F.lit(1.0)) if asr_conf is not None else F.lit(1.0)})
    staged = staged.withColumn("__work", F.when(F.col("deferred"), F.col("raw_text")).otherwise(working_copy(F.col("raw_text"))))
    if domain:
        staged = staged.withColumn("__terms", domain_terms(F.col("__work")))
    staged = staged.withColumn("__route", scripts.routed(F.col("__work"), lang_hint)).withColumns({"lang": F.col("__route.lang"), "script": F.col("__route.script")})
    staged = classifier(staged, "__work", "lang", "__spans").withColumn("__spans", corrected(F.col("__work"), F.col("__spans")))
    safe = F.when(F.col("__partial"), F.filter("__spans", lambda s: s["cls"].isin(*PARTIAL_SAFE) & ~s["ambiguous"])).otherwise(F.col("__spans"))
    staged = staged.withColumn("__safe", safe).withColumn("spans", F.transform("__safe", lambda s: gated(s, F.col("__work"), F.col("__conf"), F.col("__partial"), thresholds)))
    if domain:
        clear = lambda a: ~F.exists("spans", lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"]))
        staged = staged.withColumn("spans", F.array_sort(F.concat("spans", F.filter("__terms", clear)), lambda a, b: a["start"] - b["start"])).drop("__terms")
    staged = staged.withColumn("spans", F.when(F.col("deferred"), F.array().cast(f"array<{SPAN}>")).otherwise(F.col("spans").cast(f"array<{SPAN}>")))
    staged = staged.withColumn("canonical_text", F.when(F.col("deferred"), F.col("raw_text")).otherwise(applied(F.col("__work"), F.col("spans"))))
    return staged.withColumns({"display_text": display(F.col("canonical_text"), F.col("lang")), "itn_version": F.lit(VERSION)}).drop("__partial", "__conf", "__work", "__route", "__spans", "__safe")


def passthrough(df: DataFrame, text: str = "text", lang: str = "und") -> DataFrame:
    """Raw text on all surfaces, deferred."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"raw_text": raw, "canonical_text": raw, "display_text": raw, "spans": F.array().cast(f"array<{SPAN}>"), "deferred": F.lit(True), "lang": F.lit(lang), "script": F.lit("Common"), "itn_version": F.lit(VERSION)})


def token_confidence(tokens: Column) -> Column:
    """The smallest confidence of a segment's tokens (structs with conf); 1 without tokens."""
    return F.coalesce(F.array_min(F.transform(tokens, lambda t: t["conf"].cast("double"))), F.lit(1.0))
