import random
import re

from pyspark.sql import functions as F

from turnwright.functions import formats, scripts, spans
from turnwright.functions.clean import working_copy
from turnwright.functions.spoken import with_spoken
from turnwright.operators import itn


def test_matches_equal_finditer(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab1 .,") for _ in range(draw.randrange(30))) for _ in range(200)] + [""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.matches(F.col("t"), "[ab]+1?").alias("m")).collect()
    for r in rows:
        assert [(x.start, x.end, x.raw) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[ab]+1?", r.t)]


def test_prefilter_classes_and_overlaps(spark):
    text = "mail a.b@c.co, see https://x.y/9876543210 or +91 9876543210 on 12/05/2026 at 5:30 PM, pay ₹1,25,000.50 plus 12.5%"
    found = spark.createDataFrame([(text,)], "t string").select(spans.prefilter(F.col("t")).alias("s")).first().s
    assert [(s.cls, s.raw) for s in found] == [("email", "a.b@c.co"), ("url", "https://x.y/9876543210"), ("phone", "+91 9876543210"), ("date", "12/05/2026"), ("time", "5:30 PM"), ("amount", "₹1,25,000.50"), ("percent", "12.5%")]
    assert all(text[s.start : s.end] == s.raw for s in found)


def test_formats(spark):
    row = spark.range(1).select(
        formats.indian_mobile(F.lit("नौ आठ सात छह पाँच चार तीन दो एक शून्य")).alias("a"), formats.indian_mobile(F.lit("+44 9876543210")).alias("b"), formats.indian_mobile(F.lit("")).alias("c"),
        formats.aadhaar(F.concat(F.lit("23412341234"), formats.verhoeff_digit(F.lit("23412341234")))).alias("d"), formats.aadhaar(F.lit("2341-2341-2341")).alias("e"), formats.pan(F.lit("abcde1234f")).alias("f"),
        formats.generic_id(F.lit("ab 12/9"), F.array(F.lit("loan"), F.lit("no."))).alias("g"), formats.indian_words(F.lit(12500000)).alias("h"), formats.indian_grouping(F.lit("12345678")).alias("i"), formats.verhoeff_remainder(F.lit("2363")).alias("j"),
    ).first()
    assert row.a == "+91 98765 43210" and row.b is None and row.c is None
    assert row.d.startswith("2341 2341 234") and row.e is None and row.f == "ABCDE1234F" and row.g == "AB129"
    assert row.h == "one crore twenty five lakh" and row.i == "1,23,45,678" and row.j == 0


def test_working_copy(spark):
    row = spark.createDataFrame([("é ０１ – ₨ क‍ख क्‍ष ਸ਼",)], "t string").select(working_copy(F.col("t")).alias("w")).first()
    assert row.w == "é 01 - ₹ कख क्‍ष ਸ"


def test_routing(spark):
    texts = ["hello", "दोन वाजता", "दो बजे", "কথা", "123 !", "abcd कखगघ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scripts.routed(F.col("t")).alias("r")).orderBy("i").collect()
    assert [(r.r.lang, r.r.script, r.r.needs_lid) for r in rows] == [("en", "Latin", True), ("mr", "Devanagari", False), ("hi", "Devanagari", False), ("bn", "Bengali", False), ("und", "Common", True), ("hi", "Devanagari", False)]


def test_spoken_phrases(spark):
    text = "कुल पाँच सौ रुपये दस पैसे, रुपये दस और बारह दशमलव पाँच प्रतिशत और शाम पाँच बजे और तारीख पाँच"
    found = with_spoken(spark.createDataFrame([(text, "hi"), (text, "mr")], "t string, l string"), "t", "l", "s").collect()
    got = {(s.cls, s.raw) for s in found[0].s}
    assert {("amount", "पाँच सौ रुपये दस पैसे"), ("amount", "रुपये दस"), ("percent", "बारह दशमलव पाँच प्रतिशत"), ("decimal", "बारह दशमलव पाँच"), ("time", "शाम पाँच बजे"), ("date", "पाँच"), ("cardinal", "पाँच सौ")} <= got
    assert found[1].s == []


SENTENCES = [
    ("कुल एक लाख पच्चीस हज़ार रुपये पचास पैसे देने हैं", "कुल ₹1,25,000.50 देने हैं", []),
    ("सुबह साढ़े पाँच बजे पंद्रह मई को", "5:30 AM 15/05 को", []),
    ("पाँच सौ रुपये नहीं सात सौ रुपये", "पाँच सौ रुपये नहीं सात सौ रुपये", ["self_correction;ambiguous"] * 2),
    ("meet on 12/05/2026", "meet on 12/05/2026", ["wfst_unavailable;ambiguous"]),
    ("call 9876543210", "call +91 98765 43210", []),
    ("", "", []),
    (None, "", []),
]


def test_final_segments(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SENTENCES)], "i int, text string")
    done = itn.normalize_segments(rows, classifier=itn.grammar_classifier()).orderBy("i").collect()
    for r, (raw, want, reasons) in zip(done, SENTENCES, strict=True):
        assert r.raw_text == (raw or "") and r.canonical_text == want and not r.deferred
        assert [s.fallback_reason for s in r.spans if s.fallback_reason] == reasons


def test_partials_wait_and_keep_safe_classes(spark):
    rows = spark.createDataFrame([(0, "पाँच रुपये", 1), (1, "पाँच रुपये", 2), (2, "पाँच बजे", 2)], "i int, text string, n int")
    done = itn.normalize_segments(rows, is_final=F.lit(False), stable=F.col("n"), classifier=itn.grammar_classifier()).orderBy("i").collect()
    assert [(r.deferred, r.canonical_text) for r in done] == [(True, "पाँच रुपये"), (False, "₹5"), (False, "पाँच बजे")]
    assert done[0].spans == []


def test_domain_terms_fill_gaps(spark):
    done = itn.normalize_segments(spark.createDataFrame([("ई एम आई पाँच रुपये hdfc bank",)], "text string"), classifier=itn.grammar_classifier(), domain=True).first()
    assert done.canonical_text == "EMI ₹5 HDFC Bank"


def test_low_confidence_is_refused(spark):
    done = itn.normalize_segments(spark.createDataFrame([("पाँच रुपये", 0.5)], "text string, c double"), asr_conf=F.col("c"), classifier=itn.grammar_classifier()).first()
    assert done.canonical_text == "पाँच रुपये" and done.spans[0].fallback_reason == "asr_conf<0.80"
