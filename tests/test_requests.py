"""Request contexts and packs, languages and numbers in any order, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from turnwright.functions import grammar, languages
from turnwright.functions.lexicon import HI
from turnwright.operators import requests


def test_contexts_of_odd_json(spark):
    raws = ['{"debtor_name": " A_b ", "amounts": "Rs 1,200, 5", "dates": ["x", "", "X"], "city": null}', "[1]", "not json", None, "", '{"product": 12, "other": "z"}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i long, raw string").select("i", requests.parse_context(F.col("raw")).alias("c"))
    got = {r.i: (r.c, r.f) for r in rows.select("i", "c", requests.provided_fields(F.col("c")).alias("f")).collect()}
    assert (got[0][0].debtor_name, got[0][0].amounts, got[0][0].dates) == ("A b", ["Rs 1,200", "5"], ["x"]) and got[0][1] == ["debtor_name", "amounts", "dates"]
    assert all(got[i][1] == [] for i in (1, 2, 3, 4)) and got[5][0].product == "12"


def test_packs_count_and_merge(spark):
    raws = [(1, '{"debtor_name": "Asha Rao", "city": "Pune", "lender": "HDFC"}'), (2, "{}"), (3, '{"city": "PUNE!"}')]
    rows = spark.createDataFrame(raws, "request long, raw string").select("request", requests.parse_context(F.col("raw")).alias("context"))
    base = spark.createDataFrame([("pune", 0, ["Pune", "Poona"]), ("agra", 1, ["Agra"])], "key string, place long, variants array<string>")
    got = {r.request: r for r in requests.request_packs(rows, base, "request", 2).collect()}
    assert set(got) == {1, 3} and got[1].fields == ["debtor_name", "lender", "city"]
    assert (got[1].n_before, got[1].n_after, got[1].n_total, got[1].n_base) == (3, 2, 4, 2) and got[1].top == ["Asha Rao", "HDFC"]
    assert (got[3].n_before, got[3].n_after, got[3].n_total, got[3].n_base) == (1, 1, 2, 1) and got[3].lines[0].startswith("Pune_Poona")
    assert requests.request_packs(rows.limit(0), base, "request", 2).count() == 0


def test_surfaced_and_flat_phrases(spark):
    rows = spark.createDataFrame([("call KUMAR now", "kumar"), ("श्री कुमार", "Kumar"), ("nothing", "kumar"), (None, "kumar"), ("kumar", None), ("kumar", "")], "t string, v string")
    assert [r.surfaced for r in requests.with_surfaced(rows, "t", "v").collect()] == [True, True, False, False, False, False]
    lines = F.array(F.lit("Ab_aB_a b c_ "), F.lit("पी ए एन_दो सौ"))
    assert spark.range(1).select(requests.flat_phrases(lines).alias("p")).first().p == ["Ab", "दो सौ"]


def test_languages_and_permissive_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    known = F.array(F.lit("hi"), F.lit("ta"))
    assert one(languages.supported_code(F.lit(" Hindi_(IN) "), known)) == "hi" and one(languages.supported_code(F.lit(None).cast("string"), known)) is None
    assert one(languages.effective_languages(known, F.array(F.lit("xx")))) is None and one(languages.effective_languages(known, F.array().cast("array<string>"))) == ["hi", "ta"]
    for said, want in {"सौ": "100", "पाँच सौ": "500", "दो लाख सौ": "200100", "": None, "कुछ": None, "दस कुछ": None}.items():
        assert one(grammar.permissive_cardinal(F.lit(said), HI)) == want


def test_decoders_and_detected_languages(spark):
    rows = spark.createDataFrame([(" CTC ", "Hindi", 0.7), ("x", "ta: Tamil", 0.69), (None, "xx", 0.9), ("", None, 1.0), ("rnnt", "tam", None)], "d string, l string, c double")
    own = F.array(F.lit("hi"), F.lit("ta"))
    got = rows.select(languages.decoder(F.col("d")).alias("a"), languages.decoder(F.col("d"), "CTC").alias("b"), languages.decoder(F.col("d"), "?").alias("c"), languages.accepted_language(F.col("l"), F.col("c"), own).alias("l"), languages.accepted_language(F.col("l"), F.col("c"), own, "hi").alias("v")).collect()
    assert [tuple(r) for r in got] == [("ctc", "ctc", "ctc", "hi", "hi"), ("rnnt", "ctc", "rnnt", None, "hi"), ("rnnt", "ctc", "rnnt", None, "hi"), ("rnnt", "ctc", "rnnt", None, "hi"), ("rnnt", "rnnt", "rnnt", None, "hi")]
    asked = spark.createDataFrame([(" HI",), ("auto",), (None,), ("",)], "l string")
    assert [r.l for r in asked.select(languages.asked_language(F.col("l"), own).alias("l")).collect()] == ["hi", None, None, None]
    with pytest.raises(Exception, match="unsupported language mr; supported: hi, ta"):
        spark.createDataFrame([("mr",)], "l string").select(languages.asked_language(F.col("l"), own)).collect()
