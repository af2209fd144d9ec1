"""Hindi forms of names, amounts and dates, amounts at the edges, and routing, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from turnwright.functions import devanagari, scripts
from turnwright.operators import phrases, turns


def first(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("kumar", ["कुमर", "कुमार"]), ("amrita", ["अम्रित", "आम्रित"]), ("priya", ["प्रिय", "प्रिया"]), ("sharma", ["शर्म", "शर्मा"]), ("EMI", ["ईएमआई", "ई एम आई"]), ("ksheeri-12", ["क्षीरि-12"]),
        ("", []), ("१२", []), (None, []), ("kumar sharma kumar", ["कुमर शर्म कुमर", "कुमर शर्म कुमार", "कुमर शर्मा कुमर", "कुमर शर्मा कुमार"]),
    ],
)
def test_script_variants(spark, text, want):
    assert first(spark, devanagari.script_variants(F.lit(text).cast("string"))) == want


def test_hindi_dates_and_months(spark):
    got = first(spark, devanagari.date_variants(F.lit("2024-09-05").cast("timestamp")))
    assert got[:5] == ["२०२४-०९-०५", "०५/०९/२०२४", "०५-०९-२०२४", "५/९/२०२४", "५-९-२०२४"] and len(got) == 5 + 2 * 8
    assert "5 सितंबर 2024" in got and "सितम्बर ०५ २०२४" in got


def test_amounts_at_the_edges(spark):
    rows = spark.createDataFrame([("Rs 0",), ("Rs 1000000000000",), ("₹ 12.50",), ("1,500",), (None,), ("",)], "said string")
    got = {r.said: r.variants for r in phrases.variants(rows, "said", "amounts").collect()}
    assert not any("rupees" in v for v in got["Rs 0"] + got["Rs 1000000000000"]) and "1,000,000,000,000" in got["Rs 1000000000000"]
    assert "12.50 rupees" in got["₹ 12.50"] and "one thousand five hundred" in got["1,500"] and got[None] == [] and got[""] == []
    hindi = phrases.variants(rows.withColumn("hi", F.col("said") == "1,500"), "said", "amounts", hindi=F.col("hi")).collect()
    assert any("१,५००" in r.variants for r in hindi) and not any("०" in v for r in hindi if r.said == "Rs 0" for v in r.variants)


def test_neighbouring_turns_of_one_speaker_merge(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", " "), (1, 2, "a", "y"), (1, 3, "b", "z"), (1, 4, "b", "w")], "call long, turn long, speaker string, text string")
    got = turns.merged_and_labelled(rows, "call", "turn").orderBy("place").collect()
    assert [(r.speaker, r.text) for r in got] == [("customer", "x y"), ("agent", "z w")]


def test_routing_of_mixed_scripts(spark):
    said = {"नमस्ते ok": "Devanagari", "ok ठ": "Latin", "abকখগঘ": "Bengali", "12 34": "Common", "": "Common", None: "Common", "aअ": "Devanagari", "தமிழ் x": "Tamil"}
    rows = spark.createDataFrame([(t,) for t in said], "text string").select("text", scripts.routed(F.col("text")).alias("r")).collect()
    assert {r.text: r.r.script for r in rows} == said


def test_forms_are_made_once_for_a_value(spark):
    """An explode infers a filter on the variants; it must not make them anew for every row below the join."""
    rows = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate([("05/09/2024", True), ("05/09/2024", False), ("05/09/2024", None), (None, True), ("05/09/2024", True)])], "id int, said string, hi boolean")
    made = phrases.variants(rows, "said", "dates", hindi=F.col("hi"))
    got = {r.id: r.variants for r in made.collect()}
    assert got[0] == got[4] and got[1] == got[2] and len(got[0]) > len(got[1]) > 0 and got[3] == []
    plan = made.select("id", F.posexplode("variants"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "try_to_timestamp" in line.lower() or "gettimestamp" in line.lower() and "Filter" in line]
