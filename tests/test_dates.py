"""The strict date parser against its readings written out, and its reasons."""

import datetime
import itertools

from pyspark.sql import functions as F

from turnwright.functions import dates

CASES = [
    ("5 May 2024", "DMY", "05/05/2024"), ("15th of May, 2024", "MDY", "15/05/2024"), ("May 15 2024", "DMY", "15/05/2024"), ("Monday, 3 जून 2024", "DMY", "03/06/2024"), ("१५ मई २०२४ को", "DMY", "15/05/2024"),
    ("2024-05-06", "DMY", "06/05/2024"), ("2024/31/12", "DMY", None), ("05/06/2024", "DMY", "05/06/2024"), ("05/06/2024", "MDY", "06/05/2024"), ("05/06/2024", "YMD", None), ("25/06/2024", "MDY", "25/06/2024"),
    ("31.02.2024", "DMY", None), ("29 Feb 2024", "DMY", "29/02/2024"), ("29 Feb 2023", "DMY", None), ("15may2024", "DMY", "15/05/2024"), ("May 2024", "DMY", None), ("5 May", "DMY", None), ("5 foo 2024", "DMY", None),
    ("10 May 11", "DMY", "10/05/2011"), ("10 May 11", "YMD", "11/05/2010"), ("10 May 69", "DMY", "10/05/1969"), ("10 May 68", "DMY", "10/05/2068"), ("5 May 2024 10:30", "DMY", None), ("1 2 3", "DMY", None),
    ("", "DMY", None), (None, "DMY", None), ("5 May 2024", None, "05/05/2024"), ("05/06/2024", None, None), ("5 May 0000", "DMY", None), ("99999999999/1/2024", "DMY", None), ("200/1/2024", "DMY", None), ("May May 2024", "DMY", None),
]


def test_dates(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, raw string, o string, want string").select("*", dates.strict_date(F.col("raw"), F.col("o")).alias("got")).orderBy("i").collect()
    assert [(r.raw, r.o, r.got) for r in rows] == CASES


def test_numbers_by_brute_force(spark):
    """Every order of short numbers: what the tenant's order reads, or the one date that can be read at all."""

    def date(a, order):
        at = dict(zip(order, a, strict=True))
        if any(len(at[k]) == 4 for k in "DM") or len(at["Y"]) < 2:
            return None
        year = int(at["Y"]) if len(at["Y"]) == 4 else int(at["Y"]) + (2000 if int(at["Y"]) < 69 else 1900)
        try:
            return datetime.date(year, int(at["M"]), int(at["D"])).strftime("%d/%m/%Y")
        except ValueError:
            return None

    cases = []
    for a in itertools.product(("1", "05", "12", "31", "70", "2024"), repeat=3):
        every = {date(a, o) for o in map("".join, itertools.permutations("DMY"))} - {None}
        for order in dates.ORDERS:
            want = date(a, "YMD") if len(a[0]) == 4 else next(iter(every)) if len(every) == 1 else date(a, order)
            cases.append(("-".join(a), order, want))
    rows = spark.createDataFrame(cases, "raw string, o string, want string").select("*", dates.strict_date(F.col("raw"), F.col("o")).alias("got")).collect()
    assert [(r.raw, r.o, r.got) for r in rows] == cases


def test_reasons(spark):
    cases = [
        ("5 May 2024", 0.9, 0.9, None, ("05/05/2024", None)), ("5 May 2024", 0.84, 0.9, None, (None, "low_confidence")), ("5 May 2024", 0.9, None, None, (None, "low_confidence")),
        ("5/6/2024", 0.9, 0.9, None, ("05/06/2024", None)), ("1 2 2024", 0.9, 0.9, "no word", (None, "missing_date_cue")), ("1 2 2024", 0.9, 0.9, "the date", ("01/02/2024", None)), ("5 May", 0.9, 0.9, None, (None, "dateparser_no_parse")), (None, 0.9, 0.9, None, (None, "missing_date_cue")),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "raw string, c double, a double, t string")
    got = rows.select(dates.parsed_date(F.col("raw"), F.lit("DMY"), F.col("c"), F.col("a"), F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [c[4] for c in cases]
    other = rows.select(dates.parsed_date(F.col("raw"), F.lit("DMY"), F.col("c"), F.col("a"), languages=("hi", "xx")).alias("p")).first().p
    assert tuple(other) == (None, "dateparser_unavailable")
    assert rows.limit(0).select(dates.strict_date(F.col("raw"), F.lit("DMY"))).count() == 0
