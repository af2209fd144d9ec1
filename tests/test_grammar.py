import pytest
from pyspark.sql import functions as F

from turnwright.functions import grammar
from turnwright.functions.lexicon import HI, LEXICONS, MR

CASES = [
    ("hi", "cardinal", "एक लाख पच्चीस हज़ार", "125000"), ("hi", "cardinal", "साढ़े पाँच सौ", "550"), ("hi", "cardinal", "पौने दो हज़ार", "1750"), ("hi", "cardinal", "सवा लाख", "125000"),
    ("hi", "cardinal", "एक अरब", "1000000000"), ("hi", "cardinal", "लाख", None), ("hi", "cardinal", "पाँच ", None), ("hi", "cardinal", "007", None), ("hi", "cardinal", "", None),
    ("hi", "decimal", "बारह दशमलव पाँच दो", "12.52"), ("hi", "decimal", "डेढ़", "1.5"), ("hi", "decimal", "पौने तीन", "2.75"), ("hi", "decimal", "दशमलव", None), ("hi", "decimal", "3.14", "3.14"),
    ("hi", "percent", "दस प्रतिशत", "10%"), ("hi", "percent", "12.5 %", "12.5%"), ("hi", "percent", "दस", None),
    ("hi", "money", "पाँच सौ रुपये", "₹500"), ("hi", "money", "रुपये पाँच सौ", "₹500"), ("hi", "money", "दस रुपये पाँच पैसे", "₹10.05"), ("hi", "money", "Rs. 1,25,000.50", "₹1,25,000.50"), ("hi", "money", "पाँच सौ", None),
    ("hi", "date", "पंद्रह मई", "15/05"), ("hi", "date", "5 May दो हज़ार छब्बीस", "05/05/2026"), ("hi", "date", "1-2-26", "01/02/2026"), ("hi", "date", "32 मई", None), ("hi", "date", "5 मई दस", None),
    ("hi", "time", "साढ़े पाँच बजे", "5:30"), ("hi", "time", "शाम पाँच बजे", "5:00 PM"), ("hi", "time", "पौने एक बजे", "12:45"), ("hi", "time", "पाँच बजकर दस मिनट सुबह", "5:10 AM"), ("hi", "time", "05:30 PM", "5:30 PM"), ("hi", "time", "17:05", "17:05"), ("hi", "time", "25:00", None),
    ("mr", "cardinal", "पाचशे दहा", "510"), ("mr", "cardinal", "शंभर", "100"), ("mr", "cardinal", "दीड हजार", "1500"), ("mr", "time", "साडे पाच वाजता", "5:30"), ("mr", "percent", "दहा टक्के", "10%"), ("mr", "date", "एक जानेवारी", "01/01"),
]


def test_cases(spark):
    for lang in LEXICONS:
        for cls in grammar.CLASSES:
            rows = [(raw, want) for code, c, raw, want in CASES if (code, c) == (lang, cls)]
            if rows:
                got = spark.createDataFrame(rows, "raw string, want string").select("raw", "want", grammar.normalize(F.col("raw"), cls, LEXICONS[lang]).alias("got")).collect()
                assert [(r.raw, r.got) for r in got] == [(r.raw, r.want) for r in got]


@pytest.mark.parametrize("lex", [HI, MR], ids=["hi", "mr"])
def test_spoken_integers_come_back(spark, lex):
    numbers = spark.range(0, 2_000_000_000, 9_999_991).union(spark.range(0, 1200))
    said = numbers.select("id", grammar.spoken_integer(F.col("id"), lex).alias("w"))
    assert said.filter(~grammar.cardinal(F.col("w"), lex).eqNullSafe(F.col("id").cast("string"))).count() == 0


def test_tagged_and_policy(spark):
    row = spark.createDataFrame([("12/05/2026",)], "d string").select(
        grammar.date(F.col("d"), HI, "MDY").alias("a"), grammar.date_rejection(F.col("d"), HI, "MDY").alias("b"), grammar.date_rejection(F.col("d"), HI, "DMY").alias("c"), grammar.tagged(F.lit("दस प्रतिशत"), "percent", HI).alias("t"), grammar.tagged(F.lit("दस रुपये"), "money", HI).alias("m")
    ).first()
    assert tuple(row) == (None, "ambiguous_numeric_date", None, 'percent { value: "10" }', 'money { currency: "INR" amount: "10" }')
    with pytest.raises(ValueError):
        grammar.normalize(F.col("d"), "nothing", HI)


@pytest.mark.parametrize("lex", [HI, MR], ids=["hi", "mr"])
def test_cardinals_of_many_arabs(spark, lex):
    """Keys of larger tables give numbers of two and more arabs."""
    n = [1_999_999_999, 2_000_000_000, 7_127_100_013, 99_000_000_000, 427_630_000_007, 10**15 + 13, 9_007_199_254_740_993, 10**18 - 1]
    rows = spark.createDataFrame([(i,) for i in n], "n long").select("n", grammar.spoken_integer(F.col("n"), lex).alias("w"))
    assert [(r.n, r.v) for r in rows.select("n", grammar.cardinal(F.col("w"), lex).alias("v")).collect()] == [(i, str(i)) for i in n]
    bare = [lex.arab[0], f"{lex.arab[0]} {lex.word(1)}", f"{lex.word(0)} {lex.arab[0]}", f"{lex.word(2)} {lex.arab[0]} ", f"{lex.word(2)} {lex.word(3)} {lex.arab[0]}", f"{lex.word(2)} {lex.arab[0]} {lex.word(2)} {lex.arab[0]}"]
    assert {r.v for r in spark.createDataFrame([(w,) for w in bare], "w string").select(grammar.cardinal(F.col("w"), lex).alias("v")).collect()} == {None}
