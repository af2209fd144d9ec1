from pyspark.sql import functions as F

from turnwright.operators.once import made_once
from turnwright.plans import queries


def test_made_once_for_a_value(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "a", None), (4, None, None), (5, "b", 2.0), (6, None, None)], "id int, x string, y double")
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return f"{x}!"

    made = made_once(rows, {"k": F.col("x"), "n": F.col("y")}, lambda values: values.withColumn("out", F.udf(seen)("k")).withColumn("two", F.col("n") * 2))
    assert made.columns == ["id", "x", "y", "out", "two"]
    assert sorted((r.id, r.out, r.two) for r in made.collect()) == [(1, "a!", None), (2, "b!", 2.0), (3, "a!", None), (4, "None!", None), (5, "b!", 4.0), (6, "None!", None)]
    assert calls.value == 4


def test_percentages_and_segments_are_written_once_for_a_value(spark, tmp_path):
    """The costly columns stand above an aggregate of values and below the join with rows."""
    spark.range(600).selectExpr("id as l_orderkey", "1 as l_linenumber", "cast(id % 50 + 1 as double) as l_quantity", "(id % 11) / 100 as l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = queries.hi_percent_roundtrip(spark, str(tmp_path))
    assert {(r.l_orderkey, r.value) for r in out.collect()} == {(i, f"{i % 50 + 1}.{i % 11 // 10}{i % 11 % 10}%") for i in range(600)}
    spark.range(300).selectExpr("id as event_id", "id % 3 as user_id", "if(id % 2 = 0, 'view', 'error') as event_type").write.parquet(f"{tmp_path}/events.parquet")
    for made in (out, queries.call_segments(spark, str(tmp_path))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        costly = next(i for i, line in enumerate(lines) if "regexp_extract_all" in line)
        assert any("Aggregate [" in line for line in lines[costly + 1 :]) and any("Join Inner" in line for line in lines[:costly])


def test_documents_are_dealt_over_all_tasks_whatever_their_file(spark, tmp_path, monkeypatch):
    # One row group is read by one task, which would normalise all documents alone.
    spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries.itn, "normalize_segments", lambda docs, **how: docs.select("doc_id", F.lit("x").alias("canonical_text"), *[F.lit(None).cast(f"array<{queries.itn.SPAN}>").alias("spans")], F.lit("x").alias("lang"), F.spark_partition_id().alias("script")))
    got = queries.normalized_documents(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(400)) and len({r.script for r in got}) >= min(4, spark.sparkContext.defaultParallelism)
