import datetime as dt
import wave

import numpy as np
from pyspark.sql import functions as F

from turnwright.operators import phrases, reporting, sessions, turns
from turnwright.sources import files
from turnwright.streaming import streams


def test_merge_joins_over_blank_turns_and_moves_spans(spark):
    span = {"cls": "x", "raw": "a", "canonical": "a", "rule_id": "r", "conf": 1.0, "ambiguous": False, "start": 0, "end": 1, "fallback_reason": None}
    from turnwright.functions.spans import SPAN

    rows = spark.createDataFrame([(1, 0, "A", "ab", [span]), (1, 1, "B", "  ", []), (1, 2, "A", "a", [span]), (1, 3, "B", "hi", [])], f"call long, pos long, speaker string, text string, spans array<{SPAN}>")
    got = turns.merged_and_labelled(rows, "call", "pos", spans="spans").orderBy("place").collect()
    assert [(r.speaker, r.text) for r in got] == [("customer", "ab a"), ("agent", "hi")]
    assert [s.start for s in got[0].spans] == [0, 3]


def test_overlaps_need_another_speaker_and_more_than_a_point(spark):
    rows = [(1, "A", 0.0, 5.0), (1, "A", 1.0, 2.0), (1, "B", 5.0, 9.0), (1, "C", 8.9, 70.0), (2, "B", 0.0, 9.0), (1, "D", 65.0, 65.0)]
    df = spark.createDataFrame(rows, "call long, speaker string, start_sec double, end_sec double")
    got = {(r.call, r.speaker, r.start_sec): r.overlap_flag for r in turns.mark_overlaps(df, ["call"]).collect()}
    for call, who, a, b in rows:
        assert got[call, who, a] == any(c == call and w != who and min(b, y) > max(a, x) for c, w, x, y in rows)


def test_markdown_and_label(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.5, "x|y\nz", "agent", True), (1, 1, 2.0, 3.0, " ", "customer", False)], "call long, pos long, start_sec double, end_sec double, canonical_text string, speaker string, overlap_flag boolean").withColumn("text", F.col("canonical_text"))
    text = turns.markdown(df, "call", "pos").first().markdown
    assert text == turns.HEADER + "| 0.00–1.50 · overlap | 🎧 Agent | x\\|y z |\n"


def test_crosstalk(spark):
    loud = spark.createDataFrame([(1, 0, [-20.0] * 10 + [-40.0] * 10), (1, 1, [-30.0] * 10 + [-22.0] * 10)], "call long, channel int, db array<double>")
    said = spark.createDataFrame([(1, 0, 0.0, 0.3), (1, 1, 0.0, 0.3), (1, 1, 0.3, 0.6), (1, 0, 0.3, 0.6), (1, 7, 0.0, 0.3), (2, 0, 0.0, 0.3)], "call long, channel int, start_sec double, end_sec double")
    got = {(r.call, r.channel, r.start_sec) for r in turns.gate_crosstalk(said, loud, "call").collect()}
    assert got == {(1, 0, 0.0), (1, 1, 0.3), (1, 7, 0.0), (2, 0, 0.0)}


def test_crosstalk_work_grows_with_frames(spark):
    """What all frames of a turn share is written once in the plan, outside of what is done for every frame."""
    loud = spark.createDataFrame([(1, 0, [-20.0] * 40), (1, 1, [-24.0] * 20 + [-21.0] * 20), (2, 0, [-20.0] * 40)], "call int, channel int, db array<double>")
    said = spark.createDataFrame([(1, 0, 0.0, 1.2), (1, 1, 0.0, 0.6), (1, 1, 0.6, 1.2), (2, 0, 0.0, 1.2), (3, 0, 0.0, 1.0)], "call int, channel int, start_sec double, end_sec double")
    out = turns.gate_crosstalk(said, loud, "call")
    assert {tuple(r)[:3] for r in out.collect()} == {(1, 0, 0.0), (1, 1, 0.6), (2, 0, 0.0), (3, 0, 0.0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("slice(") <= 3


def test_phrases(spark):
    df = spark.createDataFrame([("Rs 1,250",), ("HDFC",), ("A_B  c",), ("12/05/2026",), ("",)], "v string")
    kinds = F.when(F.col("v").startswith("Rs"), "amounts").when(F.col("v").contains("/"), "dates").otherwise("city")
    got = {r.v: r.variants for r in phrases.variants(df, "v", kinds).collect()}
    assert got["HDFC"] == ["HDFC", "h d f c"] and got["A_B  c"][0] == "A B c" and got[""] == []
    assert {"1250", "one thousand two hundred fifty", "1250 rupees"} <= set(got["Rs 1,250"])
    assert "12 May 2026" in got["12/05/2026"]


def test_rank_merges_by_key(spark):
    rows = [(1, 0, "ravi kumar", "city", "Ravi Kumar", ["Ravi Kumar"], True), (1, 1, "ravi kumar", "debtor_name", "RAVI KUMAR", ["ravi kumar", "rk"], False), (1, 2, "loan", "product", "loan", ["loan"], True), (1, 3, "", "city", "", [], True)]
    got = phrases.ranked(spark.createDataFrame(rows, "request long, pos long, key string, field string, canonical string, variants array<string>, explicit boolean"), "request", 2).orderBy("rank").collect()
    assert [(r.key, r.field, r.score) for r in got] == [("ravi kumar", "debtor_name", 128.0), ("loan", "product", 100 + 2 + 1 - 22 - 26)]
    assert got[0].variants == ["Ravi Kumar", "rk"]


def test_phrase_pack_and_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# c\n\nUPI_यूपीआई\nEMI_e m i\nupi_u p i\n")
    base = files.read_phrases(spark, str(tmp_path / "p.txt"))
    got = {r.key: r.variants for r in base.collect()}
    assert got == {"upi": ["UPI", "यूपीआई", "u p i"], "emi": ["EMI", "e m i"]}
    mine = spark.createDataFrame([(1, 1, "emi", ["EMI", "instalment"])], "request long, rank int, key string, variants array<string>")
    assert [r.line for r in phrases.phrase_pack(base, mine, "request").collect()] == ["EMI_e m i_instalment"]


def test_dialogue(spark):
    raw = "agent: [Hypothesis(text='', dec_out=1), Hypothesis(text='a b', dec_out=1)] [Hypothesis(text='c', dec_out=2)]customer: [Hypothesis(text='d', dec_out=2)]"
    got = spark.createDataFrame([(raw,), ("agent: x\nother\ncustomer:  \ncustomer: y",), (None,)], "r string").select(reporting.parse_dialogue(F.col("r")).alias("t")).collect()
    assert [[tuple(t) for t in r.t] for r in got] == [[("agent", "a b c"), ("customer", "d")], [("agent", "x"), ("customer", "y")], []]


def test_positions_follow_the_order(spark):
    got = reporting.with_position(spark.range(0, 1000).withColumn("v", -F.col("id")), ["v"], parts=7).collect()
    assert all(r.idx == 1000 - r.id for r in got)


def test_stability_in_batch_and_stream(spark, tmp_path):
    texts = [("a", False), ("a", False), ("b", False), ("b", True), ("b", False), ("b", False), ("", False), ("", False)]
    rows = spark.createDataFrame([("c", i, t, f) for i, (t, f) in enumerate(texts)], streams.PARTIALS)
    want = [1, 2, 1, 2, 1, 2, 1, 2]
    assert [r.stable_count for r in sessions.stability(rows, "call_id", ["seq"], "text", "is_final").orderBy("seq").collect()] == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.stability(spark.readStream.schema(streams.PARTIALS).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.stable_count for r in out.orderBy("seq").collect()] == want


def test_inactivity_flush_stream(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    schema = "session string, ts timestamp"
    spark.createDataFrame([("s", at(0)), ("s", at(200)), ("s", at(900))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("t", at(60_000))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.inactivity_flushes(stream, "session", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.session, r.n) for r in out.collect() if r.session == "s") == [("s", 1), ("s", 2)]


def test_language_cache_stream(spark, tmp_path):
    schema = "session string, seq long, ts timestamp, detected string, client string, is_final boolean"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("s", 0, at(0), None, None, False), ("s", 1, at(1), "mr", None, False), ("s", 2, at(2), "ta", None, True), ("s", 3, at(3), "ta", "en", False), ("s", 4, at(1000), None, None, False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.language_cache(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r.language, r.language_source) for r in out.orderBy("seq").collect()] == [("hi", "fallback"), ("mr", "detected"), ("mr", "cache"), ("en", "client"), ("hi", "fallback")]


def test_rttm_and_sound(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 1.5 2.0 <NA> <NA> spk1 <NA>\nLEXEME x\n")
    row = files.read_rttm(spark, str(tmp_path / "a.rttm")).first()
    assert (row.speaker, row.start_sec, row.end_sec) == ("spk1", 1.5, 3.5)
    left = (np.sin(np.arange(8000)) * 8000).astype("<i2")
    with wave.open(str(tmp_path / "s.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.stack([left, np.zeros(8000, "<i2")], 1).tobytes())
    rows = files.wav_channels(files.read_sound(spark, str(tmp_path / "s.wav"))).withColumns({"db": files.loudness(F.col("pcm"), F.col("rate")), "part": files.slice_pcm(F.col("pcm"), F.col("rate"), F.lit(0.25), F.lit(0.75)), "wav": files.wav_bytes(F.col("pcm"), F.col("rate"))}).orderBy("channel").collect()
    assert [len(r.pcm) for r in rows] == [16000, 16000] and rows[0].pcm == left.tobytes()
    assert len(rows[0].db) == 33 and rows[1].db == [-120.0] * 33 and bytes(rows[0].part) == left[2000:6000].tobytes()
    rate, n, samples = files._parsed(bytes(rows[0].wav))
    assert (rate, n) == (8000, 1) and (samples[:, 0] == left).all()


def test_split_on_silence(spark):
    sound = np.ones(1000, "<i2") * 100
    sound[270:280] = 0
    got = spark.createDataFrame([(sound.tobytes(), 10)], "pcm binary, rate int").select(files.split_on_silence(F.col("pcm"), F.col("rate")).alias("s")).first().s
    assert (got[0].start, got[0].stop) == (0, 270) and got[-1].stop == 1000 and all(a.stop == b.start for a, b in zip(got, got[1:], strict=False))


def test_latency_summary(spark):
    rows = spark.range(0, 101).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    row = reporting.latency_summary(rows, "k", "v").first()
    assert (row.n, row.mean, row.p95) == (101, 50.0, 95.0)
    draw = np.random.default_rng(1)
    values = {"many": draw.random(3000).tolist(), "few": draw.integers(0, 4, 500).astype(float).tolist(), "same": [7.0] * 40, "one": [1.5], "skew": (draw.random(900) ** 40).tolist()}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    got = {r.k: (r.n, r.p95) for r in reporting.latency_summary(rows, "k", "v").collect()}
    assert got == {k: (len(vs), sorted(vs)[int(len(vs) * 0.95)]) for k, vs in values.items()}


def test_batch_rows(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    jobs = spark.createDataFrame([(1, "complete", "f", "t", None, None, None), (2, "failed", None, None, None, "en", "x")], "id long, status string, filename string, transcript string, language_id string, language string, error string")
    got = {r.id: (r.language_id, r.transcript) for r in reporting.batch_rows(ids, jobs, "id", keep_unknown=True).collect()}
    assert got == {1: ("hi-IN", "t"), 2: ("en", "ERROR: x"), 3: ("hi-IN", "ERROR: Job data lost")}
    assert reporting.batch_rows(ids, jobs, "id").count() == 2


def test_attribution_by_brute_force(spark):
    rng = np.random.default_rng(5)
    said = [(call, i, float(a), float(a + rng.integers(1, 30))) for call in (1, 2) for i, a in enumerate(rng.integers(0, 200, 60))]
    own = [(call, f"s{i}", float(a), float(a + n)) for call in (1, 3) for i, (a, n) in enumerate(zip(rng.integers(0, 200, 80), rng.integers(-2, 25, 80)))]
    own += [(2, f"t{i}", i * 0.25, i * 0.25 + 3) for i in range(700)]
    words = spark.createDataFrame(said, "call long, word_no long, start_sec double, end_sec double")
    got = {(r.call, r.word_no): r for r in turns.attribute(words, spark.createDataFrame(own, "call long, speaker string, start_sec double, end_sec double"), "call", bucket=60.0).collect()}
    assert len(got) == len(said)
    for call, no, a, b in said:
        shares = [(min(b, y) - max(a, x), -x, who) for c, who, x, y in own if c == call and a < y and x < b]
        r = got[call, no]
        if not shares:
            assert r.speaker is None and r.confidence is None
        else:
            share, start, _ = max(shares)
            assert r.confidence == share / (b - a) and r.speaker in {w for s, x, w in shares if (s, x) == (share, start)}


def test_attribution_does_not_pair_words_with_all_turns(spark):
    """Turns of one length, none within another: every word meets all of them, and no join of the plan pairs them."""
    size = 400
    words = spark.range(size).selectExpr("1L as call", "id as word_no", "50 + id / 1000 as start_sec", "55 + id / 1000 as end_sec")
    own = spark.range(size).selectExpr("1L as call", "'a' as speaker", "id / 100 as start_sec", "52 + id / 100 as end_sec")
    out = turns.attribute(words, own, "call")
    assert out.filter("speaker = 'a'").count() == size
    done = out._jdf.queryExecution()
    done.executedPlan().execute().count()
    most, left = 0, [done.executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in name:
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        if "Join" in name and rows.isDefined():
            most = max(most, rows.get().value())
    assert 0 < most <= 30 * size
