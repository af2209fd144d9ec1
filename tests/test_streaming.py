"""Streams against their batch forms: no cut between micro-batches and no restart changes a row, and nothing shown is taken back."""

import base64
import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from turnwright.functions import messages
from turnwright.operators import sessions
from turnwright.streaming import live, segments, streams


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def as_files(spark, rows, schema, path, cuts):
    """rows as one file for each part, in the order of the parts."""
    ends = [*cuts, len(rows)]
    for i, (lo, hi) in enumerate(zip([0, *cuts], ends, strict=True)):
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.parquet(f"{path}/part={i}")
        yield f"{path}/part={i}"


def replayed(spark, rows, schema, make, path, cuts, provider=None, stop_after=None):
    """What a stream gives that gets rows in parts; with a new run of the query after stop_after parts."""
    place, parts = f"{path}/in", []
    for i, part in enumerate(as_files(spark, rows, schema, f"{path}/parts", cuts)):
        parts.append(part)
        spark.read.parquet(part).coalesce(1).write.mode("append").parquet(place)
        if stop_after is not None and i + 1 == stop_after:
            streams.run_once(make(streams.read_files(spark, schema, place, 1)), f"{path}/out", f"{path}/checkpoint", provider)
    return streams.run_once(make(streams.read_files(spark, schema, place, 1)), f"{path}/out", f"{path}/checkpoint", provider)


#: Twenty segments as growing words: amounts, shares, ids, dates, times, addresses in several scripts.
SAID = [
    "कुल ₹5,000 देने हैं आज", "कुल Rs. 1,250.50 बाकी है", "please pay $40 by noon", "मला ₹99 पाठवा", "আমার ₹12,00,000 চাই", "mobile 9876543210 par call", "call +91 9876543210 now", "otp bheja 9123456780 par",
    "number 08012345678 hai", "interest 12.5 % lagega aaj", "छूट 20% मिलेगी कल", "date 05/06/2024 ko aana", "तारीख 1-2-24 को मिलो", "milte hain 10:30 AM ko", "शाम 18:45 पर आना", "ifsc HDFC0001234 hai", "pan ABCDE1234F likho",
    "aadhaar 2345 6789 0123 hai", "mail a.b@c.co.in par", "see https://x.org/a?b now",
]


def hypotheses():
    """Every word twice as a partial, then the final; two calls of ten segments each."""
    rows = []
    for i, text in enumerate(SAID):
        words = text.split(" ")
        said = [" ".join(words[: n + 1]) for n in range(len(words)) for _ in range(2)]
        for k, part in enumerate([*said, text]):
            rows.append((f"c{i % 2}", i * 100 + k, part, k == len(said), "", ["in", "us", None][i % 3], None))
    return sorted(rows, key=lambda r: r[1])


@pytest.mark.parametrize(("cuts", "stop_after"), [((), None), ((40, 41, 90), None), ((17, 60, 120), 2)])
def test_no_flicker_and_finals_equal_batch(spark, tmp_path, cuts, stop_after):
    rows = hypotheses()
    policies = segments.Policies({"in": "DMY", "us": "MDY"}, default="in", enabled=False)
    got = replayed(spark, rows, segments.SEGMENT, lambda s: segments.normalized_stream(s, policies), tmp_path, cuts, stop_after=stop_after)
    table = spark.createDataFrame(rows, segments.SEGMENT)
    streamed = [tuple(r) for r in got.orderBy("seq").collect()]
    assert streamed == [tuple(r) for r in segments.normalized_calls(table, policies).orderBy("seq").collect()] and len(streamed) == len(rows)
    finals = [tuple(r) for r in segments.normalized_calls(table.filter("is_final"), policies).orderBy("seq").collect()]
    skip = segments.RESULT.index("stable_count")
    assert [r[:skip] + r[skip + 1 :] for r in streamed if r[2]] == [r[:skip] + r[skip + 1 :] for r in finals] and len(finals) == 20
    assert all(r[segments.RESULT.index("spans")] for r in finals)  # none of them is trivial
    shown = [r for r in streamed if not r[2] and r[segments.RESULT.index("spans")]]
    assert shown and segments.flickers(got).count() == 0


def test_flickers_are_seen(spark):
    # A number that becomes an amount with the next word is shown, then replaced.
    said = ["कुल पाँच", "कुल पाँच", "कुल पाँच रुपये", "कुल पाँच रुपये"]
    rows = [("c", i, t, False, "", None, None) for i, t in enumerate(said)]
    done = segments.normalized_calls(spark.createDataFrame(rows, segments.SEGMENT), segments.Policies({"in": "DMY"}, "in"))
    assert [(r.seq, r.cls) for r in segments.flickers(done).collect()] == [(1, "cardinal")]
    assert [r.canonical_text for r in done.orderBy("seq").collect()] == ["कुल पाँच", "कुल 5", "कुल पाँच रुपये", "कुल ₹5"]


def test_segments_with_odd_rows_pass_through(spark):
    tokens = [[("a", 0, 5, 0.99)], [("a", -1, 5, 0.9)], [("a", 0, 5, 1.2)], [(None, 0, 1, 0.5)], [], None, [("a", 0, 5, 0.3)]]
    rows = [("c", i, "कुल ₹5,000 देने हैं", True, "hi", "who", t) for i, t in enumerate(tokens)] + [("c", 10, None, None, None, None, None)]
    done = segments.normalized_calls(spark.createDataFrame(rows, segments.SEGMENT), segments.Policies({"in": "DMY"}, "in")).orderBy("seq").collect()
    assert [r.error for r in done] == [None, "invalid_tokens", "invalid_tokens", "invalid_tokens", None, None, None, None]
    assert all(r.deferred and r.canonical_text == r.raw_text and r.lang == "hi" and r.script == "Devanagari" and not r.spans for r in done[1:4])
    assert done[0].spans[0].fallback_reason is None and done[6].spans[0].fallback_reason == "asr_conf<0.80" and done[0].tenant == "in"
    assert (done[7].raw_text, done[7].deferred, done[7].lang) == ("", True, "und")
    for wrong in ({"date_orders": {"a": "YDM"}, "default": "a"}, {"date_orders": {"a": "DMY"}, "default": "b"}, {"date_orders": {"a": "DMY"}, "default": "a", "enabled": "no"}):
        with pytest.raises(ValueError):
            segments.Policies(**wrong)


def test_messages(spark):
    sound = base64.b64encode(b"\x01\x02\x03").decode()
    texts = [{"type": "start", "call_id": "c", "model_name": "m"}, {"audio": {"data": sound, "sample_rate": 8000}}, {"type": "flush", "audio": {"data": sound, "sample_rate": "0"}}, {"type": "stop"}, {"type": "other"}, {"audio": {"data": "!!!"}}, {"audio": {}}]
    rows = [(i, json.dumps(t), None) for i, t in enumerate(texts)] + [(7, "{broken", None), (8, None, b"\x05"), (9, None, b""), (10, None, None)]
    table = spark.createDataFrame(rows, "i int, text string, raw binary")
    got = [tuple(r.m) for r in table.select("i", messages.parsed(F.col("text"), F.col("raw")).alias("m")).orderBy("i").collect()]
    nothing = (None, None, None, None, None)
    assert [(k, p and bytes(p), r, m, c) for k, p, r, m, c in got] == [
        ("start", None, None, "m", "c"), ("audio", b"\x01\x02\x03", 8000, None, None), ("flush", b"\x01\x02\x03", None, None, None), ("stop", None, None, None, None),
        nothing, nothing, nothing, nothing, ("audio", b"\x05", None, None, None), nothing, nothing,
    ]


MESSAGES = [
    ("s", 0, at(0), "start", None, 8000, None), ("t", 1, at(0), "audio", b"a", None, None), ("s", 2, at(10), "flush", None, None, None), ("s", 3, at(20), "audio", b"one", None, None), ("t", 4, at(200), "audio", b" ", None, None),
    ("s", 5, at(900), "audio", b"two", None, None), ("s", 6, at(1000), "flush", None, None, None), ("s", 7, at(1100), "audio", b"three", None, None), ("s", 8, at(1200), "start", None, None, "m"), ("s", 9, at(1300), "flush", b"four", None, None),
    ("s", 10, at(1400), "audio", b"five", None, None), ("s", 11, at(1500), "stop", None, None, None), ("s", 12, at(1600), "flush", None, None, None), ("t", 13, at(5000), "audio", b"b", None, None), ("t", 14, at(6000), "start", None, None, "zz"),
    ("t", 15, at(6100), "flush", None, None, None), ("u", 16, at(6200), "audio", b" ", None, None), ("u", 17, at(7300), "audio", b"x", None, None), ("z", 18, at(60_000), "audio", b"y", None, None), ("z", 19, at(60_100), None, None, None, None),
]
ANSWERS = {
    "flush": [("s", 0, "ready", ""), ("s", 2, "data", ""), ("s", 6, "data", "one two"), ("s", 8, "ready", ""), ("s", 9, "data", "four"), ("s", 11, "done", ""), ("t", 14, "error", "")],
    # what u and t held comes by a timer or by the next row; z is still held
    "silence": [("s", 0, "ready", ""), ("s", 3, "data", "one"), ("s", 8, "ready", ""), ("s", 11, "done", ""), ("t", 4, "data", "a  "), ("t", 13, "data", "b"), ("t", 14, "error", ""), ("u", 16, "data", " "), ("u", 17, "data", "x")],
    # the blank of u is cleared by a second of silence, without a row: x stands alone
    "direct": [("s", 0, "ready", ""), *[("s", i, "partial", w) for i, w in ((3, "one"), (5, "two"), (7, "three"))], ("s", 8, "ready", ""), ("s", 9, "partial", "four"), ("s", 10, "partial", "five"), ("s", 11, "done", ""), ("t", 1, "partial", "a"), ("t", 4, "partial", " "), ("t", 13, "partial", "b"), ("t", 14, "error", ""), ("u", 16, "partial", " "), ("u", 17, "partial", "x"), ("z", 18, "partial", "y")],
}


@pytest.mark.parametrize("mode", live.MODES)
@pytest.mark.parametrize(("cuts", "stop_after"), [((), None), ((4, 7, 9, 16), 2)])
def test_live_sessions(spark, tmp_path, mode, cuts, stop_after):
    got = replayed(spark, MESSAGES, live.SESSION, lambda s: live.live_sessions(s, mode, models=("m",)), tmp_path, cuts, streams.ROCKSDB, stop_after).collect()
    assert sorted((r.session, r.seq, r.event, r.transcript) for r in got) == sorted(ANSWERS[mode])
    if mode == "flush":
        batch = sessions.flushed_sessions(spark.createDataFrame(MESSAGES, live.SESSION), ("m",)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
        assert {r.seq: (r.n_chunks, r.seconds) for r in got}[6] == (2, 6 / 16_000)


def test_live_sessions_ask_the_store_seldom():
    """Sound of a micro-batch is stored in one call, and nothing is read or cleared where nothing is stored."""
    calls, kept = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append(f"{self.name}.get")
            return kept.get(self.name, [] if self.name == "held" else None)

        def update(self, value):
            calls.append(f"{self.name}.update")
            kept[self.name] = value

        def appendList(self, values):  # noqa: N802
            calls.append(f"{self.name}.appendList")
            kept[self.name] = kept.get(self.name, []) + values

        def clear(self):
            calls.append(f"{self.name}.clear")
            kept.pop(self.name, None)

    class Handle:
        def getListState(self, name, schema):  # noqa: N802
            return State(name)

        getValueState = getListState  # noqa: N815

        def registerTimer(self, when):  # noqa: N802
            calls.append("timer")

        deleteTimer = registerTimer  # noqa: N815

    session = live.LiveSession("flush")
    session.init(Handle())

    def asked(*kinds, first=0):
        calls.clear()
        rows = [Row(seq=first + i, ts=at(0), kind=k, payload=b"a%d" % (first + i) if k == "audio" else None, rate=None, model=None) for i, k in enumerate(kinds)]
        out = [(r.event, r.transcript) for r in session.handleInputRows(("s",), iter(rows), None)]
        return out, list(calls)

    assert asked("audio", "flush", "audio", "audio") == ([("data", "a0")], ["facts.get", "held.appendList", "facts.update"])
    assert asked("audio", first=4) == ([], ["facts.get", "held.get", "held.appendList", "facts.update"])
    assert asked("flush", "audio", first=5) == ([("data", "a2 a3 a4")], ["facts.get", "held.get", "held.clear", "held.appendList", "facts.update"])
    assert asked("stop", first=7) == ([("done", "")], ["facts.get", "held.get", "held.clear", "timer", "facts.update"])
    assert asked("audio", first=8)[1] == ["facts.get", "facts.update"] and "held" not in kept


def test_live_sessions_know_their_modes():
    with pytest.raises(ValueError):
        live.LiveSession("whatever")


def cut_anew(db, done, frame, threshold):
    """Spans of the tail after `done`, from its frames only: start, end."""
    loud = [i for i, x in enumerate(db) if x >= threshold and i * frame >= done - 1e-9]
    spans = []
    for i in loud:
        if spans and (i - spans[-1][1] - 1) * frame < live.GAP - 1e-9:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return [(max(done, a * frame - live.PAD), min(len(db) * frame, (b + 1) * frame + live.PAD)) for a, b in spans]


def brute_turns(chunks, frame, threshold):
    db, done, out = [], 0.0, []
    for seq, chunk in chunks:
        db += chunk or []
        now, spans = len(db) * frame, cut_anew(db, done, frame, threshold)
        if not spans or now - done < live.LEAST_TAIL - 1e-9 or spans[-1][1] <= done + live.LEAST_STEP:
            continue
        start, end = spans[-1]
        final = now - end >= live.TURN_SILENCE - 1e-9
        out.append((seq, round(start, 6), round(end, 6), final, end - start <= live.LEAST_SPAN, f"Speaker {2 - len(spans) % 2}"))
        done = end if final else done
    return out


@pytest.mark.parametrize("cuts", [(), (13, 50, 51)])
def test_turns_end_after_a_second_of_silence(spark, tmp_path, cuts):
    draw, rows, chunks = random.Random(6), [], {"a": [], "b": []}
    for seq in range(160):
        call = draw.choice("ab")
        level = -20.0 if draw.random() < 0.35 else -70.0
        chunk = draw.choice([[level] * draw.randrange(1, 30), [level] * 3 + [-70.0] * 12, [-70.0] * 40, [], None])
        chunks[call].append((seq, chunk))
        rows.append((call, seq, chunk))
    got = replayed(spark, rows, live.CHUNKS, lambda s: live.turn_finals(s, frame=0.02), tmp_path, cuts).collect()
    for call in "ab":
        want = brute_turns(chunks[call], 0.02, -40.0)
        assert sorted((r.seq, round(r.start_sec, 6), round(r.end_sec, 6), r.is_final, r.too_short, r.speaker) for r in got if r.call_id == call) == want
        assert any(w[3] for w in want) and any(not w[3] for w in want)


def test_turns_of_many_random_chunks_are_those_of_the_whole_tail():
    draw = random.Random(12)
    for _ in range(150):
        frame, state, chunks, out = draw.choice([0.02, 0.5, 0.1]), (0, 0.0, 0, 0, 0), [], []
        for seq in range(60):
            chunk = [draw.choice([-20.0, -70.0, -70.0]) for _ in range(draw.randrange(8))]
            chunks.append((seq, chunk))
            state, span = live.segmented(np.array(chunk, float), state, frame, -40.0)
            if span:
                start, end, final, spans = span
                out.append((seq, round(start, 6), round(end, 6), final, end - start <= live.LEAST_SPAN, f"Speaker {2 - spans % 2}"))
        assert out == brute_turns(chunks, frame, -40.0)
