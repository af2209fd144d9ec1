"""Resampling against a direct convolution of the whole sound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwright.functions.resample import _pieces, fitted, low_pass, resampled


def direct(x, rate, target):
    d = np.gcd(rate, target)
    up, down = target // d, rate // d
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    taps = low_pass(up, down)
    y = np.convolve(spread, taps)[len(taps) // 2 :][: len(spread)][::down] if len(x) else np.zeros(0)
    return np.clip(np.rint(y), -32768, 32767).astype("<i2")


def test_against_direct_convolution(spark):
    draw, cases = np.random.default_rng(5), []
    for rate, target in ((8000, 16000), (16000, 8000), (44100, 16000), (16000, 48000), (8000, 8000), (48000, 44100)):
        for n in (0, 1, 2, 37, 3000):
            cases.append((len(cases), rate, target, draw.integers(-32768, 32768, n).astype("<i2").tobytes()))
    cases.append((len(cases), 8000, 16000, np.tile(np.array([32767, -32768], "<i2"), 60_000).tobytes()))
    rows = spark.createDataFrame(cases, "i int, rate int, target int, pcm binary").repartition(3)
    got = {r.i: r.y for r in rows.select("i", resampled(F.col("pcm"), F.col("rate"), F.col("target")).alias("y")).collect()}
    for i, rate, target, pcm in cases:
        x = np.frombuffer(pcm, "<i2")
        y, want = np.frombuffer(got[i], "<i2"), x if rate == target else direct(x.astype(float), rate, target)
        assert len(y) == len(want) and np.abs(y.astype(int) - want).max(initial=0) <= 1 and (y != want).mean() < 0.001 if len(want) else len(y) == 0


def test_tone_nulls_and_fit(spark):
    t = np.arange(16000) / 8000
    pcm = np.rint(10000 * np.sin(2 * np.pi * 440 * t)).astype("<i2").tobytes()
    rows = spark.createDataFrame([(0, pcm, 8000), (1, None, 8000), (2, pcm, None), (3, b"\x01\x02\x03", 16000)], "i int, pcm binary, rate int")
    there = resampled(F.col("pcm"), F.col("rate"), F.lit(16000))
    got = {r.i: r for r in rows.select("i", there.alias("y"), fitted(there, F.lit(5)).alias("five")).collect()}
    y = np.frombuffer(got[0].y, "<i2")
    want = 10000 * np.sin(2 * np.pi * 440 * np.arange(32000) / 16000)
    assert len(y) == 32000 and np.abs(y - want)[400:-400].max() < 20 and got[1].y is None and got[2].y is None and got[3].y == b"\x01\x02"
    assert got[0].five == got[0].y[:10] and got[3].five == b"\x01\x02" + b"\0" * 8
    with pytest.raises(Exception, match="above zero"):
        rows.select(resampled(F.col("pcm"), F.lit(0), F.lit(16000))).collect()
    assert rows.limit(0).select(there).count() == 0


def test_a_batch_is_handed_on_in_pieces():
    """What a task holds of made sound is bounded by bytes, not by the rows of its batch."""
    import pyarrow as pa

    raw = [bytes(200), None, bytes(4000), b"", bytes(100)] * 20
    pieces = list(_pieces(pa.array(raw, pa.binary()), [8000] * 100, [16000] * 99 + [None], at_once=5000))
    assert all(sum(len(x) for x in p.to_pylist() if x) < 5000 + 8000 for p in pieces) and len(pieces) > 10
    assert [None if x is None else len(x) for p in pieces for x in p.to_pylist()] == [None if x is None else 2 * len(x) for x in raw[:-1]] + [None]
