"""Sound at another rate: polyphase filtering by the ratio in lowest terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The filter's half width in input periods of the larger factor, and its window's shape.
HALF_WIDTH, KAISER_BETA = 10, 5.0
BLOCK = 1 << 16
#: Bytes of sound that a task holds before it hands them on.
AT_ONCE = 4 << 20


@cache
def low_pass(up: int, down: int) -> np.ndarray:
    """A windowed sinc that passes what both rates can hold, of gain `up`, as long as twice HALF_WIDTH * max(up, down), plus one."""
    widest = max(up, down)
    n = np.arange(-HALF_WIDTH * widest, HALF_WIDTH * widest + 1)
    taps = np.sinc(n / widest) * np.kaiser(len(n), KAISER_BETA)
    return taps / taps.sum() * up


def polyphase(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x with up - 1 zeros behind each sample, filtered, every down-th kept: ceil(len(x) * up / down) samples.

    Only taps that meet a sample are multiplied, and outputs are made a block at a time, so that memory beside the sound is
    bounded by BLOCK.
    """
    if not len(x):
        return np.empty(0)
    taps = low_pass(up, down)
    half = len(taps) // 2
    reach = half // up + 1  # samples on either side that a tap can meet
    near = np.arange(-reach, reach + 2)
    tap = half + np.arange(up)[:, None] - near * up
    phases = np.where((tap >= 0) & (tap < len(taps)), taps[np.clip(tap, 0, len(taps) - 1)], 0.0)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)]), len(near))
    size = -(-len(x) * up // down)
    out, step = np.empty(size), max(1, BLOCK // len(near))
    for a in range(0, size, step):
        at = np.arange(a, min(size, a + step)) * down
        out[a : a + step] = np.einsum("ij,ij->i", around[at // up], phases[at % up])
    return out


def _resampled(raw: bytes, rate: int, target: int) -> bytes:
    x = np.frombuffer(raw, "<i2", len(raw) // 2)
    if rate != target:
        d = gcd(rate, target)
        x = np.clip(np.rint(polyphase(x.astype(np.float64), target // d, rate // d)), -32768, 32767).astype("<i2")
    return x.tobytes()


def _pieces(sound: pa.Array, rates: list, targets: list, at_once: int = AT_ONCE) -> Iterator[pa.Array]:
    """A batch's sounds, made one at a time and handed on at `at_once` bytes, as a batch may hold long ones."""
    made, size = [], 0
    for s, r, t in zip(sound, rates, targets, strict=True):
        made.append(None if None in (r, t) or not s.is_valid else _resampled(s.as_py(), r, t))
        size += len(made[-1] or b"")
        if size >= at_once:
            yield pa.array(made, pa.binary())
            made, size = [], 0
    if made:
        yield pa.array(made, pa.binary())


def resampled(pcm: Column, rate: Column, target: Column) -> Column:
    """16-bit samples at the target rate, rounded half to even and clipped; the same samples if the rates are equal.

    Null sound or rates give null, rates that are not above zero an error; a last odd byte is left out.
    """

    def run(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sound, rates, targets in columns:
            yield from _pieces(sound, rates.to_pylist(), targets.to_pylist())

    positive = lambda c: F.when((c > 0) | c.isNull(), c.cast("int")).otherwise(F.raise_error(F.lit("rates must be above zero")))
    return F.arrow_udf(run, "binary")(pcm, positive(rate), positive(target))


def fitted(pcm: Column, samples: Column) -> Column:
    """Sound cut or filled with silence at its end to a number of samples."""
    return F.substring(F.concat(pcm, F.repeat(F.lit("\0"), F.greatest(samples * 2 - F.octet_length(pcm), F.lit(0)).cast("int")).cast("binary")), F.lit(1), (samples * 2).cast("int"))
