"""Files of transcripts, turns, phrases and sound as tables, and back."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.phrases import display, distinct_variants, variant_key
from ..operators.turns import mark_overlaps


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """path, speaker, start_sec, end_sec of SPEAKER lines with at least eight fields."""
    fields = F.filter(F.split("value", "\\s+"), lambda f: f != "")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), fields.alias("f")).filter((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    at = lambda i: F.get("f", F.lit(i))
    return rows.select("path", at(7).alias("speaker"), at(3).cast("double").alias("start_sec"), (at(3).cast("double") + at(4).cast("double")).alias("end_sec"))


def read_turns(spark: SparkSession, path: str, bucket: float = 60.0) -> DataFrame:
    """read_rttm()'s rows with overlap_flag, and place: from 0 in each file by start, end and speaker."""
    by = Window.partitionBy("path").orderBy("start_sec", "end_sec", "speaker")
    return mark_overlaps(read_rttm(spark, path), ["path"], bucket=bucket).withColumn("place", F.row_number().over(by) - 1)


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """place, key, variants of a phrase file: `_` between variants, `#` before comments, groups of one first variant joined."""
    numbered = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    lines = numbered.withColumn("value", F.trim("value")).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.select("place", F.posexplode(F.split("value", "_")).alias("n", "part")).withColumn("part", display(F.col("part"))).filter("part != ''")
    first = F.first("part").over(Window.partitionBy("place").orderBy("n"))
    keyed = parts.withColumn("key", variant_key(first))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "n", "part"))), lambda x: x["part"])
    return keyed.groupBy("key").agg(F.min("place").alias("place"), ordered.alias("all")).select("place", "key", distinct_variants(F.col("all")).alias("variants"))


def write_phrases(pack: DataFrame, path: str, request: str) -> None:
    """One file of lines for each request."""
    pack.select(request, "place", F.col("line").alias("value")).repartition(request).sortWithinPartitions(request, "place").select(request, "value").write.partitionBy(request).text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under the header's names; fields of any length, line breaks in quotes."""
    return spark.read.csv(path, header=True, multiLine=True, inferSchema=False, escape='"', maxCharsPerColumn=-1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a string `text`; other keys are kept, a line without one is an error."""
    rows = spark.read.option("mode", "FAILFAST").json(path)
    if dict(rows.dtypes).get("text") != "string":
        raise ValueError("every line needs a string `text`")
    return rows.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.lit("every line needs a string `text`"))))


def write_transcripts(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def read_sound(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of files, for wav_channels()."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def _parsed(raw: bytes) -> tuple[int, int, np.ndarray]:
    with wave.open(io.BytesIO(raw)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("16-bit samples are expected")
        return f.getframerate(), f.getnchannels(), np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())


def wav_channels(sounds: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, channel, rate, pcm: a row for each channel of 16-bit WAV files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rate, n, samples = _parsed(raw.as_py())
                out += [(k, c, rate, np.ascontiguousarray(samples[:, c]).tobytes()) for c in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["key", "channel", "rate", "pcm"])

    kept = sounds.select(F.col(key).cast("string").alias("key"), content)
    return kept.mapInArrow(run, "key string, channel int, rate int, pcm binary").withColumnRenamed("key", key)


def wav_bytes(pcm: Column, rate: Column) -> Column:
    """A mono WAV file of 16-bit samples."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sound, rates in columns:
            head = lambda n, r: b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, r, 2 * r, 2, 16) + b"data" + struct.pack("<I", n)
            yield pa.array([None if s is None else head(len(s), r) + s for s, r in zip(sound.to_pylist(), rates.to_pylist(), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(pcm, rate)


def loudness(pcm: Column, rate: Column, frame_ms: int = 30) -> Column:
    """Decibels of whole frames; [-120] without one."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sound, rates in columns:
            out = []
            for s, r in zip(sound.to_pylist(), rates.to_pylist(), strict=True):
                frame = max(1, r * frame_ms // 1000)
                x = np.frombuffer(s, "<i2").astype(np.float64)[: len(s) // 2 // frame * frame].reshape(-1, frame) / 32768.0
                out.append((20 * np.log10(np.maximum(np.sqrt((x * x).mean(1)), 1e-6))).tolist() if len(x) else [-120.0])
            yield pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(pcm, rate)


def split_on_silence(pcm: Column, rate: Column, longest: float = 30.0, tail: float = 5.0, least: float = 10.0, block: float = 0.1) -> Column:
    """array<struct<start, stop>> of sample places: cuts at most `longest` seconds apart, in the quietest block near the end."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sound, rates in columns:
            out = []
            for s, r in zip(sound.to_pylist(), rates.to_pylist(), strict=True):
                x, width, start, parts = np.frombuffer(s, "<i2").astype(np.float64), max(1, int(block * r)), 0, []
                while len(x) - start > longest * r:
                    end = start + int(longest * r)
                    lo = max(start + int(least * r), end - int(tail * r))
                    n = max(1, (end - lo) // width)
                    power = (x[lo : lo + n * width].reshape(n, -1) ** 2).mean(1)
                    at = lo + int(power.argmin()) * width + width // 2
                    parts.append({"start": start, "stop": at})
                    start = at
                out.append([*parts, {"start": start, "stop": len(x)}])
            yield pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))

    return F.arrow_udf(run, "array<struct<start:long,stop:long>>")(pcm, rate)


def slice_pcm(pcm: Column, rate: Column, start_sec: Column, end_sec: Column) -> Column:
    """Samples between two times; places are rounded half to even."""
    first = F.greatest(F.bround(start_sec * rate), F.lit(0)).cast("int")
    last = F.least(F.bround(end_sec * rate), F.length(pcm) / 2).cast("int")
    return F.substr(pcm, first * 2 + 1, F.greatest(last - first, F.lit(0)) * 2)


def duration(pcm: Column, rate: Column) -> Column:
    return F.length(pcm) / (rate * 2)
