"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grades: 0 clean, 1 toxic, 2 toxic and of low quality. P(grade > j) = sigmoid(w . x - b_j) with one weight vector for
all ordered thresholds b_1 < b_2. Features are lower-cased words of the text, each present or not; the FEATURES words
that tell toxic from clean labelled documents best (signed log-likelihood ratio) make up x, if
at least LEAST_RATIO times as common in toxic ones. A document's severity is its expected grade, the sum of the
P(grade > j); it is rejected from REJECT up.

The model is fitted on at most SAMPLE labelled documents, half of it of each class at most, those with the smallest hashes
of their ids; features are chosen on the same rows. Toxic and clean rows weigh in the fit by their count among all
labelled documents over their count in the sample, so thresholds hold for the true share of toxic ones at every size.
Sampling moves ids only; the texts of the picked ones are found by a broadcast of at most SAMPLE ids. Fitting needs one
row per distinct word on the executors and SAMPLE rows of the numbers of their features on the driver. Scoring reads whole texts in one pass with no shuffle.

Defined cases: null, empty or wordless text has no features and is scored by the thresholds alone; without any labelled
document, or without a toxic one, every severity is 0 and none is rejected; a grade without documents has a threshold no
document passes; repeated labels of one id take the largest; labels of unknown ids and null labels are left out; repeated
rows are scored alike; other columns are ignored or, in filtered(), kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, release

SAMPLE, FEATURES, REJECT, SEED = 20_000, 512, 0.5, 5
LEAST_DOCUMENTS, LEAST_RATIO, L2, STEPS = 3, 2.0, 0.005, 400
_FIND = re.compile("[^\\W\\d_]+").findall


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    toxic = F.coalesce("toxic", F.lit(0)) > 0
    grade = F.when(toxic, F.when(F.coalesce("quality", F.lit(1)) > 0, 1).otherwise(2)).otherwise(0)
    return labels.filter("doc_id is not null and toxic is not null").select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.max("grade").alias("grade"))


def fit_ordinal(held: np.ndarray, sizes: np.ndarray, f: int, grade: np.ndarray, grades: int, l2: float = L2, steps: int = STEPS, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by full-batch gradient steps with momentum scaling (Adam) on the log-likelihood.

    held: the features of all rows, one row's after another's; sizes: how many of them each row has; weight: how many
    documents each row stands for, up to a factor (all alike if not given).
    """
    n = len(grade)
    part = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    row = np.repeat(np.arange(n), sizes)
    present = [j for j in range(grades - 1) if (grade > j).any()]
    w, first, gaps = np.zeros(f), 0.0, np.zeros(max(0, len(present) - 1))
    m, v = np.zeros(f + 1 + len(gaps)), np.zeros(f + 1 + len(gaps))
    level = np.searchsorted(present, grade)  # how many thresholds in use a grade passes
    for t in range(1, steps + 1):
        b = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[held], n)[:, None] - b, -30, 30)))
        cum = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
        rows = np.arange(n)
        mass = np.maximum(cum[rows, level] - cum[rows, level + 1], 1e-9)
        slope = cum * (1 - cum)
        at = np.zeros_like(cum)
        at[rows, level] += slope[rows, level] / mass
        at[rows, level + 1] -= slope[rows, level + 1] / mass
        each = at[:, 1:-1] * part[:, None]  # d log-likelihood / d (w . x - b_j)
        db = -each.sum(0)
        tail = np.cumsum(db[::-1])[::-1]
        g = np.concatenate([np.bincount(held, each.sum(1)[row], f) - l2 * w / np.sqrt(n), [tail[0]], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, first, gaps = w + step[:f], first + step[f], gaps + step[f + 1 :]
    b = np.full(grades - 1, np.inf)
    b[present] = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return w, b


def words_in(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct words of every text; training and scoring share this rule."""
    for batch in texts:
        yield pa.array([sorted(distinct_words(s.as_py())) for s in batch], pa.list_(pa.string()))


def distinct_words(text: str | None) -> set[str]:
    return set(_FIND(text.lower())) if text else set()


def sampled_ids(docs: DataFrame, labels: DataFrame, sample: int, seed: int) -> tuple[DataFrame, dict[bool, int]]:
    """doc_id, grade of at most sample // 2 toxic and as many clean labelled documents, and how many there are of each.

    Only ids are moved. Ids with hashes far above the share that is wanted are left out before the sort, so that the task
    that picks the smallest hashes gets some 2 * sample // 2 rows at any size.
    """
    known = docs.select("doc_id").filter("doc_id is not null").distinct().join(graded(labels), "doc_id").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    known = cut(known, "labelled-ids")
    n = dict(known.groupBy((F.col("grade") > 0).alias("t")).count().collect())
    most, picks = sample // 2, []
    for toxic in (True, False):
        share = min(1.0, 2 * most / max(1, n.get(toxic, 0)) + 1e-3)
        low = known.filter((F.col("grade") > 0) == toxic).filter(F.col("h") <= F.lit(int(-(2**63) + min(1.0, share) * (2**64 - 1))).cast("long") if share < 1 else F.lit(True))
        picks.append(low.orderBy("h", "doc_id").limit(most).select("doc_id", "grade"))
    return picks[0].unionByName(picks[1]), n


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, seed: int = SEED) -> Model | None:
    """docs: doc_id, text. None where there is no toxic example."""
    picked, everywhere = sampled_ids(docs, labels, sample, seed)
    if not everywhere.get(True) or not everywhere.get(False):
        return None
    held_rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `sample` ids
    held_rows = held_rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # a repeated id counts once
    rows = cut(held_rows.select("grade", F.arrow_udf(words_in, "array<string>")("text").alias("words")), "sample-words")
    n = dict(rows.groupBy((F.col("grade") > 0).alias("t")).count().collect())
    counts = rows.select((F.col("grade") > 0).cast("long").alias("t"), F.explode("words").alias("word")).groupBy("word").agg(F.sum("t").alias("bad"), F.sum(1 - F.col("t")).alias("good"))
    rate_bad, rate_good = (F.col("bad") + 0.5) / (n[True] + 1.0), (F.col("good") + 0.5) / (n[False] + 1.0)
    tells = F.col("bad") * F.log(rate_bad / rate_good)
    chosen = counts.filter((F.col("bad") >= LEAST_DOCUMENTS) & (rate_bad >= LEAST_RATIO * rate_good)).withColumn("tells", tells).filter("tells > 2").orderBy(F.desc("tells"), "word").limit(features)
    vocabulary = tuple(r.word for r in chosen.collect())
    if not vocabulary:
        release(rows)
        return None
    places = F.create_map(*[x for i, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(i))])
    known_words = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    flags = rows.select("grade", F.transform(F.array_intersect("words", known_words), lambda w: F.try_element_at(places, w)).alias("held")).toArrow()
    release(rows)
    held = flags.column("held").combine_chunks()
    grade = flags.column("grade").to_numpy()
    weight = np.where(grade > 0, everywhere[True] / n[True], everywhere[False] / n[False])
    w, b = fit_ordinal(held.flatten().to_numpy(), held.value_lengths().to_numpy(), len(vocabulary), grade, 3, weight=weight)
    return Model(vocabulary, w, b)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with __severity and __grade (the most likely one); a table that has columns of these names loses those."""
    if model is None:
        return docs.withColumns({"__severity": F.lit(0.0), "__grade": F.lit(0)})
    bounded_batches(docs.sparkSession)
    weight, thresholds = dict(zip(model.words, model.weights.tolist(), strict=True)), model.thresholds

    def above(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            sums = [sum(weight[w] for w in weight.keys() & distinct_words(s.as_py())) for s in batch]
            p = 1 / (1 + np.exp(-np.clip(np.array(sums)[:, None] - thresholds, -60, 60))) if len(sums) else np.zeros((0, 2))
            yield pa.array(p.tolist(), pa.list_(pa.float64()))

    passed = F.arrow_udf(above, "array<double>")(F.col("text"))
    marked = docs.withColumn("__above", passed)
    severity = F.aggregate("__above", F.lit(0.0), lambda a, p: a + p)
    stops = F.concat(F.array(F.lit(1.0)), "__above", F.array(F.lit(0.0)))
    mass = F.transform(F.sequence(F.lit(0), F.size("__above")), lambda j: F.get(stops, j) - F.get(stops, j + 1))
    return marked.withColumns({"__severity": severity, "__grade": (F.array_position(mass, F.array_max(mass)) - 1).cast("int")}).drop("__above")


def filtered(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of docs below `reject`, with their columns; the model learns from docs and labels."""
    model = train(docs.select("doc_id", "text"), labels)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name of the user's meets one of ours
    text = plain.columns[[c.lower() for c in docs.columns].index("text")]
    return scored(plain.withColumn("text", F.col(text)), model).filter(F.col("__severity") < reject).select(*plain.columns).toDF(*docs.columns)
