"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations are learned from a bounded sample (iterative quantisation: codes and an orthogonal Procrustes step in turn); a
vector's code is the sign pattern of its centred, rotated components. Codes are split into substrings, each of which is an
index of its own: index rows and queries meet by an equi-join on (substring, value), where a query probes all values within
`flips` bits of its own. By the pigeonhole principle that retrieves every code within substrings * (flips + 1) - 1 bits of
the query's. Pairs are then checked by the distance of their signatures, the first SIGNATURE bits of both codes, and reranked
by the distance of the original vectors in double precision.

Length, number and flips of the substrings and the signatures' radius come from the sample: of the choices that retrieve
COVERAGE of the neighbours that SAMPLE_QUERIES vectors of the sample have in the whole table (one pass over it), the one that
costs least at the table's size, counting index rows, probes and pairs that meet. So the radius shrinks as the table grows.
Vectors without structure need many substrings, and short ones; the longer the table, the longer the substrings that pay.

Scale: equal vectors are one index row that keeps its smallest ids (as many as an answer can hold, so nothing is lost), and
equal queries are one query. The join is a sort-merge join of two exchanges, which AQE splits where a value is hot. A query
that finds fewer than k is searched exactly, in blocks of queries against blocks of rows of fixed size. Rotations, which
have a fixed size, are the only things broadcast.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components or differ in length from the most
common length take no part, neither as query nor as candidate; null ids take no part; ties go to the smaller id; repeated
rows of an id and a vector are one row; a query's own id is never a candidate; fewer candidates give fewer rows; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

SAMPLE, SAMPLE_QUERIES, SEED = 8192, 256, 11
BITS, SIGNATURE, LENGTHS, FLIPS, COVERAGE, ROUNDS = 1024, 512, (8, 10, 12, 14, 16, 20, 24, 32), 1, 0.99, 20
COST_INDEX, COST_PROBE, COST_PAIR = 1.0, 1.0, 0.2
INDEX_BLOCK, QUERY_BLOCK = 16_384, 512


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    rotations: np.ndarray  # dimensions x bits
    length: int  # of a substring
    substrings: int
    flips: int
    radius: int  # of signatures


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: rows that take part, each once."""
    v = F.col(vec_col).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0)).filter(fine)


def rotation(x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """An orthogonal map whose signs quantise x well."""
    out, _ = np.linalg.qr(draw.normal(size=(x.shape[1], x.shape[1])))
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(np.where(x @ out >= 0, 1.0, -1.0).T @ x)
        out = (u @ vt).T
    return out


def ball(length: int, flips: int) -> int:
    return sum(math.comb(length, i) for i in range(flips + 1))


def learn(sample: np.ndarray, k: int, n: int, n_queries: int, coverage: float = COVERAGE, seed: int = SEED, known: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """A model for a table of n rows and n_queries queries. known: places in the sample and the vectors near them in the whole table."""
    draw = np.random.default_rng(seed)
    mean = sample.mean(0)
    x = sample - mean
    few = x[: max(1024, 4 * x.shape[1])]
    rotations = np.hstack([rotation(few, draw) for _ in range(-(-BITS // x.shape[1]))])[:, :BITS]
    bits = x @ rotations >= 0
    mine, near = [], []
    for i in range(min(SAMPLE_QUERIES, len(x)) if known is None else 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        best = np.argpartition(d, min(k, len(d) - 1))[:k]
        best = best[np.isfinite(d[best])]
        mine += [i] * len(best)
        near += best.tolist()
    mine, near_bits = (mine, bits[near]) if known is None else (known[0], (known[1] - mean) @ rotations >= 0)
    if not len(mine):
        return Model(mean, rotations, LENGTHS[0], 1, 0, BITS)
    apart = bits[mine] != near_bits
    others = bits[draw.integers(0, len(x), 4096)] != bits[draw.integers(0, len(x), 4096)]
    options = []
    for length in LENGTHS:
        most = BITS // length
        away, away_others = (b[:, : most * length].reshape(len(b), most, length).sum(2) for b in (apart, others))
        for flips in range(min(FLIPS, length - 1) + 1):
            found = np.logical_or.accumulate(away <= flips, 1).mean(0)
            enough = int(np.argmax(found >= coverage)) + 1 if found[-1] >= coverage else most
            meet = (away_others[:, :enough] <= flips).sum(1).mean()
            cost = COST_INDEX * n * enough + COST_PROBE * n_queries * enough * ball(length, flips) + COST_PAIR * n_queries * n * meet
            options.append((found[enough - 1] < coverage, cost if found[-1] >= coverage else -found[-1], length, enough, flips))
    _, _, length, substrings, flips = min(options)
    return Model(mean, rotations, length, substrings, flips, int(np.ceil(np.quantile(apart[:, :SIGNATURE].sum(1), 0.995))))


def near_ones(distinct: DataFrame, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of SAMPLE_QUERIES vectors of the sample, and their k nearest others in the whole table: one pass, k rows a task and vector.

    They are the last ones, as the rotations are learned from the first, whose codes suit them better than those of other rows.
    """
    behind = max(0, len(sample) - SAMPLE_QUERIES)
    asked = sample[behind:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asked), k), np.inf)
        those = np.zeros((len(asked), k, asked.shape[1]))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, a in enumerate(asked):
                d = ((v - a) ** 2).sum(1)
                d[d == 0] = np.inf  # vectors are distinct, so that is itself
                few = np.argpartition(d, k - 1)[:k] if len(d) > k else np.arange(len(d))
                both = np.concatenate([best[i], d[few]])
                order = np.argsort(both, kind="stable")[:k]
                best[i], those[i] = both[order], np.concatenate([those[i], v[few]])[order]
        place, at = np.nonzero(np.isfinite(best))
        if len(place):
            found = those[place, at]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(best[place, at]), lists], ["place", "d", "v"])

    order = Window.partitionBy("place").orderBy("d", "v")
    found = distinct.select("v").mapInArrow(run, "place long, d double, v array<double>").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("place", "v").toArrow()
    return found.column("place").to_numpy() + behind, np.array(found.column("v").to_pylist()).reshape(-1, sample.shape[1])


def coded(vectors: DataFrame, model: Model) -> DataFrame:
    """lead, sig (longs), subs: the values of the substrings. vectors: lead, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(model.length, dtype=np.int64)
        used = model.length * model.substrings
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            bits = (v - model.mean) @ model.rotations >= 0
            sig = np.packbits(bits[:, :SIGNATURE], axis=1, bitorder="little").view(np.int64)
            subs = (bits[:, :used].reshape(len(v), model.substrings, model.length) * weights).sum(2)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (sig, subs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["lead", "sig", "subs"])

    return vectors.select("lead", "v").mapInArrow(run, "lead long, sig array<long>, subs array<long>")


def flip_masks(length: int, flips: int) -> list[int]:
    out = {0}
    for _ in range(flips):
        out |= {m | 1 << i for m in out for i in range(length)}
    return sorted(out)


def meetings(codes: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
    """query, lead: pairs that meet in a substring and have near signatures. asked: lead of every query.

    A pair meets in the first of the substrings in the signature that are near: near copies, which are near in all, meet once.
    """
    place = lambda j, value: F.col(j).cast("long") * (1 << model.length) + value
    words = range(min(BITS, SIGNATURE) // 64)
    longs = lambda name: [F.coalesce(F.get("sig", i), F.lit(0)).alias(f"{name}{i}") for i in words]  # noqa: E731  (plain columns keep the join's code short enough to be compiled)
    index = codes.select("lead", *longs("s"), F.posexplode("subs").alias("j", "value")).select("lead", *[f"s{i}" for i in words], place("j", F.col("value")).alias("key"))
    probes = codes.join(asked, "lead", "left_semi").select(F.col("lead").alias("query"), *longs("q"), F.posexplode("subs").alias("j", "value"))
    masks = F.array(*[F.lit(m).cast("long") for m in flip_masks(model.length, model.flips)])
    probes = probes.withColumn("mask", F.explode(masks)).select("query", *[f"q{i}" for i in words], place("j", F.col("value").bitwiseXOR(F.col("mask"))).alias("key"))
    apart = [F.col(f"s{i}").bitwiseXOR(F.col(f"q{i}")) for i in words]
    off = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))

    def near(j: int) -> Column:
        word, at = divmod(j * model.length, 64)
        value = F.shiftrightunsigned(apart[word], at)
        if at + model.length > 64:
            value = value.bitwiseOR(F.shiftleft(apart[word + 1], 64 - at))
        return F.bit_count(value.bitwiseAND(F.lit((1 << model.length) - 1).cast("long"))) <= model.flips

    inside = min(model.substrings, len(words) * 64 // model.length)
    met = F.when(near(0), 0)
    for j in range(1, inside):
        met = met.when(near(j), j)
    met = met.otherwise(inside)
    own = F.shiftright("key", model.length)
    return probes.join(index, "key").filter(off <= model.radius).filter(F.least(own, F.lit(inside)) == met).select("query", "lead")


def candidates(codes: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
    """query, lead, each once. Only pairs that first meet behind the signature can meet more than once."""
    return meetings(codes, asked, model).distinct()


def _exactly(distinct: DataFrame, asked: DataFrame, k: int, index_block: int, query_block: int) -> DataFrame:
    """query, id, score: the k nearest of each query in each block of rows. asked: lead of every query."""
    n, n_queries = distinct.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // index_block)), max(1, -(-n_queries // query_block))
    spread = lambda parts: F.pmod(F.xxhash64("lead"), F.lit(parts)).cast("int")
    index = distinct.select("v", "ids", spread(blocks).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = distinct.join(asked, "lead", "left_semi").select(F.col("lead").alias("query"), "v", spread(query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ib"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v, ids = np.array(right["v"].tolist()), right["ids"].tolist()
            for q, qv in zip(left["query"], np.array(left["v"].tolist()), strict=True):
                d = np.sqrt(((v - qv) ** 2).sum(1))
                near = np.flatnonzero(d <= np.sort(d)[min(len(d), k) - 1])
                out += [(q, i, x) for x, i in sorted((d[row], i) for row in near for i in ids[row])[:k]]
        return pd.DataFrame(out, columns=["query", "id", "score"])

    return queries.groupBy("ib", "qb").cogroup(index.groupBy("ib", "qb")).applyInPandas(best, "query long, id long, score double")


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK, coverage: float = COVERAGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by `every`."""
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == lengths.d)
    distinct = cut(_smallest(rows, k + 1), "vectors")
    queries = cut(rows.filter(F.col("id") % every == 0).distinct().join(distinct.select("v", "lead"), "v").select(F.col("id").alias("query_id"), F.col("lead").alias("query")), "query-vectors")
    n, n_queries = distinct.count(), queries.count()
    share = min(1.0, 2 * SAMPLE / n)  # only rows with low hashes are sorted, so that no task gets more at any size
    low = distinct.withColumn("h", F.xxhash64(F.lit(SEED), "lead")).filter((F.shiftrightunsigned("h", 12) <= int(share * (1 << 52))))
    sample = np.array([r.v for r in low.orderBy("h", "lead").limit(SAMPLE).select("v").collect()])
    model = learn(sample, k, n, n_queries, coverage, known=near_ones(distinct, sample, k))
    asked = queries.select(F.col("query").alias("lead")).distinct()
    codes = cut(coded(distinct, model), "vector-codes")
    pairs = candidates(codes, asked, model)
    met = pairs.join(distinct.select(F.col("lead").alias("query"), F.col("v").alias("qv")), "query").join(distinct, "lead")
    score = F.sqrt(F.aggregate(F.zip_with("qv", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    found = met.select("query", score.alias("score"), F.explode("ids").alias("id"))
    order = Window.partitionBy("query").orderBy("score", "id")
    nearest = cut(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1), "nearest")
    few = asked.withColumnRenamed("lead", "query").join(nearest.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "query", "left").filter(F.coalesce("n", F.lit(0)) <= k).select(F.col("query").alias("lead"))
    few = cut(few, "queries-with-few")
    if not few.isEmpty():
        more = _exactly(distinct, few, k + 1, index_block, query_block)
        rest = nearest.join(few.withColumnRenamed("lead", "query"), "query", "left_anti").select("query", "id", "score")
        nearest = rest.unionByName(more)
    mine = queries.join(nearest.select("query", "id", "score"), "query").filter("id != query_id")
    last = Window.partitionBy("query_id").orderBy("score", "id")
    out = mine.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    release(codes)
    return out


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """v, lead, ids: the smallest ids of every distinct vector, thinned within tasks before they meet."""
    part = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = part.withColumn("k", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).filter(F.col("k") <= most)
    lists = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.select("v", F.element_at("ids", 1).alias("lead"), F.slice("ids", 1, most).alias("ids"))
