"""The corpus pipeline: documents without toxic ones, exact copies and near copies, mixed to target weights, as piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwright.llm import exact, minhash, mixing, sentencepiece_lattice, toxicity
from turnwright.llm.common import cut, table
from turnwright.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below toxicity.REJECT; the model learns from this stage's documents."""
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of five-word shingle sets at similarity 0.8 or more."""
    return minhash.keep_representatives(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and whether decoding them gives the text back."""
    model = sentencepiece_lattice.read_model(tokenizer_file("piece_bpe_32k.model"))
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, model), model)
    return back.select("doc_id", F.size("ids").alias("n_ids"), "ids", (F.xxhash64("__text") == F.col("h")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Neither the fitted toxicity model nor the encoder can be put in SQL; tests hold the stages against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
