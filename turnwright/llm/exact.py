"""Exact dedup by deterministic block naming (DataFrame operations only).

Every normalised text is split into blocks of BLOCK characters. The distinct blocks are sorted and numbered, so a
block's name is an integer that no other block has. Adjacent names of a document are paired, the distinct pairs are
sorted and numbered in turn, and so on until each document is one integer; with the number of blocks it started from,
that integer is equal for two documents exactly if their texts are. No step relies on hashes being free of collisions:
a 64-bit hash only narrows which names a block is joined to, and blocks whose hashes clash are joined by content.

Scale: whole blocks are shuffled once, after map-side distinct; what returns to the documents are (hash, position)
rows. Names and groups are files before they are joined, so joins are plain sort-merge joins of two exchanges, and AQE
splits a block or group that holds a third of the rows.

Defined cases: null text is empty; an empty text is one empty block; rows that repeat an id and a text are one group's
rows (only the first is kept); rows with a null id take part, and such a row stays only if its group has no id at all;
columns other than id and text are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, release

BLOCK = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _names(values: DataFrame, by: list[str], tag: str) -> DataFrame:
    """Sorted distinct values with an integer each; equal input rows give equal integers however tasks are retried."""
    return cut(values.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), tag)


def _named_blocks(blocks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    names = _names(blocks.select("h", "block"), ["block", "h"], "block-names")
    by_hash = cut(names.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")), "names-by-hash")
    out = blocks.select("doc_id", "sha", "pos", "h").join(by_hash.filter("n = 1").drop("n"), "h").select("doc_id", "sha", "pos", "name")
    clash = by_hash.filter("n > 1").select("h")
    if not clash.isEmpty():
        some = blocks.join(clash, "h", "left_semi").join(names.join(clash, "h", "left_semi"), ["h", "block"])
        out = out.unionByName(some.select("doc_id", "sha", "pos", "name"))
    return out, [names, by_hash]


def identities(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64, block: int = BLOCK) -> DataFrame:
    """(doc_id, sha, n_rows, n_blocks, name): (n_blocks, name) is the text's identity. docs: doc_id, norm."""
    keyed = docs.select("doc_id", "norm", F.sha2("norm", 256).alias("sha"))
    parts = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block), F.lit(0)))
    blocks = keyed.select("doc_id", "sha", F.posexplode(parts).alias("pos", "block")).withColumn("h", fingerprint(F.col("block")))
    named, names = _named_blocks(blocks)
    in_order = F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"])
    rows = cut(named.groupBy("doc_id", "sha").agg(in_order.alias("names")).withColumn("n_blocks", F.size("names")), "names-0")
    release(*names)
    done, levels, level = [], [rows], 0
    while True:
        done.append(rows.filter(F.size("names") == 1).select("doc_id", "sha", "n_blocks", F.col("names")[0].alias("name")))
        rest = rows.filter(F.size("names") > 1)
        if rest.isEmpty():
            break
        level += 1
        left = F.sequence(F.lit(0), F.size("names") - 1, F.lit(2))
        pair = lambda i: F.struct(F.get("names", i).alias("l"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("r"))
        pairs = rest.select("doc_id", "sha", "n_blocks", F.posexplode(F.transform(left, pair)).alias("pos", "p")).select("doc_id", "sha", "n_blocks", "pos", "p.l", "p.r")
        renamed = _names(pairs.select("l", "r"), ["l", "r"], f"pair-names-{level}")
        rows = cut(pairs.join(renamed, ["l", "r"]).groupBy("doc_id", "sha", "n_blocks").agg(in_order.alias("names")), f"names-{level}")
        levels.append(rows)
        release(renamed)
    ids = done[0]
    for more in done[1:]:
        ids = ids.unionByName(more)
    copies = keyed.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n_rows"))
    ids = ids.withColumnsRenamed({"doc_id": "i", "sha": "s"})
    out = cut(copies.join(ids, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s"))).drop("i", "s"), "identities")
    release(*levels)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_blocks, identity."""
    ids = identities(docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")), **how)
    groups = cut(ids.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size")), "copy-groups")
    each = ids.join(groups, ["n_blocks", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    return each.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"), "n_blocks", F.col("name").alias("identity"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Texts are shuffled once, by id and hash: repeated rows are dropped before and after it, and the join with the ids that
    stay finds its rows where they are. Rows without an id, if any, go the same way by hash alone.
    """
    kept = cut(exact_groups(docs, id_col, text_col, **how).filter("kept").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s")), "kept-ids")
    own, i, s = fresh(docs, "own", "kept_id", "kept_sha")
    marked = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    stay = kept.select(F.col("i").alias(i), F.col("s").alias(s))
    with_id = marked.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, own])
    out = with_id.join(stay.filter(F.col(i).isNotNull()), (F.col(id_col) == F.col(i)) & (F.col(own) == F.col(s)), "left_semi")
    if not kept.filter("i is null").isEmpty():
        without = marked.filter(F.col(id_col).isNull()).dropDuplicates([own])
        out = out.unionByName(without.join(stay.filter(F.col(i).isNull()), F.col(own) == F.col(s), "left_semi"))
    return out.drop(own)
