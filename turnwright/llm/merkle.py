"""A Merkle manifest of a dataset: leaf digests of rows, one tree per group, one root over the groups, and proofs of every row.

H is the lowercase hex sha256 of its inputs put together. A row's leaf is H of its columns, each `-` if null, else its UTF-8
byte count, `:` and its value. In a group (lang) leaves ascend by id; while several nodes remain, every ARITY consecutive ones
(in the last run fewer, even one) become their H. What remains is the group's subroot; subroots in the order of their groups
(null first, bytewise) give the root in the same way.

Trees are built by an associative merge of sparse forests. A forest holds unresolved nodes keyed by tree, level and index; the
number of a tree's leaves tells how many siblings each run has, so whenever the last sibling of a run is there, in whatever order
it came, the run gives way to its parent. Tasks resolve aligned blocks of ARITY ** k leaves each to one node; treeReduce merges
what is left of trees of several blocks, and keeps the runs that it completes, which proofs need. k is such that there are at
most TOP blocks for each so many leaves, so the driver gets at most TOP + 1 nodes at any size, and a task holds one block's
digests: 4,096 at first, 262,144 at ten billion rows. Trees of one block never reach the driver. The tree over subroots is
built by the same function, so any number of groups will do.

Texts are read once and never shuffled: leaves are digests by then. Ranks within a group come from a range partition, whose
ranges split a group of any size, and from the counts of its partitions.

Proofs: each block's digests and its path, the runs above it, meet in one task, which gives every row the digest of its
siblings (level by level, left to right, up to the root) and the root folded from its tampered leaf and those siblings.

Defined cases: null ids sort first, and are not tampered; rows that repeat an id are leaves of their own, in the order of their
digests; null and empty texts have different leaves (`-` and `0:`); rows of a null group are a group; a tree of one leaf is that
leaf; without siblings the proof is H of nothing. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, release

ARITY, TOP, LEAST_POWER = 8, 65_536, 4


def h(parts: list[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


class Forest:
    """Unresolved nodes {(tree, level, index): digest} of trees with known numbers of leaves; runs: those completed, by the parent's key."""

    def __init__(self, nodes: dict, leaves: dict, runs: dict | None = None) -> None:
        self.nodes, self.leaves, self.runs = nodes, leaves, {} if runs is None else runs

    def width(self, tree: object, level: int) -> int:
        n = self.leaves[tree]
        for _ in range(level):
            n = -(-n // ARITY)
        return n

    def resolve(self, keys: list, limit: int | None = None) -> Forest:
        """Replace the runs of these nodes by their parents where they are complete, up to a level and then upwards."""
        for key in keys:
            while key is not None and key in self.nodes:
                tree, level, i = key
                n = self.width(tree, level)
                first = i // ARITY * ARITY
                siblings = [(tree, level, j) for j in range(first, min(first + ARITY, n))]
                key = None
                if n > 1 and level != limit and all(s in self.nodes for s in siblings):
                    key = (tree, level + 1, first // ARITY)
                    run = tuple(self.nodes.pop(s) for s in siblings)
                    self.runs[key], self.nodes[key] = run, h(run)
        return self

    def merge(self, other: Forest) -> Forest:
        both = Forest({**self.nodes, **other.nodes}, {**self.leaves, **other.leaves}, {**self.runs, **other.runs})
        return both.resolve(list(self.nodes if len(self.nodes) < len(other.nodes) else other.nodes))


def _path(forest: Forest, tree: object, level: int, i: int, top: int | None = None) -> list[tuple[int, tuple]]:
    """From a node upwards: its place in each run, and the run."""
    out = []
    while level != top and (run := forest.runs.get((tree, level + 1, i // ARITY))) is not None:
        out.append((i % ARITY, run))
        level, i = level + 1, i // ARITY
    return out


def _grown(digests: dict[int, str], n: int, power: int) -> Forest:
    """The forest of one block: leaves by index in a tree of n, resolved up to level `power`."""
    block = Forest({(0, 0, i): d for i, d in digests.items()}, {0: n})
    return block.resolve([(0, 0, i) for i in digests], power)


def _power(n: int) -> int:
    power = LEAST_POWER
    while n > TOP * ARITY**power:
        power += 1
    return power


_STEP = "struct<at:int,run:array<string>>"
_STEPS = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))


def built(leaves: DataFrame, power: int) -> tuple[DataFrame, DataFrame]:
    """(tree, root), and (tree, block, path): the runs above each block. leaves: tree, i, n (leaves of the tree), digest."""
    spark, span = leaves.sparkSession, ARITY**power

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = {}, 0
        for batch in batches:
            found.update(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True))
            tree, block, n = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), batch.column(3)[0].as_py()
        ((_, level, _), digest), *rest = _grown(found, n, power).nodes.items()
        if rest:
            raise ValueError(f"tree {tree}, block {block}: leaves are missing or repeated")
        yield pa.RecordBatch.from_pylist([{"tree": tree, "block": block, "n": n, "level": level, "digest": digest}], pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("digest", pa.string())]))

    blocks = leaves.select("tree", F.floor(F.col("i") / span).alias("block"), "i", "n", "digest").groupBy("tree", "block")
    blocks = cut(blocks.applyInArrow(resolved, "tree long, block long, n long, level int, digest string"), "merkle-blocks")
    merged = Forest({}, {})
    large = blocks.filter(F.col("n") > span)
    if not large.isEmpty():
        merged = large.select("tree", "block", "n", "level", "digest").rdd.mapPartitions(_forest_of).treeReduce(lambda a, b: a.merge(b))
    runs = merged.runs  # at most TOP / (ARITY - 1), and some at the ends of trees

    def pathed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Forest({}, {}, runs)
        for batch in batches:
            trees, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            paths = [[{"at": at, "run": list(run)} for at, run in _path(top, tree, power, i)] for tree, i in zip(trees, numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, _STEPS)], ["tree", "block", "path"])

    tops = [(tree, digest) for (tree, _, _), digest in merged.nodes.items()]
    roots = blocks.filter(F.col("n") <= span).select("tree", F.col("digest").alias("root"))
    if tops:
        roots = roots.unionByName(spark.createDataFrame(tops, "tree long, root string"))
    return roots, blocks.select("tree", "block").mapInArrow(pathed, f"tree long, block long, path array<{_STEP}>")


def _forest_of(rows: Iterator) -> Iterator[Forest]:
    """One forest of a partition's block nodes."""
    nodes, leaves = {}, {}
    for r in rows:
        nodes[r.tree, r.level, r.block], leaves[r.tree] = r.digest, r.n
    if nodes:
        yield Forest(nodes, leaves).resolve(list(nodes))


def proved(leaves: DataFrame, above: DataFrame, power: int) -> DataFrame:
    """doc_id, tree, leaf, proof, folded of every leaf. leaves: doc_id, tree, i, n, digest, start (the leaf to fold from); above: tree, block, path."""
    span = ARITY**power

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        index, digest, start = (left.column(c).to_pylist() for c in ("i", "digest", "start"))
        block = _grown(dict(zip(index, digest, strict=True)), left.column("n")[0].as_py(), power)
        upper = [(s["at"], s["run"]) for s in right.column("path")[0].as_py()]
        proofs, roots = [], []
        for i, own in zip(index, start, strict=True):
            siblings = []
            for at, level in _path(block, 0, 0, i, power) + upper:
                before, after = level[:at], level[at + 1 :]
                siblings += before
                siblings += after
                own = h([*before, own, *after])
            proofs.append(h(siblings))
            roots.append(own)
        own = [left.column(c) for c in ("doc_id", "tree", "digest")]
        return pa.table([*own, pa.array(proofs, pa.string()), pa.array(roots, pa.string())], ["doc_id", "tree", "leaf", "proof", "folded"])

    dealt = leaves.select("doc_id", "tree", F.floor(F.col("i") / span).alias("block"), "i", "n", "digest", "start").groupBy("tree", "block")
    return dealt.cogroup(above.groupBy("tree", "block")).applyInArrow(run, "doc_id long, tree long, leaf string, proof string, folded string")


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with i, the place within the group, and n, its size; in a file."""
    spread = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    spread = cut(spread.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "merkle-ranges")
    counts = spread.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__lo"))
    # a group has as many of these rows as it has partitions
    sums = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__g").orderBy("__p")) - F.col("__n")).withColumn("n", F.sum("__n").over(Window.partitionBy("__g")))
    met = spread.join(sums.drop("__n"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    out = cut(met.withColumn("i", F.col("__at") - F.col("__lo") + F.col("__before")).drop("__part", "__at", "__g", "__p", "__lo", "__before"), "merkle-ranks")
    release(spread)
    return out


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", one_in: int = 3, power: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; rows whose id's crc32 is divisible by one_in are tampered.

    power: blocks hold ARITY ** power leaves; as many as the number of rows asks for if not given.
    """
    ident = F.col(id_col).cast("long")
    lowered = {c: ascii_lower(F.col(c)) if c == text_col else F.col(c) for c in columns}
    hit = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % one_in == 0, F.lit(False))
    plain = leaf_of(*[F.col(c) for c in columns])
    own = docs.select(ident.alias("doc_id"), F.col(group_col).cast("string").alias("g"), plain.alias("digest"), F.when(hit, leaf_of(*lowered.values())).alias("start"))
    leaves = ranked(own, "g", "doc_id", "digest")
    total = leaves.count()
    if not total:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    power = power or _power(total)
    groups = leaves.filter("i = 0").select("g")  # one row a group
    groups = ranked(groups.withColumn("one", F.lit(0)), "one", "g").select("g", F.col("i").alias("tree"), F.col("n").alias("n_trees"))
    numbered = cut(leaves.join(groups.withColumnRenamed("g", "k"), F.col("g").eqNullSafe(F.col("k"))).select("doc_id", "tree", "i", "n", "digest", F.coalesce("start", "digest").alias("start")), "merkle-leaves")
    roots, above = built(numbered, power)
    roots = cut(roots, "merkle-subroots")
    tops = roots.join(groups.select("tree", "n_trees"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("n_trees").alias("n"), F.col("root").alias("digest"))
    tops_power = _power(tops.first().n) if power >= LEAST_POWER else power
    root, above_root = built(tops, tops_power)
    root = root.first().root
    upper = _subroot_paths(tops, above_root, tops_power)
    whole = cut(above.join(upper, "tree").select("tree", "block", F.concat("path", "upper").alias("path")), "merkle-paths")
    facts = proved(numbered, whole, power).join(roots.withColumnRenamed("root", "subroot"), "tree")
    out = facts.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))
    out = cut(out, "merkle-manifest")
    release(leaves, numbered, roots, whole)
    return out


def _subroot_paths(tops: DataFrame, above: DataFrame, power: int) -> DataFrame:
    """tree, upper: the runs from each subroot up to the root. tops: one tree whose leaves are the subroots."""
    span = ARITY**power

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        index = left.column("i").to_pylist()
        block = _grown(dict(zip(index, left.column("digest").to_pylist(), strict=True)), left.column("n")[0].as_py(), power)
        upper = right.column("path")[0].as_py()
        paths = [[{"at": at, "run": list(level)} for at, level in _path(block, 0, 0, i, power)] + upper for i in index]
        return pa.table([left.column("i"), pa.array(paths, _STEPS)], ["tree", "upper"])

    dealt = tops.select("tree", F.floor(F.col("i") / span).alias("block"), "i", "n", "digest").groupBy("tree", "block")
    return dealt.cogroup(above.groupBy("tree", "block")).applyInArrow(run, f"tree long, upper array<{_STEP}>")
