"""MinHash near-dedup: many universal hash minima with banding, verification on full sets, connected components.

A document's set is its distinct k-word shingles. Each set gets BANDS * ROWS minima under multiply-shift hashes; the
minima of one band are one bucket key. Documents with equal sets (128-bit digest of the sorted shingle hashes) become
one class first; classes that rows of one id share are linked. In LIGHT rounds each class is paired with the smallest and
the most central member (whose buckets hold most) of its largest bucket that still holds several components; pairs are
verified on the shingles of their full texts and their links are contracted by alternating large-star and small-star.

Buckets that still hold several components are then settled. In one of at most SMALL members, pairs across components are
verified if at least AGREE of all minima agree. Larger ones, put together where they have the same central member, are joined
in blocks on full sets: a block's members are indexed by what sets each off from the shingles that most of the block holds, so
the intersection with every other member follows from few shingles, and each pair across components is decided. A block returns
a pair only where it joins two components that no pair of the block joined before, so no bucket's pairs are written out. Members of a
bucket's largest component pass by the blocks of the others and are not compared with each other.

A link between different texts is lost only if the pair shares no bucket, (1 - 0.8 ** ROWS) ** BANDS or 3e-6 at similarity
0.8 with the default parameters, or, in a bucket of at most SMALL members, if too few minima agree, 1e-7 there. A component
loses a document only if all links between them are lost.

Scale: groupings take partial minima before the shuffle; joins are sort-merge joins that AQE splits where a key is hot.
Verification reads a pair's two texts in a task of its own; a block holds BLOCK members or ELEMENTS shingles, and what passes by
it is dealt into slices, so a bucket of any size is spread over tasks. Work there grows with the members outside of the largest
component times all members. State is cut to files in the shared folder, and files that no later step reads are deleted.

Defined cases: words are runs of bytes outside \\x20 and \\x09-\\x0D after lower-casing A-Z; fewer words than k make
one shingle; null, empty and blank texts have the empty set and are linked with nothing; rows that repeat an id are
rows of one document: each is returned, all with the id's component; null ids are linked with nothing and are their
own (null) component, kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, release

BANDS, ROWS, SEED = 32, 5, 20240229
LIGHT, AGREE = 1, 0.625
SMALL, BLOCK, ELEMENTS, SLICE = 128, 4096, 4 << 20, 32 << 20
CHUNK = 4096
_CACHE = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(raw: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and the six white-space bytes."""
    return raw.lower().split() if raw else []


def shingles_of(raw: bytes | None, k: int) -> set[tuple[bytes, ...]]:
    words = words_of(raw)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)], strict=False))


def shingle_hashes(raw: bytes | None, k: int, known: _WordHashes) -> np.ndarray:
    words = words_of(raw)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(len(words) - k + 1, min(1, len(words)))
    width, out = min(k, len(words)), np.full(n, len(words) if len(words) < k else k, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        for i in range(0, len(a), 16):
            out[i : i + 16] = np.minimum(out[i : i + 16], (a[i : i + 16, None] * part + b[i : i + 16, None]).min(1))
    return out >> np.uint64(32)


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, low (a byte of every minimum) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        a = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        known = _WordHashes()
        for batch in batches:
            sizes, keys, bands_of, low = [], [], [], []
            for raw in batch.column(1):
                h = shingle_hashes(raw.as_py(), k, known)
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                if len(h):
                    least = minima(h, a, b)
                    band = np.arange(bands, dtype=np.uint64)
                    for column in least.reshape(bands, rows).T:
                        band = band * np.uint64(0x9E3779B97F4A7C15) + column
                        band ^= band >> np.uint64(31)
                    bands_of.append(band.astype(np.int64))
                    low.append(least.astype(np.uint8).view(np.int8))
            has = np.array(sizes, np.int64) > 0
            lists = lambda parts, width, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * width)]), pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists(bands_of, bands, pa.int64()), lists(low, bands * rows, pa.int8())], ["doc_id", "n_shingles", "set_key", "bands", "low"]
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, low array<tinyint>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets meet 100 * both >= percent * either."""
    one = pairs.join(texts.withColumnsRenamed({"doc_id": "u", "raw": "ru"}), "u")
    two = one.join(texts.withColumnsRenamed({"doc_id": "v", "raw": "rv"}), "v").select("u", "v", "ru", "rv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, set] = {}
        for batch in batches:
            keep = []
            for i, (v, ru, rv) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if v not in last:  # rows come in order of v, which is often the same
                    last = {v: shingles_of(rv.as_py(), k)}
                x, y = shingles_of(ru.as_py(), k), last[v]
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["u", "v"])

    return two.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest id that edges (u, v) reach, for every node of an edge; in a file."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "stars")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = cut(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        near = large.join(low, F.col("u") == F.col("c"))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        small = cut(small, "small-star")
        release(now, large)
        now = small
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = cut(stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    release(now)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u of edges (u, v) has one v, and no v is a u: alternating stars change nothing then."""
    ends = edges.select(F.col("u").alias("x")).unionByName(edges.select(F.col("v").alias("x")).distinct())
    return ends.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """shared (key, rep, ...) with root: buckets whose members are of more than one component; in a file."""
    placed = shared.join(roots, F.col("rep") == F.col("node"), "left").select(*shared.columns, F.coalesce("root", "rep").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    return cut(placed.join(split, "key", "left_semi"), "open-buckets")


def _hub_pairs(open_: DataFrame) -> DataFrame:
    """u, v: members with the smallest and the most central member of their largest bucket, where these are of other components."""
    pick = F.struct("rep", "root")
    hubs = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(F.min_by(pick, "rep"), F.max_by(pick, F.struct("central", -F.col("rep")))).alias("hubs"))
    pairs = open_.join(hubs, "key").select("rep", "root", "n", F.posexplode("hubs").alias("kind", "hub")).filter("hub.root != root")
    return _ordered(pairs.groupBy("rep", "kind").agg(F.max_by("hub.rep", F.struct("n", -F.col("hub.rep"))).alias("hub")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v")).filter("u != v").distinct()


def _hashed(texts: DataFrame, k: int) -> DataFrame:
    """rep, hs: the sorted hashes of a text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            sets = [shingle_hashes(raw.as_py(), k, known).view(np.int64) for raw in batch.column(1)]
            ends = np.cumsum([0] + [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else [], pa.int64()))], ["rep", "hs"])

    return texts.select("rep", "raw").mapInArrow(run, "rep long, hs array<long>")


class _Block:
    """A block's members, indexed by what sets each off from the shingles that most of them hold."""

    def __init__(self, percent: int) -> None:
        self.percent, self.reps, self.roots, self.sets = percent, [], [], []
        self.up: dict[int, int] = {}
        self.owner: np.ndarray | None = None

    def find(self, root: int) -> int:
        while (up := self.up.get(root, root)) != root:
            self.up[root] = self.up.get(up, up)
            root = up
        return root

    def index(self) -> None:
        held, n = np.unique(np.concatenate(self.sets), return_counts=True)
        self.core = held[2 * n > len(self.sets)]
        off = [np.setxor1d(x, self.core, True) for x in self.sets]
        self.size, self.off = np.array([len(x) for x in self.sets]), np.array([len(x) for x in off])
        element = np.concatenate(off)
        order = np.argsort(element, kind="stable")
        self.element, self.owner = element[order], np.repeat(np.arange(len(off)), self.off)[order]
        self.roots = np.array(self.roots)

    def links(self, other: np.ndarray) -> np.ndarray:
        """Numbers of the members whose sets meet the threshold with this one."""
        apart = np.setxor1d(other, self.core, True)
        lo = np.searchsorted(self.element, apart, "left")
        n = np.searchsorted(self.element, apart, "right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.off))
        meet = (self.size + len(other) - (self.off + len(apart) - 2 * both)) // 2
        return np.flatnonzero((meet > 0) & (100 * meet >= self.percent * (self.size + len(other) - meet)))

    def joined(self, rep: int, root: int, other: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of this one with members, one for each component that it joins to its own."""
        if self.owner is None:
            self.index()
        hits = self.links(other)
        _, first = np.unique(self.roots[hits], return_index=True)
        for i in hits[first].tolist():
            mine, its = self.find(root), self.find(int(self.roots[i]))
            if mine != its:
                self.up[max(mine, its)] = min(mine, its)
                yield rep, self.reps[i]

    def inner(self) -> Iterator[tuple[int, int]]:
        for rep, root, own in zip(list(self.reps), list(self.roots), self.sets, strict=True):
            yield from self.joined(rep, int(root), own)


def blocked(members: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, percent: int, block: int = BLOCK, elements: int = ELEMENTS, slice_: int = SLICE) -> DataFrame:
    """u, v: pairs of a group's members at the threshold that join all components which its pairs at the threshold join.

    members: group, rep, root. sizes: rep, size. The largest component of a group is of no block.
    """
    sized = members.join(sizes, "rep")
    by_root = sized.groupBy("group", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("e"))
    stats = by_root.groupBy("group").agg(F.max(F.struct("m", "root", "e")).alias("most"), F.sum("m").alias("m"), F.sum("e").alias("e"))
    up = lambda x, size: F.ceil(x / F.lit(size)).cast("int")
    stats = stats.select("group", F.col("most.root").alias("largest"), F.greatest(F.lit(1), up(F.col("m") - F.col("most.m"), block), up(F.col("e") - F.col("most.e"), elements)).alias("nb"), F.greatest(F.lit(1), up(F.col("e"), slice_)).alias("ns"))
    placed = sized.join(stats, "group").withColumn("own", F.when(F.col("root") != F.col("largest"), F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")))
    spot = lambda b, s, role: F.struct(b.alias("block"), s.alias("slice"), role.cast("tinyint").alias("role"))
    none = F.array().cast("array<struct<block:int,slice:int,role:tinyint>>")
    at_home = F.when(F.col("own").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda s: spot(F.col("own"), s, F.when(s == 0, 0).otherwise(1)))).otherwise(none)
    after = F.coalesce(F.col("own") + 1, F.lit(0))
    passing = F.when(after < F.col("nb"), F.transform(F.sequence(after, F.col("nb") - 1), lambda b: spot(b, F.pmod(F.xxhash64("rep", F.lit(1)), F.col("ns")).cast("int"), F.lit(2)))).otherwise(none)
    spots = placed.select("group", "rep", "root", F.explode(F.concat(at_home, passing)).alias("spot")).select("group", "spot.*", "rep", "root")
    sets = cut(_hashed(texts.withColumnRenamed("doc_id", "rep").join(members.select("rep").distinct(), "rep", "left_semi"), k), "group-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, here, inner = None, None, False
        for batch in batches:
            u: list[tuple[int, int]] = []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True))
            role, rep, root = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i, hs in enumerate(batch.column(6)):
                if keys[i] != now:
                    if inner:
                        u += here.inner()
                    now, here, inner = keys[i], _Block(percent), False
                own = hs.values.to_numpy()
                if role[i] < 2:
                    here.reps.append(rep[i])
                    here.roots.append(root[i])
                    here.sets.append(own)
                    inner |= role[i] == 0
                elif here.reps:
                    if inner:
                        u += here.inner()
                        inner = False
                    u += here.joined(rep[i], root[i], own)
            yield _pairs(u)
        if inner:
            yield _pairs(list(here.inner()))

    dealt = spots.join(sets, "rep").select("group", "block", "slice", "role", "rep", "root", "hs")
    found = dealt.repartition("group", "block", "slice").sortWithinPartitions("group", "block", "slice", "role").mapInArrow(run, "u long, v long")
    out = cut(found.distinct(), "block-pairs")
    release(sets)
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], ["u", "v"])


def _across(small: DataFrame, reps: DataFrame, percent: int, minima_: int) -> DataFrame:
    """u, v: pairs of a bucket's members of different components whose minima and sizes allow a link. small: key, rep, root."""
    sides = small.join(reps.select("rep", "low", "size"), "rep").select("key", "root", F.col("rep").alias("r"), "low", "size")
    left, right = (sides.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "r", "low", "size")]) for x in ("u", "v"))
    agree = F.aggregate(F.zip_with("low_u", "low_v", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    sizes = F.expr(f"100 * least(size_u, size_v) >= {percent} * greatest(size_u, size_v)")
    meet = left.join(right, "key").filter("root_u != root_v and r_u > r_v").filter(sizes & (agree >= int(AGREE * minima_)))
    return meet.select(F.col("r_u").alias("u"), F.col("r_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = cut(sketches(own, k, bands, rows), "sketches")
    classes = sketch.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "low", "n_shingles")).alias("m"))
    reps = cut(classes.select("set_key", F.col("m.doc_id").alias("rep"), "m.bands", "m.low", F.col("m.n_shingles").alias("size")), "set-classes")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    stars = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = cut(buckets.join(stars, "key").select("key", "rep", "n"), "buckets")
    meeting = first.select(F.col("rep").alias("doc_id")).distinct()
    texts = cut(own.filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("raw")).join(meeting, "doc_id", "left_semi"), "meeting-texts")
    central = first.groupBy("rep").agg(F.sum("n").alias("central")).withColumnRenamed("rep", "c")
    shared = cut(first.join(central, F.col("rep") == F.col("c")).select("key", "rep", "central"), "central-buckets")
    repeated = sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    again = cut(sketch.join(repeated, "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(reps.select("set_key", "rep"), "set_key", "left").select("doc_id", "rep"), "repeated-ids")
    links = cut(again.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("v"), F.collect_set("rep").alias("us")).select(F.explode("us").alias("u"), "v").filter("u != v").distinct(), "links")
    roots = components(links)
    open_, tried = _open(shared, roots), None

    def linked(pairs: DataFrame) -> None:
        nonlocal links, roots, tried
        pairs = cut(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        both = cut(links.unionByName(verified(pairs, texts, k, percent)), "links")
        seen = pairs if tried is None else cut(tried.unionByName(pairs), "tried")
        release(links, roots, *([tried, pairs] if tried is not None else []))
        links, tried, roots = both, seen, components(both)

    for _ in range(LIGHT):
        if open_.isEmpty():
            break
        linked(_hub_pairs(open_))
        before, open_ = open_, _open(shared, roots)
        release(before)
    left_over = []
    if not open_.isEmpty():
        sized = open_.join(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("rep", F.struct("central", -F.col("rep"))).alias("group")), "key")
        pairs = _across(sized.filter(F.col("n") <= small), reps, percent, bands * rows)
        large = cut(sized.filter(F.col("n") > small).select("group", "rep", "root").distinct(), "large-buckets")
        left_over = [large]
        if not large.isEmpty():  # buckets of one passage or family share their most central member
            met = blocked(large, reps.select("rep", "size"), texts, k, percent, block)
            left_over.append(met)
            pairs = pairs.unionByName(met).distinct()
        linked(pairs)
    by_rep = reps.select("set_key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    placed_rows = sketch.select("doc_id", "n_shingles", "set_key").join(by_rep, "set_key", "left")
    if not again.isEmpty():  # rows without shingles of an id that has some elsewhere, too
        of_id = again.join(roots, F.col("rep") == F.col("node"), "left").groupBy(F.col("doc_id").alias("i")).agg(F.min(F.coalesce("root", "rep")).alias("of_id"))
        placed_rows = placed_rows.join(of_id, F.col("doc_id") == F.col("i"), "left").withColumn("component", F.coalesce("component", "of_id"))
    component = F.coalesce("component", "doc_id")
    out = placed_rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))
    out = cut(out, "near-duplicates")
    release(sketch, reps, first, texts, shared, again, links, roots, open_, *left_over, *([tried] if tried is not None else []))
    return out


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each component, the smallest id, with all their columns."""
    (other,) = fresh(docs, "other_id")
    gone = near_duplicates(docs, k, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(other), "left_anti")  # a null id is never among them
