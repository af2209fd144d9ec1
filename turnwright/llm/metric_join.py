"""Embedding near-dedup: an exact metric range join, then connected components of the links.

On unit vectors cosine >= t is distance <= r = sqrt(2 - 2 * t). Equal vectors are one class first. Pivots, at most PIVOTS and
more than r apart, come from a bounded sample; a vector's home is the cell of its nearest pivot. For two cells one gives and
the other receives. The triangle inequality says which vectors of the giver can have a link there: those whose distance to
the receiver's pivot is at most r beyond the ring its vectors lie in, and, for its nearest pivot p, a vector x must have
d(x, q) <= d(x, p) + 2 * r; for unit vectors the sharper form of that is d(x, q)^2 - d(x, p)^2 <= 2 * r * d(p, q), its distance
to the plane between both pivots. Only those are copied to the receiver, and cells then join on their own.

The triangle inequality also spares comparisons. All vectors within r / 2 of a pivot, the cell's core, are linked with each
other, and a vector whose distance plus the core's radius is at most r is linked with the whole core. Such links are counted
by the core's size, so a group of near copies that holds a third of all rows costs work in proportion to its rows.
All bounds leave a slack of SLACK; every pair that they don't decide is decided by its cosine in double precision, after a
product in single precision that sets aside what is farther than TOLERANCE from t.

Scale: a cell's rows are dealt into blocks of BLOCK rows, and what each block is compared with into slices of SLICE rows, so
a task holds one block and a batch. Tasks return numbers of links and a spanning forest, never pairs. What the driver gets is
the sample, the pivots and some numbers of every cell. Vectors without structure lie near every boundary: then nearly all of
them are copied to half of the cells and work grows with their square, as for any exact join of such vectors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components are returned with no links, a component
of their own and kept; so are rows without an id (their component is null). Vectors of different lengths are never linked;
those of other lengths than the most common one are joined by length, without pivots. Rows that repeat an id or a vector are
vectors of their own and count as links. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .minhash import components

PIVOTS, PIVOT_BYTES, SAMPLE, SEED = 4096, 16 << 20, 8192, 20240611
CELL, BLOCK, SLICE = 4096, 4096, 131_072
SLACK, TOLERANCE = 1e-6, 1e-5
_WIDE = 1 << 20  # entries of a distance matrix held at once
_LINKS = "lead long, n long, other long"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square leaves the range of a double."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def pick_pivots(sample: np.ndarray, most: int, r: float) -> np.ndarray:
    """Vectors of the sample in its order, each farther than r from those before it."""
    x = unit(sample)
    free, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            out.append(i)
            if len(out) == most:
                break
            free &= np.sqrt(np.maximum(0, 2 - 2 * x @ x[i])) > r
    return x[out]


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length in a batch's list column."""
    lists = batch.column(at)
    lengths = lists.value_lengths().to_numpy()
    flat, ends = lists.flatten().to_numpy().astype(np.float64), np.cumsum(lengths)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))


def homes(classes: DataFrame, pivots: np.ndarray, r: float) -> DataFrame:
    """lead, w, v, cell, d, core: the nearest pivot and the distance to it; minus the length for vectors of other lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = np.empty(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for rows, v in _by_length(batch, 2):
                if v.shape[1] != pivots.shape[1]:
                    cell[rows] = -v.shape[1]
                    continue
                for lo in range(0, len(rows), step := max(1, _WIDE // len(pivots))):
                    away = _distances(unit(v[lo : lo + step]), pivots)
                    cell[rows[lo : lo + step]], d[rows[lo : lo + step]] = away.argmin(1), away.min(1)
            core = (cell >= 0) & (d <= r / 2 - SLACK)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d), pa.array(core)], ["lead", "w", "v", "cell", "d", "core"])

    return classes.mapInArrow(run, f"lead long, w long, v {classes.schema['v'].dataType.simpleString()}, cell long, d double, core boolean")


class _Cells:
    """What the driver knows of the cells: arrays by cell, pivots first, then one cell for each other length."""

    def __init__(self, pivots: np.ndarray, r: float, stats: list) -> None:
        self.pivots, self.r = pivots, r
        self.apart = _distances(pivots, pivots)
        lengths = sorted(-s.cell for s in stats if s.cell < 0)
        self.of_length = {n: len(pivots) + i for i, n in enumerate(lengths)}
        n = len(pivots) + len(lengths)
        self.n_core, self.w_core, self.n_rest = (np.zeros(n, np.int64) for _ in range(3))
        self.w_sure, self.lead, self.guests, self.maybe = (np.zeros(n, np.int64) for _ in range(4))
        self.radius, self.near, self.far = np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)
        for s in stats:
            i = s.cell if s.cell >= 0 else self.of_length[-s.cell]
            self.n_core[i], self.w_core[i], self.n_rest[i] = s.n_core, s.w_core or 0, s.n_rest
            self.lead[i] = s.lead if s.lead is not None else -1
            self.radius[i] = s.radius or 0.0
            if s.n_rest:
                self.near[i], self.far[i] = s.near, s.far

    def plan(self, block: int, slice_: int) -> None:
        """Number the tasks: blocks of the rest, then blocks of the core, each by slices of what it is compared with."""
        up = lambda n, size: -(-n // size)
        self.rest_blocks, self.core_blocks = up(self.n_rest, block), up(self.n_core, block) * (self.maybe > 0)
        self.rest_slices, self.core_slices = np.maximum(1, up(self.guests + self.n_rest, slice_)), np.maximum(1, up(self.maybe, slice_))
        n_rest, n_core = self.rest_blocks * self.rest_slices, self.core_blocks * self.core_slices
        first = np.concatenate([[0], np.cumsum(n_rest + n_core)[:-1]])
        self.rest_first, self.core_first = first, first + n_rest

    def zones(self, x: np.ndarray, home: np.ndarray, d: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By row and pivot: which are compared with the rest of the cell, which may link with some of its core, and with all."""
        away, slack, r, n = _distances(x, self.pivots), SLACK, self.r, len(self.pivots)
        q, p = np.arange(n)[None, :], home[:, None]
        gives = (q != p) & (((p + q) % 2 == 0) == (p < q))
        close = gives & (away**2 - (d**2)[:, None] <= 2 * (r + slack) * self.apart[home])
        rest = close & (away <= self.far[:n] + r + slack) & (away >= self.near[:n] - r - slack)
        meets = (gives | ((q == p) & ~core[:, None])) & (self.n_core[:n] > 0)
        sure = meets & (away + self.radius[:n] <= r - slack)
        maybe = meets & ~sure & (away - self.radius[:n] <= r + slack) & (close | (q == p))
        return rest, maybe, sure


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(8)


def _parts(batch: pa.RecordBatch, cells: _Cells) -> Iterator[tuple]:
    """rows, unit vectors, home, d, core of pieces of a batch; vectors are None for those of other lengths."""
    cell, d, core = batch.column("cell").to_numpy(), batch.column("d").to_numpy(), batch.column("core").to_numpy(zero_copy_only=False)
    for rows, v in _by_length(batch, batch.schema.get_field_index("v")):
        if v.shape[1] != cells.pivots.shape[1]:
            yield rows, None, np.full(len(rows), cells.of_length[v.shape[1]]), d[rows], core[rows]
            continue
        for lo in range(0, len(rows), step := max(1, _WIDE // len(cells.pivots))):
            part = rows[lo : lo + step]
            yield part, unit(v[lo : lo + step]), cell[part], d[part], core[part]


def tally(placed: DataFrame, cells: _Cells) -> DataFrame:
    """cell, guests, maybe, w_sure: how many vectors each cell receives, for its rest and its core, and the rows that link with the whole core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(cells.pivots)
        got = np.zeros((3, n), np.int64)
        for batch in batches:
            w = batch.column("w").to_numpy()
            for rows, x, home, d, core in _parts(batch, cells):
                if x is not None:
                    rest, maybe, sure = cells.zones(x, home, d, core)
                    got += np.stack([rest.sum(0), maybe.sum(0), w[rows] @ sure])
        some = np.flatnonzero(got.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(g[some]) for g in got]], ["cell", "guests", "maybe", "w_sure"])

    each = placed.mapInArrow(run, "cell long, guests long, maybe long, w_sure long")
    return each.groupBy("cell").agg(F.sum("guests").alias("guests"), F.sum("maybe").alias("maybe"), F.sum("w_sure").alias("w_sure"))


def core_links(placed: DataFrame, cells: _Cells) -> DataFrame:
    """lead, n, other: links that the triangle inequality grants, by vector; other: one of the linked vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, w = batch.column("lead").to_numpy(), batch.column("w").to_numpy()
            out = []
            for rows, x, home, d, core in _parts(batch, cells):
                if x is not None:
                    in_core = home[core]
                    out.append((lead[rows][core], cells.w_core[in_core] - w[rows][core] + cells.w_sure[in_core], cells.lead[in_core]))
                    i, q = np.nonzero(cells.zones(x, home, d, core)[2])
                    out.append((lead[rows][i], cells.w_core[q], cells.lead[q]))
            columns = [np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3)]
            some = columns[1] > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], ["lead", "n", "other"])

    return placed.mapInArrow(run, _LINKS)


def dealt(placed: DataFrame, cells: _Cells) -> DataFrame:
    """task, role, lead, w, v. role: 0 a row of the block whose rows meet each other too, 1 a row of the block, 2 one compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, out = batch.column("lead").to_numpy(), []

            def spread(rows: np.ndarray, first: np.ndarray, of: np.ndarray, role: np.ndarray | int, out: list = out) -> None:
                """Each row to `of` tasks from `first` on; role 0 holds in the first of them only."""
                step = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
                roles = np.repeat(np.broadcast_to(role, of.shape), of)
                out.append((np.repeat(rows, of), np.repeat(first, of) + step, np.where((roles == 0) & (step > 0), 1, roles)))

            def strided(rows: np.ndarray, first: np.ndarray, blocks: np.ndarray, slices: np.ndarray, out: list = out) -> None:
                """Each row to its slice of `blocks` blocks."""
                step = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                own = _mixed(lead[rows], 2) % slices.astype(np.uint64)
                out.append((np.repeat(rows, blocks), np.repeat(first + own.astype(np.int64), blocks) + step * np.repeat(slices, blocks), np.full(len(step), 2)))

            for rows, x, home, d, core in _parts(batch, cells):
                mix = _mixed(lead[rows], 1)
                blocks, slices = cells.rest_blocks[home], cells.rest_slices[home]
                at = (mix % np.maximum(1, blocks).astype(np.uint64)).astype(np.int64)
                r = ~core
                spread(rows[r], (cells.rest_first[home] + at * slices)[r], slices[r], 0)
                later = blocks - 1 - at
                strided(rows[r], (cells.rest_first[home] + (at + 1) * slices)[r], later[r], slices[r])
                c = core & (cells.core_blocks[home] > 0)
                at = (mix[c] % cells.core_blocks[home[c]].astype(np.uint64)).astype(np.int64)
                spread(rows[c], cells.core_first[home[c]] + at * cells.core_slices[home[c]], cells.core_slices[home[c]], 1)
                if x is not None:
                    rest, maybe, _ = cells.zones(x, home, d, core)
                    i, q = np.nonzero(rest)
                    strided(rows[i], cells.rest_first[q], cells.rest_blocks[q], cells.rest_slices[q])
                    i, q = np.nonzero(maybe)
                    strided(rows[i], cells.core_first[q], cells.core_blocks[q], cells.core_slices[q])
            rows, task, role = (np.concatenate([o[k] for o in out]) for k in range(3))
            for lo in range(0, len(rows), 4096):
                part = pa.array(rows[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(task[lo : lo + 4096]), pa.array(role[lo : lo + 4096].astype(np.int8)), *[batch.column(k).take(part) for k in ("lead", "w", "v")]], ["task", "role", "lead", "w", "v"])

    return placed.mapInArrow(run, f"task long, role tinyint, lead long, w long, v {placed.schema['v'].dataType.simpleString()}")


class _Block:
    """One task's block: links and labels of its rows; a label is the number of a row in the same tree."""

    def __init__(self, threshold: float, inner: bool) -> None:
        self.threshold, self.inner, self.parts, self.ready = threshold, inner, [], False

    def add(self, lead: np.ndarray, w: np.ndarray, x: np.ndarray) -> None:
        self.parts.append((lead, w, x))

    def start(self) -> None:
        self.ready = True
        self.lead, self.w, self.x = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        self.parts = []
        self.single = self.x.astype(np.float32)
        self.n, self.label = np.zeros(len(self.lead), np.int64), np.arange(len(self.lead))
        if self.inner:
            for lo in range(0, len(self.lead), 1024):
                i, j = self._links(self.x[lo : lo + 1024])
                upper = i < j + lo
                i, j = i[upper], j[upper] + lo
                self._count(self.n, i, self.w[j])
                self._count(self.n, j, self.w[i])
                self._unite(i, j, self.label[j])

    def _links(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of block rows and rows of x with cosine at the threshold or more."""
        about = self.single @ x.astype(np.float32).T
        i, j = np.nonzero(about >= self.threshold - TOLERANCE)
        near = np.flatnonzero(about[i, j] < self.threshold + TOLERANCE)
        drop = near[(self.x[i[near]] * x[j[near]]).sum(1) < self.threshold]
        return np.delete(i, drop), np.delete(j, drop)

    @staticmethod
    def _count(n: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
        n += np.bincount(at, weights=w, minlength=len(n)).astype(np.int64)

    def _unite(self, i: np.ndarray, j: np.ndarray, other: np.ndarray) -> None:
        """Join the trees of row i and of label other, pair by pair."""
        pairs = np.unique(np.stack([self.label[i], other], 1), axis=0) if len(i) else np.empty((0, 2), int)
        root: dict[int, int] = {}

        def find(a: int) -> int:
            while (up := root.get(a, a)) != a:
                root[a] = root.get(up, up)
                a = up
            return a

        for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if root:
            to = np.arange(len(self.label))
            for a in list(root):
                to[a] = find(a)
            self.label = to[self.label]

    def meet(self, lead: np.ndarray, w: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.start()
        for lo in range(0, len(lead), 1024):
            i, j = self._links(x[lo : lo + 1024])
            if len(i):
                own = np.zeros(len(x[lo : lo + 1024]), np.int64)
                self._count(self.n, i, w[lo : lo + 1024][j])
                self._count(own, j, self.w[i])
                low = np.full(len(own), len(self.label))
                np.minimum.at(low, j, self.label[i])
                self._unite(i, j, low[j])
                hit = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(lead[lo + hit]), pa.array(own[hit]), pa.array(self.lead[self.label[low[hit]]])], ["lead", "n", "other"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.start()
        hit = np.flatnonzero(self.n)
        yield pa.RecordBatch.from_arrays([pa.array(self.lead[hit]), pa.array(self.n[hit]), pa.array(self.lead[self.label[hit]])], ["lead", "n", "other"])


def compared(tasks: DataFrame, threshold: float) -> DataFrame:
    """lead, n, other of what links within each task. tasks: as dealt() gives them, a task's rows together, its block first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            task, role, lead, w = (batch.column(k).to_numpy() for k in range(4))
            ends = [*(np.flatnonzero((np.diff(task) != 0) | (np.diff(role) != 0)) + 1), batch.num_rows] if batch.num_rows else []
            lo = 0
            for hi in ends:
                if task[lo] != now:
                    if block is not None:
                        yield from block.end()
                    now, block = task[lo], _Block(threshold, role[lo] == 0) if role[lo] < 2 else None
                if block is not None:  # else a block to which no row was dealt
                    part = batch.slice(lo, hi - lo)
                    x = unit(part.column(4).flatten().to_numpy().astype(np.float64).reshape(hi - lo, -1))
                    if role[lo] < 2:
                        block.add(lead[lo:hi], w[lo:hi], x)
                    else:
                        yield from block.meet(lead[lo:hi], w[lo:hi], x)
                lo = hi
        if block is not None:
            yield from block.end()

    return tasks.repartition("task").sortWithinPartitions("task", "role").mapInArrow(run, _LINKS)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = CELL, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row; links are pairs of cosine >= threshold (above -1, below 1)."""
    r = float(np.sqrt(2 - 2 * threshold))
    numbers = F.col("v").cast("array<double>")
    whole = (F.size(numbers) > 0) & F.exists(numbers, lambda x: x != 0) & ~F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).withColumn("fine", F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull())
    kind = every.schema["v"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats take half the bytes
    fine = every.filter("fine").select("vec_id", F.col("v").cast(kind).alias("v"))
    classes = fine.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("lead"), "id", "w", "v"), "vector-classes")
    alone = every.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return alone
    n = lengths["count"]
    share = min(1.0, 2 * SAMPLE / n)
    low = classes.filter(F.size("v") == lengths.d).withColumn("h", F.xxhash64(F.lit(SEED), "id", "lead")).filter(F.shiftrightunsigned("h", 12) <= int(share * (1 << 52)))
    sample = np.array([x.v for x in low.orderBy("h", "lead").limit(SAMPLE).select("v").collect()], np.float64)
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * lengths.d), -(-n // cell)))
    pivots = pick_pivots(sample, most, r)
    placed = cut(homes(classes.select("lead", "w", "v"), pivots, r), "cells")
    if_core = lambda x: F.when(F.col("core"), x)
    if_rest = lambda x: F.when(~F.col("core"), x)
    stats = placed.groupBy("cell").agg(
        F.count(if_core(F.lit(1))).alias("n_core"), F.sum(if_core(F.col("w"))).alias("w_core"), F.min(if_core(F.col("lead"))).alias("lead"), F.max(if_core(F.col("d"))).alias("radius"),
        F.count(if_rest(F.lit(1))).alias("n_rest"), F.min(if_rest(F.col("d"))).alias("near"), F.max(if_rest(F.col("d"))).alias("far"),
    ).collect()
    cells = _Cells(pivots, r, stats)
    for got in tally(placed, cells).collect():
        cells.guests[got.cell], cells.maybe[got.cell], cells.w_sure[got.cell] = got.guests, got.maybe, got.w_sure
    cells.plan(block, slice_)
    links = cut(core_links(placed, cells).unionByName(compared(dealt(placed, cells), threshold)), "vector-links")
    roots = components(links.select(F.col("lead").alias("u"), F.col("other").alias("v")).filter("u != v"))
    counts = links.groupBy("lead").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "lead", "left").join(roots, F.col("lead") == F.col("node"), "left").select("id", "w", "v", "n", F.coalesce("root", "lead").alias("root"))
    names = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = known.join(names, "root").select("v", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    same = fine.join(known, "v").select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept"))
    out = cut(same.unionByName(alone), "vector-duplicates")
    release(classes, placed, links, roots)
    return out
