"""Mixing sources to target weights by iterative proportional fitting (DataFrame operations only).

Tokens (words) are counted in cells of source, language and topic. Raking multiplies the cells of one dimension at a
time by target / current until every marginal fits, where no cell counts for more than it holds: its weight times the
fraction drawn is at most its share of the corpus. Documents are sampled with the probability weight * fraction / share,
so the expected drawn tokens meet the targets, and a document is drawn if a hash of its id and the seed falls below it.
The fraction is the asked one, or the largest at which each value by itself holds enough tokens for its target, if that
is less. Raking ends when every marginal is within TOLERANCE of its goal. Where values have enough tokens but their cells
don't, that may never be; then it ends when a round changes no marginal by TOLERANCE, or after ROUNDS rounds, and a warning
names how far off the marginals are.

Targets: per dimension a mapping of value to weight, or a number a: the weights are then the corpus shares to the
power a, so that a < 1 lifts rare values and damps a source that holds a third of all rows. Values that a mapping doesn't
list, such as `unknown`, keep their share of the corpus; the listed ones share the rest by their weights.

Scale: documents are reduced to cells by one grouped sum with map-side partial sums; raking works on cells only. Up to
MAX_BROADCAST cells are one row of arrays, on which higher-order functions run all rounds in one task of one job; with more,
each marginal is a grouped sum, cut to files after every round. The probabilities return to the documents by a broadcast
if the cell count is under MAX_BROADCAST, else by a join that AQE can split. Only scalars reach the driver.

Defined cases: null source or language is the value `unknown`; null or wordless text counts one token, so that its
document can be drawn; a null id hashes like the text `null`; repeated rows are drawn together; if all targets of a
dimension miss the corpus, that dimension is left as it is; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

TARGETS: dict[str, dict[str, float] | float] = {"source": 0.7, "lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}, "topic": 0.8}
FRACTION, SEED, ROUNDS, TOLERANCE, MAX_BROADCAST = 0.6, 17, 2000, 1e-4, 10_000
DIMS = ("source", "lang", "topic")
#: The first topic whose pattern is found is a text's topic; `general` if none is.
TOPICS = (("legal", "(?i)licen[sc]e|copyright|rights reserved"), ("contact", "[\\w.+-]@[\\w-]+\\.\\w|\\d[\\d ()-]{8,}\\d"), ("web", "(?i)https?://|www\\."), ("table", "\\|[^\\n|]*\\|"))


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def with_cells(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """docs with __source, __lang, __topic and __tokens; the topic is the column named so, or else the first pattern found."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    of_topic = known(topic) if topic else topic_of(F.coalesce("text", F.lit("")))
    return docs.withColumns({"__source": known("source"), "__lang": known("lang"), "__topic": of_topic, "__tokens": token_count(F.col("text"))})


def _targets(cells: DataFrame, dim: str, target: dict[str, float] | float) -> DataFrame:
    """value, goal, share: asked and own shares of one dimension's values, each summing to 1; no rows if no target is found."""
    found = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("t"))
    if isinstance(target, dict):
        pairs = F.create_map(*[x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))])
        found = found.withColumn("w", F.try_element_at(pairs, F.col("value")))
    else:
        found = found.withColumn("w", F.pow("t", F.lit(float(target))))
    weights, listed, every = found.agg(F.sum("w"), F.sum(F.when(F.col("w").isNotNull(), F.col("t"))), F.sum("t")).first()
    share = F.col("t") / F.lit(float(every or 1))
    goal = F.coalesce(F.col("w") / F.lit(weights or 1.0) * F.lit((listed or 0) / (every or 1)), share)
    return found.filter(F.lit((weights or 0.0) > 0)).select("value", goal.alias("goal"), share.alias("share"))


def _step(have: Column, fixed: Column, free: Column, goal: Column) -> Column:
    """What cells of a value are multiplied by: a step for the cells below their most; where that is none or too much is held already, one for all."""
    step = F.when((free > 0) & (goal > fixed), (goal - fixed) / free)
    return step.when((have > 0) & ((free > 0) | (goal < have)), goal / have).when(have > 0, 1.0).otherwise(0.0)


def _off(have: Column, goal: Column) -> Column:
    return F.when(goal > 0, F.abs(have / goal - 1))


def _by_value(one: DataFrame, dim: str, places: Column) -> DataFrame:
    """one with the values of a dimension, where each cell's value is among them, which cells are of each, and their goals."""
    one = one.withColumn(f"v_{dim}", F.array_sort(F.array_distinct(F.transform("cs", lambda c: c[dim]))))
    one = one.withColumn(f"at_{dim}", F.transform("cs", lambda c: (F.array_position(F.col(f"v_{dim}"), c[dim]) - 1).cast("int")))
    one = one.withColumn(f"in_{dim}", F.transform(f"v_{dim}", lambda v: F.filter(places, lambda i: F.get("cs", i)[dim] == v)))
    return one.withColumn(f"goal_{dim}", F.transform(f"in_{dim}", lambda m: F.get("cs", F.get(m, 0))[f"__goal_{dim}"]))


def _raked_in_one(cells: DataFrame, goals: dict[str, DataFrame], total: float, fraction: float | None, rounds: int, tolerance: float) -> tuple[DataFrame, list[float]]:
    """cells with weight, and how far off each marginal is. All rounds are one expression over one row."""
    for dim, goal in goals.items():
        cells = cells.join(F.broadcast(goal.select(F.col("value").alias(dim), F.col("goal").alias(f"__goal_{dim}"))), dim)
    one = cells.groupBy().agg(F.array_sort(F.collect_list(F.struct(*DIMS, "tokens", *[f"__goal_{dim}" for dim in goals]))).alias("cs"))
    one = one.withColumn("share", F.transform("cs", lambda c: c["tokens"] / F.lit(float(total))))
    places = F.sequence(F.lit(0), F.size("cs") - 1)
    for dim in goals:
        one = _by_value(one, dim, places)
    one = one.withColumn("cells", F.transform("cs", lambda c: F.struct(*[c[d].alias(d) for d in (*DIMS, "tokens")])))
    one = cut(one.drop("cs", *[f"v_{dim}" for dim in goals]), "raking")
    most = lambda i: F.lit(float("inf")) if fraction is None else F.get("share", i) / F.lit(fraction)
    let = lambda x, body: F.get(F.transform(F.array(x), body), 0)

    def sums(w: Column, members: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("have"), F.lit(0.0).alias("fixed"), F.lit(0.0).alias("free"))

        def add(acc: Column, i: Column) -> Column:
            x = F.get(w, i)
            full = x >= most(i)
            return F.struct((acc["have"] + F.least(x, most(i))).alias("have"), (acc["fixed"] + F.when(full, most(i)).otherwise(0.0)).alias("fixed"), (acc["free"] + F.when(full, 0.0).otherwise(x)).alias("free"))

        return F.aggregate(members, zero, add)

    def one_dim(state: Column, dim: str) -> Column:
        def by_value(s: Column) -> Column:
            found = F.zip_with(F.transform(f"in_{dim}", lambda m: sums(s["w"], m)), F.col(f"goal_{dim}"), lambda h, g: F.struct(_step(h["have"], h["fixed"], h["free"], g).alias("f"), _off(h["have"], g).alias("off")))
            return let(found, lambda t: F.struct(
                F.transform(s["w"], lambda x, i: x * F.get(t, F.get(F.col(f"at_{dim}"), i))["f"]).alias("w"),
                F.concat(s["off"], F.array(F.coalesce(F.array_max(F.transform(t, lambda y: y["off"])), F.lit(0.0)))).alias("off"),
            ))

        return let(state, by_value)

    def one_round(acc: Column, _: Column) -> Column:
        state = F.struct(acc["w"].alias("w"), F.array().cast("array<double>").alias("off"))
        for dim in goals:
            state = one_dim(state, dim)
        still = lambda s: (F.size(acc["off"]) > 0) & (F.array_max(F.zip_with(s["off"], acc["off"], lambda x, y: F.abs(x - y))) < tolerance / 100)
        ended = lambda s: F.struct(s["w"].alias("w"), s["off"].alias("off"), (F.coalesce(F.array_max(s["off"]) < tolerance, F.lit(False)) | F.coalesce(still(s), F.lit(False))).alias("done"))
        return F.when(acc["done"], acc).otherwise(let(state, ended))

    begin = F.struct(F.col("share").alias("w"), F.array().cast("array<double>").alias("off"), F.lit(False).alias("done"))
    fit = cut(one.select("cells", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, one_round).alias("fit")), "raked")
    release(one)
    off = fit.select("fit.off").first()[0]
    return fit.select(F.explode(F.arrays_zip("cells", F.col("fit.w").alias("w"))).alias("x")).select("x.cells.*", F.col("x.w").alias("weight")), off


def rake(cells: DataFrame, targets: dict, rounds: int = ROUNDS, tolerance: float = TOLERANCE, fraction: float | None = None, most_cells: int = MAX_BROADCAST) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: raked shares. With a fraction also p, the part of each cell that is drawn: at most 1."""
    goals = {dim: cut(_targets(cells, dim, targets[dim]), f"goal-{dim}") for dim in DIMS if dim in targets}
    goals = {dim: goal for dim, goal in goals.items() if not goal.isEmpty()}
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(float(total))
    if fraction is not None:
        fraction = min([fraction, *[goal.filter("goal > 0").agg(F.min(F.col("share") / F.col("goal"))).first()[0] for goal in goals.values()]])
    most = F.lit(float("inf")) if fraction is None else share / F.lit(fraction)
    held, full = F.least("weight", most), F.col("weight") >= most
    now, off = cells.select(*DIMS, "tokens", share.alias("weight")), [0.0]
    if goals and cells.count() <= most_cells:
        now, off = _raked_in_one(cells, goals, total, fraction, rounds, tolerance)
    elif goals:
        last, before = None, None
        for _ in range(rounds):
            for dim, goal in goals.items():
                have = now.groupBy(F.col(dim).alias("value")).agg(F.sum(held).alias("have"), F.sum(F.when(full, most).otherwise(0.0)).alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"))
                factor = have.join(goal, "value").select(F.col("value").alias(dim), _step(F.col("have"), F.col("fixed"), F.col("free"), F.col("goal")).alias("__f"), _off(F.col("have"), F.col("goal")).alias(f"__off_{dim}"))
                now = now.join(factor, dim).withColumn("weight", F.col("weight") * F.col("__f")).drop("__f")
            now = cut(now, "raked")
            off = [x or 0.0 for x in now.agg(*[F.max(f"__off_{dim}").alias(dim) for dim in goals]).first()]
            if last is not None:
                release(last)
            last, now = now, now.select(*DIMS, "tokens", "weight")
            if max(off) < tolerance or before is not None and max(abs(x - y) for x, y in zip(off, before, strict=True)) < tolerance / 100:
                break
            before = off
    if goals and max(off) >= tolerance:
        warnings.warn(f"marginals are off by up to {dict(zip(goals, off, strict=True))} of their goals", stacklevel=2)
    now = now.withColumn("weight", held)
    return now if fraction is None else now.withColumn("p", F.least(F.lit(1.0), F.col("weight") * F.lit(fraction) / share))


def uniform(id_col: Column, seed: int) -> Column:
    """In [0, 1), from 52 bits of a hash of id and seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))), 12) / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict = TARGETS, fraction: float = FRACTION, seed: int = SEED, id_col: str = "doc_id", topic: str | None = None) -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __p (probability) and __drawn."""
    marked = with_cells(docs, topic)
    cells = cut(marked.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMS]).agg(F.sum("__tokens").alias("tokens")), "cells")
    p = cut(rake(cells, targets, fraction=fraction), "cell-p")
    release(cells)
    side = p.select(*[F.col(d).alias(f"__{d}") for d in DIMS], F.col("p").alias("__p"))
    if p.count() <= MAX_BROADCAST:
        side = F.broadcast(side)
    return marked.join(side, [f"__{d}" for d in DIMS]).withColumn("__drawn", uniform(F.col(id_col), seed) < F.col("__p"))


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The drawn rows of docs, with their columns."""
    names = [c.lower() for c in docs.columns]
    plain = docs.toDF(*[c if c.lower() in ("doc_id", "text", "source", "lang", how.get("topic"), how.get("id_col")) else f"c{i}" for i, c in enumerate(docs.columns)])  # no other name of the user's meets one of ours
    if len(set(names)) < len(names):
        raise ValueError("columns that differ only in case")
    return mix(plain, **how).filter("__drawn").select(*plain.columns).toDF(*docs.columns)
