"""SentencePiece encoding and decoding as a relational lattice, folded by Viterbi.

A text becomes `\\u2581` + text with spaces escaped, is cut into chunks that no piece reaches across, and every distinct
chunk is encoded once: its substrings of bounded length are exploded and equi-joined to the piece table, the edges found
are grouped by chunk, and a Spark higher-order aggregate folds them into the path of the largest sum of piece scores.
These are the ids that the library gives for the same pieces and scores as a unigram model; ties go to the longer last piece.

The public vocabulary here was trained as BPE, whose own ids follow merge order and not a sum of scores: for some chunks
they are others. fold="merges" reads the same lattice in order of rank, each edge taken if it joins exactly two of the
tokens so far, and gives those ids; it costs the square of a chunk's length, so it is not the main path.

Chunks of over SHORT characters are cut into blocks of BLOCK positions: edges are exploded and grouped by block, the fold
carries only the last `longest` states from block to block and lays each block's back pointers aside, and the path is read
back block by block, so time is linear in the chunk's length.

Documents are packed some PACK chunks at a time: a pack lists its distinct chunks and holds its documents as numbers of
places in that list. Chunks that many packs list (at most HOT of at most HOT_LENGTH characters; a bound that holds at any
size) travel to the packs as a table with their ids. The others are shuffled, as (pack, place, chunk), to meet the encoded
chunks, and their ids return to the packs.

Decoding joins piece texts back, ids of bytes to their bytes; decoded text equals the text wherever the tokenizer itself
keeps it (`\\u2581` in a text comes back as a space, and ill-formed bytes as U+FFFD).

Defined cases: null and empty texts have no ids; rows that repeat an id are each encoded; null ids are kept; texts and
chunks of any length are taken whole; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release

SHORT, BLOCK = 62, 128
HOT, HOT_LENGTH, PACK = 200_000, 32, 1 << 18
TASK_WORDS = 40_000  # a word has some twenty edges
SPACE = "▁"
BYTE = re.compile("<0x([0-9A-F]{2})>")
PACKS = "doc_ids array<long>, hs array<long>, sizes array<int>, codes binary, words array<string>"
_WAY = "struct<best:double,s:int,id:int>"


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, int, float], ...]  # text, id, score of normal pieces
    bytes_at: int  # id of byte 0
    size: int
    longest: int
    kind: str  # bpe or unigram
    texts: tuple[bytes, ...]  # of every id, for decoding


def read_model(path: str, kind: str = "bpe") -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    all_ids = range(sp.get_piece_size())
    normal = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in all_ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    texts = tuple(bytes([int(m[1], 16)]) if sp.is_byte(i) and (m := BYTE.fullmatch(sp.id_to_piece(i))) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in all_ids)
    return model_of(normal, min(i for i in all_ids if sp.is_byte(i)), len(all_ids), kind, texts)


def model_of(pieces: list[tuple[str, int, float]], bytes_at: int, size: int, kind: str, texts: tuple[bytes, ...]) -> Model:
    return Model(tuple(pieces), bytes_at, size, max(len(p) for p, _, _ in pieces), kind, texts)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """piece, id, score, rank: rank 1 for the best score, the same for equal scores."""
    place = {s: i for i, s in enumerate(sorted({-s for _, _, s in model.pieces}), 1)}
    return spark.createDataFrame(pa.table({"piece": [p for p, _, _ in model.pieces], "id": pa.array([i for _, i, _ in model.pieces], pa.int32()), "score": [s for _, _, s in model.pieces], "rank": pa.array([place[-s] for _, _, s in model.pieces], pa.int32())}))


@lru_cache
def ranges(*kinds: str) -> str:
    """Ranges of all characters of these general categories, for use between brackets in a pattern."""
    held = [unicodedata.category(chr(i)).startswith(kinds) for i in range(0x110000)]
    ends = [i for i in range(0x110000) if held[i] != (i > 0 and held[i - 1])]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(ends[::2], ends[1::2], strict=True))


def chunk_finder(model: Model) -> Callable[[str], list[str]]:
    """A function from an escaped text to the chunks that make it up; no piece of the model reaches over a cut.

    Cuts are before spaces and, if no piece holds a letter beside another character but for a space before it, there, too.
    Combining marks count as letters; texts without any, and without numerals like a raised two, take a shorter pattern.
    """
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in model.pieces):
        raise ValueError("pieces with a space behind other characters have no cut at spaces")

    def rule(letter: str, other: str) -> tuple[Callable, Callable]:
        return re.compile(f"{letter}{other}|{other}{letter}").search, re.compile(f"{SPACE}*+(?:{letter}++|{other}++)|{SPACE}++").findall

    odd = frozenset(chr(i) for i in range(0x110000) if unicodedata.category(chr(i)).startswith(("M", "Nl", "No")))
    beyond = re.compile(f"[^\\x00-\\xb1\\xba\\xbb\\xbf-\\u02ff{SPACE}]").search  # most texts hold nothing else, and nothing odd is among these
    rare = lambda text: bool(beyond(text)) and not odd.isdisjoint(text)
    mixed, exactly = rule(f"[{ranges('L', 'M')}]", f"[^{ranges('L', 'M')}{SPACE}]")
    plain_mixed, shortly = rule("[^\\W\\d_]", f"(?:(?![^\\W\\d_])[^{SPACE}])")
    if any(mixed(p) or (plain_mixed(p) and not rare(p)) for p, _, _ in model.pieces):
        return re.compile(f"{SPACE}*+[^{SPACE}]++|{SPACE}++").findall
    return lambda text: exactly(text) if rare(text) else shortly(text)


def lattice(words: DataFrame, pieces: DataFrame, model: Model, keys: list[str], starts: Column, most: Column) -> DataFrame:
    """keys, s, e, id, rank, score of every edge; e is at most `most`. words: keys, word and what starts and most need.

    A character without a piece is an edge of id -1 - code point, with the library's score for unknown characters.
    """
    subs = words.withColumn("__most", most).withColumn("s", F.explode(starts))
    subs = subs.withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("__most"), F.col("s") + model.longest))))
    found = subs.select(*keys, "s", "e", F.expr("substring(word, s + 1, e - s)").alias("piece")).join(F.broadcast(pieces), "piece", "left")  # the piece table has a fixed size
    unknown = min(score for _, _, score in model.pieces) - 10.0
    return found.filter("id is not null or e = s + 1").select(*keys, "s", "e", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("score", F.lit(unknown)).alias("score"))


def whole_lattice(words: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """words: wid, word, n."""
    return lattice(words, pieces, model, ["wid", "word", "n"], F.sequence(F.lit(0), F.length("word") - 1), F.length("word"))


def spelled_out(ids: Column, model: Model) -> Column:
    """ids, those of unknown characters replaced by the ids of their UTF-8 bytes."""

    def utf8(x: Column) -> Column:
        point = -1 - x
        byte = lambda mark, shift: (F.shiftright(point, shift).bitwiseAND(63 if shift or mark == 0x80 else 127) + mark + model.bytes_at).cast("int")
        lead = lambda mark, shift: (F.shiftright(point, shift) + mark + model.bytes_at).cast("int")
        two, three = F.array(lead(0xC0, 6), byte(0x80, 0)), F.array(lead(0xE0, 12), byte(0x80, 6), byte(0x80, 0))
        return F.when(point < 0x80, F.array(lead(0, 0))).when(point < 0x800, two).when(point < 0x10000, three).otherwise(F.array(lead(0xF0, 18), byte(0x80, 12), byte(0x80, 6), byte(0x80, 0)))

    bytes_too = F.flatten(F.transform(ids, lambda x: F.when(x >= 0, F.array(x)).otherwise(utf8(x))))
    return F.when(F.exists(ids, lambda x: x < 0), bytes_too).otherwise(ids)


def _way(best: float) -> Column:
    """A way with nothing before it; fields can be null as far as Spark knows, like those that the fold makes."""
    return F.from_json(F.lit('{"best": %s, "s": -1, "id": 0}' % ("-1e300" if best else "0.0")), _WAY)


def _best_ways(edges: Column, start: Column, base: Column) -> Column:
    """start with one way more for every further position: the best edge that ends there. Element p - base is of position p."""

    def step(ways: Column, x: Column) -> Column:
        best, at = F.get(ways, x["s"] - base)["best"] + x["score"], x["e"] - base
        new = F.struct(best.alias("best"), x["s"].alias("s"), x["id"].alias("id"))
        return F.when(F.size(ways) == at, F.array_append(ways, new)).when(F.get(ways, at)["best"] < best, F.array_append(F.slice(ways, 1, at), new)).otherwise(ways)

    return F.aggregate(edges, start, step)


def _walked(ways: Column, places: Column, stop: Column, base: Column) -> Column:
    """struct(e, ids): the way back from position stop over `places`, which come in falling order."""
    begin = F.struct(stop.alias("e"), F.array().cast("array<int>").alias("ids"))

    def back(acc: Column, p: Column) -> Column:
        way = F.get(ways, p - base)
        return F.when(p == acc["e"], F.struct(way["s"].alias("e"), F.array_prepend(acc["ids"], way["id"]).alias("ids"))).otherwise(acc)

    return F.aggregate(places, begin, back)



def viterbi_short(words: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """word, n, ids of chunks of at most SHORT characters, in one fold each."""
    edges = whole_lattice(words, pieces, model)
    grouped = edges.groupBy("wid").agg(F.first("word").alias("word"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("e", "s", "id", "score"))).alias("xs"))
    start = F.array(_way(0.0))
    out = grouped.select("word", "n", _best_ways(F.col("xs"), start, F.lit(0)).alias("ways"))
    path = _walked(F.col("ways"), F.sequence(F.size("ways") - 1, F.lit(1), F.lit(-1)), F.size("ways") - 1, F.lit(0))
    return out.select("word", "n", spelled_out(path["ids"], model).alias("ids"))


def viterbi_long(words: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """word, n, ids of chunks of any length, block by block."""
    reach = model.longest
    n = F.length("word")
    blocks = words.select("wid", n.alias("len"), "word", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).alias("b"))
    lo = F.col("b") * BLOCK  # the block's edges end at positions lo + 1 to lo + BLOCK, and start at `first` or behind it
    first = F.greatest(F.lit(0), lo + 1 - reach)
    windows = blocks.select("wid", "b", "len", first.alias("first"), F.substring("word", first + 1, F.least(F.col("len"), lo + BLOCK) - first).alias("word"))
    edges = lattice(windows, pieces, model, ["wid", "b", "len", "first"], F.sequence(F.lit(0), F.length("word") - 1), F.length("word"))
    edges = edges.withColumns({"s": F.col("s") + F.col("first"), "e": F.col("e") + F.col("first")}).filter(F.col("e") > lo)
    by_block = edges.groupBy("wid", "b").agg(F.first("len").alias("len"), F.sort_array(F.collect_list(F.struct("e", "s", "id", "score"))).alias("xs"))
    grouped = by_block.groupBy("wid").agg(F.first("len").alias("len"), F.sort_array(F.collect_list(F.struct("b", "xs"))).alias("blocks"))
    begin = F.concat(F.array_repeat(_way(float("-inf")), reach), F.array(_way(0.0)))
    state = F.struct(begin.alias("last"), F.array().cast(f"array<array<{_WAY}>>").alias("laid"))
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  (value is worked out once)

    def over(acc: Column, block: Column) -> Column:
        ways = _best_ways(block["xs"], acc["last"], block["b"] * BLOCK - reach)
        return let(ways, lambda w: F.struct(F.slice(w, -(reach + 1), reach + 1).alias("last"), F.concat(acc["laid"], F.array(F.slice(w, F.lit(reach + 2), F.size(w) - reach - 1))).alias("laid")))

    laid = grouped.select("wid", "len", F.aggregate("blocks", state, over)["laid"].alias("laid"))
    path = F.struct(F.col("len").alias("e"), F.array().cast("array<array<int>>").alias("ids"))

    def back(acc: Column, b: Column) -> Column:
        low = b * BLOCK
        part = _walked(F.get("laid", b), F.sequence(F.least(F.col("len"), low + BLOCK), low + 1, F.lit(-1)), acc["e"], low + 1)
        return let(part, lambda x: F.struct(x["e"].alias("e"), F.concat(F.array(x["ids"]), acc["ids"]).alias("ids")))

    read = F.aggregate(F.sequence(F.size("laid") - 1, F.lit(0), F.lit(-1)), path, back)["ids"]
    found = laid.select("wid", spelled_out(F.flatten(read), model).alias("ids"))
    return words.join(found, "wid").select("word", "n", "ids")


def merge_order_short(edges: DataFrame, model: Model, run_rank: int) -> DataFrame:
    """word, n, ids of chunks of at most SHORT characters; a bit of the mask is a boundary, an edge is one long."""
    shift = lambda c, n: F.shiftleft(c.cast("long"), n)
    packed = edges.withColumn("x", shift(F.col("rank"), 40) + shift(F.col("s"), 34) + shift(F.col("e"), 28) + F.greatest(F.col("id"), F.lit(-1)) + 1)
    grouped = packed.groupBy("wid").agg(F.first("word").alias("word"), F.first("n").alias("n"), F.sort_array(F.collect_list("x")).alias("xs"), F.array_sort(F.collect_list(F.when(F.col("id") < 0, F.struct("s", "id")))).alias("unknown"))
    part = lambda x, at, width: F.shiftright(x, at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    at = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)

    def taken(mask: Column, x: Column) -> Column:
        s, e = at(part(x, 34, 6)), at(part(x, 28, 6))
        ends, inner = s.bitwiseOR(e), e - s - s  # inner: the bits between
        fits = (mask.bitwiseAND(ends) == ends) & (F.bit_count(mask.bitwiseAND(inner)) == 1)
        return F.when(fits, mask.bitwiseAND(F.bitwise_not(inner))).otherwise(mask)

    start = at(F.length("word") + 1) - 1
    spaced = F.col("word").contains(SPACE * 16)
    mask = F.aggregate(F.when(spaced, F.filter("xs", lambda x: part(x, 40, 20) != run_rank)).otherwise(F.col("xs")), start, taken)
    runs = F.filter("xs", lambda x: part(x, 40, 20) == run_rank)
    step = lambda m, _: F.coalesce(F.get(F.filter(F.transform(runs, lambda x: taken(m, x)), lambda y: y != m), F.lit(0)), m)
    again = F.aggregate(F.sequence(F.lit(1), F.length("word")), mask, step)
    out = grouped.withColumn("mask", F.when(spaced, again).otherwise(mask))

    def stays(x: Column) -> Column:
        s, e = at(part(x, 34, 6)), at(part(x, 28, 6))
        return F.col("mask").bitwiseAND((e - s).bitwiseOR(e)) == s.bitwiseOR(e)  # of s up to e, only the ends are set

    known = F.transform(F.filter("xs", stays), lambda x: F.struct(part(x, 34, 6).alias("s"), (part(x, 0, 28) - 1).alias("id")))
    spots = F.array_sort(F.concat(F.filter(known, lambda x: x["id"] >= 0), "unknown"))
    return out.select("word", "n", spelled_out(F.transform(spots, lambda x: x["id"]), model).alias("ids"))


def merge_order_long(edges: DataFrame, model: Model, run_rank: int) -> DataFrame:
    """word, n, ids of chunks of any length; an element of the array says whether its place is a boundary."""
    grouped = edges.groupBy("wid").agg(F.first("word").alias("word"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "s", "e", "id"))).alias("xs"))
    inside = lambda m, x: F.filter(F.sequence(x["s"] + 1, F.greatest(x["s"] + 1, x["e"] - 1)), lambda i: F.get(m, i) & (i < x["e"]))
    both = lambda m, x: F.get(m, x["s"]) & F.get(m, x["e"])

    def taken(m: Column, x: Column) -> Column:
        mid = inside(m, x)
        return F.when(both(m, x) & (F.size(mid) == 1), F.transform(m, lambda b, i: b & (i != F.get(mid, F.lit(0))))).otherwise(m)

    start = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.lit(True))
    spaced = F.col("word").contains(SPACE * 16)
    mask = F.aggregate(F.when(spaced, F.filter("xs", lambda x: x["rank"] != run_rank)).otherwise(F.col("xs")), start, taken)
    runs = F.filter("xs", lambda x: x["rank"] == run_rank)
    first = lambda m: F.get(F.filter(runs, lambda x: both(m, x) & (F.size(inside(m, x)) == 1)), F.lit(0))
    step = lambda m, _: F.coalesce(taken(m, first(m)), m)
    again = F.aggregate(F.sequence(F.lit(1), F.length(F.regexp_extract("word", f"^{SPACE}*", 0)) + 1), mask, step)
    out = grouped.withColumn("mask", F.when(spaced, again).otherwise(mask))
    spots = F.filter("xs", lambda x: both(F.col("mask"), x) & (F.size(inside(F.col("mask"), x)) == 0))
    taken_in_order = F.array_sort(F.transform(spots, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))))
    return out.select("word", "n", spelled_out(F.transform(taken_in_order, lambda x: x["id"]), model).alias("ids"))


def encode_words(words: DataFrame, model: Model, fold: str = "viterbi") -> DataFrame:
    """word, n, ids of distinct, non-empty words (word, n), in a file. Words get numbers in a file of their own.

    They are dealt by number before they are exploded, so that their edges are grouped where they are.
    """
    numbered = cut(words.select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "chunks")
    pieces = piece_table(words.sparkSession, model)
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-numbered.count() // TASK_WORDS))
    short = numbered.filter(F.length("word") <= SHORT).repartition(tasks, "wid")
    long = numbered.filter(F.length("word") > SHORT)
    if fold == "viterbi":
        out = viterbi_short(short, pieces, model).unionByName(viterbi_long(long, pieces, model))
    else:
        scores = [s for p, _, s in model.pieces if len(p) > 1 and not p.strip(SPACE)]
        run_rank = sorted({-s for _, _, s in model.pieces}).index(-min(scores)) + 1 if scores else -1
        out = merge_order_short(whole_lattice(short, pieces, model), model, run_rank).unionByName(merge_order_long(whole_lattice(long, pieces, model), model, run_rank))
    out = cut(out, "chunk-ids")
    release(numbered)
    return out


def _packed(codes: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def packed_documents(docs: DataFrame, model: Model, most: int = PACK) -> DataFrame:
    """PACKS: a chunk's number is its place in words, the most frequent first. docs: doc_id, text."""
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, press = chunk_finder(model), zstandard.ZstdCompressor(level=3)
        ids, hs, codes, held, place = [], [], [], 0, _Places()

        def packed() -> pa.RecordBatch:
            flat = np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(place)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = list(place)
            row = [ids, hs, [len(c) for c in codes], _packed(rank[flat], press), [words[i] for i in order]]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["doc_ids", "hs", "sizes", "codes", "words"])

        for batch in batches:
            for doc_id, h, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = find(SPACE + text.as_py().replace(" ", SPACE)) if text.is_valid and len(text.as_py()) else []
                if ids and held + len(words) > most:
                    yield packed()
                    ids, hs, codes, held, place = [], [], [], 0, _Places()
                ids.append(doc_id.as_py())
                hs.append(h.as_py())
                codes.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                held += len(words)
        if ids:
            yield packed()

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, PACKS)


def hot_words(known: DataFrame, most: int) -> DataFrame:
    """The rows of known (word, n, ids) with short words that the most packs list: those of a count that at most `most` words reach."""
    level = F.floor(4 * F.log2("n"))
    short = known.filter(F.length("word") <= HOT_LENGTH)
    steps, total, least = short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect(), 0, None  # at most 4 * 64 rows
    for step in steps:
        total += step["count"]
        if total > most:
            break
        least = step["level"]
    return short.filter(level >= F.lit(least) if least is not None else F.lit(False))


def encode(docs: DataFrame, model: Model, pack: int = PACK, hot_size: int = HOT, fold: str = "viterbi") -> DataFrame:
    """doc_id, h (hash of the text), n_chunks, ids: one row per input row. docs: doc_id, text."""
    packs = cut(packed_documents(docs, model, pack).withColumn("pack", F.monotonically_increasing_id()), "packs")
    listed = packs.select("pack", F.posexplode("words").alias("place", "word"))
    known = encode_words(listed.groupBy("word").agg(F.count(F.lit(1)).alias("n")), model, fold)
    hot = hot_words(known, hot_size)
    rest = listed.join(F.broadcast(hot.select("word")), "word", "left_anti").join(known.select("word", "ids"), "word")  # hot has hot_size rows at most
    by_pack = rest.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("place", "ids"))).alias("own"))

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            lists = [row.values.field("ids") for row in batch.column(1)]
            sizes = [_packed(x.value_lengths().to_numpy(zero_copy_only=False), press) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.binary()), pa.array([_packed(x.flatten().to_numpy(), press) for x in lists], pa.binary())], ["pack", "own_sizes", "own_ids"])

    own = cut(by_pack.mapInArrow(pressed, "pack long, own_sizes binary, own_ids binary"), "pack-ids")
    top = hot.select("word", "ids").toArrow()
    release(known)
    names, ids_of = top.column("word").combine_chunks().cast(pa.string()), top.column("ids").combine_chunks()
    hot_flat, hot_sizes = ids_of.flatten().to_numpy().astype(np.int32), ids_of.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """words becomes each one's place in the hot table and 1, or 0."""
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            words = batch.column(5)
            at = pc.add(pc.index_in(words.flatten(), value_set=names.cast(words.type.value_type)), 1).fill_null(0).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([_packed(at[a:b], press) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["pack", "doc_ids", "hs", "sizes", "codes", "places"])

    ready = packs.select("pack", "doc_ids", "hs", "sizes", "codes", "words").mapInArrow(looked_up, "pack long, doc_ids array<long>, hs array<long>, sizes array<int>, codes binary, places binary").join(own, "pack", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, places = _unpacked(batch.column(3)[i].as_py()), _unpacked(batch.column(4)[i].as_py())
                own_sizes, own_ids = (_unpacked(x[i].as_py()) if x[i].is_valid else np.empty(0, np.int64) for x in batch.columns[5:7])
                flat, sizes_of = np.concatenate([hot_flat, own_ids.astype(np.int32)]), np.concatenate([hot_sizes, own_sizes])
                row = np.where(places > 0, places - 1, len(hot_sizes) + np.cumsum(places == 0) - 1)[codes]
                n = sizes_of[row]
                ids = flat[np.repeat(first_of(sizes_of)[row] - first_of(n), n) + np.arange(int(n.sum()))]
                sizes = batch.column(2)[i].values.to_numpy().astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(sizes, pa.int64()), lists], ["doc_id", "h", "n_chunks", "ids"])

    return ready.select("doc_ids", "hs", "sizes", "codes", "places", "own_sizes", "own_ids").mapInArrow(run, "doc_id long, h long, n_chunks long, ids array<int>")


def first_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids") -> DataFrame:
    """encoded with __text, the text that the ids stand for."""
    texts = pa.array(model.texts, pa.binary())

    def join(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            ends = pa.array(np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, texts.take(column.flatten())), b"")
            yield pa.array([raw.as_py().decode("utf-8", "replace")[1:] if row.is_valid else None for raw, row in zip(joined, column, strict=True)], pa.string())

    return encoded.withColumn("__text", F.arrow_udf(join, "string")(F.col(ids_col)))
