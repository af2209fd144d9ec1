"""Token ids in a grammar-compressed binary format: encode, Re-Pair per shard, read back any range.

Files are Parquet (so that any store Spark knows will do) with one row per shard of whole documents in ascending id
order; all binaries are little-endian:

    part int, shard int       order of the shards: range partition, then place in it
    start long                tokens of the partition's earlier shards
    n_tokens long             tokens of the shard
    doc_ids array<long>, doc_ends array<long>   documents, and where each one's tokens end in the shard
    rules binary int32[r, 2]  nonterminal VOCAB + i stands for this pair
    lengths binary int32[r]   how many tokens nonterminal VOCAB + i expands to
    symbols binary int32[m]   the shard

Re-Pair works in rounds until no pair of adjacent symbols has LEAST places in the shard that no more frequent pair takes;
a rule takes the room of LEAST - 1 symbols. In each round the most frequent pairs, those at least a sixteenth as frequent as the first, get nonterminals
and are replaced from left to right. Expansion lengths give each symbol's first token, so a range of tokens is decoded from
the symbols that cover it and no others.

Scale: one range shuffle by id; shards hold at least one document and else at most SHARD tokens, so memory is bounded by
the longest document. Starts are partition totals (one number a task, on the driver) plus counts kept in the files.

Defined cases: null text is empty; every document ends with END; rows with a null id come first; rows that repeat an id
are each written, in order of their text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

VOCAB, END = 50_257, 0
SHARD, LEAST = 1 << 20, 4
SCHEMA = "part int, shard int, start long, n_tokens long, doc_ids array<long>, doc_ends array<long>, rules binary, lengths binary, symbols binary"
_BINS, _CACHE, _AT_ONCE, _JOINED = 18, 300_000, 1 << 20, 1 << 15
_MIX, _UNMIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OTHER, _LETTER, _DIGIT, _MARK, _BREAK = range(5)
#: Kinds of bytes. Marks are ASCII ones but for those of contractions and of the added token, <|endoftext|>.
_KIND = np.array([_LETTER if chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _BREAK if i == 10 else _MARK if 32 < i < 127 and chr(i) not in "'<|>" else _OTHER for i in range(128)] + [_OTHER] * 128, np.uint8)
#: First bytes of characters that are surely no white space; "<" may begin the added token, before which runs of spaces are cut otherwise.
_SEEN = np.array([32 < i < 127 and chr(i) != "<" or 0xC3 <= i < 0xF5 and i not in (0xE1, 0xE2, 0xE3) for i in range(256)])


def cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of texts that end at `ends`: the tokenizer's pre-tokens reach over no cut, so none changes ids.

    Cuts are before a space that a visible character follows, between letters, digits and marks, and around a single line break.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    kind = _KIND[raw]
    wide = np.flatnonzero(raw[:-1] == 0xC3)  # Latin letters with accents, but for the signs of multiplication and division
    wide = wide[(raw[wide + 1] != 0x97) & (raw[wide + 1] != 0xB7)]
    kind[wide] = kind[wide + 1] = _LETTER
    solid = (kind > _OTHER) & (kind < _BREAK)
    inner = np.unique(ends[(ends > 0) & (ends < n)])  # first bytes of texts
    seen = np.append(_SEEN[raw[1:]], False)  # whether the next byte of the text begins a visible character
    seen[inner - 1] = False
    at = (raw == 32) & seen
    at[1:] |= solid[:-1] & ((kind[1:] == _BREAK) | solid[1:] & (kind[1:] != kind[:-1]))
    alone = np.flatnonzero(kind == _BREAK)
    first = np.zeros(n, bool)
    first[0] = first[inner] = True
    alone = alone[~first[alone] & seen[alone]]
    at[alone[solid[alone - 1]] + 1] = True
    return np.flatnonzero(at | first)


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat's runs of these starts and sizes, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """ids of whole texts; the ids of pieces between cuts are kept, and the library is asked once for each."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already; threads of each take room and spin
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # of a token, in bytes: each is a character of its name
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.forget()

    def forget(self) -> None:
        """The first piece is END alone."""
        self.known, self.flat, self.starts, self.sizes = {}, np.array([END], np.int32), np.array([0]), np.array([1])

    def _joined(self, pieces: list[bytes], sizes: np.ndarray, between: bytes) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces and how many each has. Pieces are put together so that each joint is a cut, and `between` a token."""
        gap, ends = len(between), np.cumsum(sizes + len(between))
        bounds = np.append(np.flatnonzero(np.diff(ends // _JOINED, prepend=0)), len(pieces)) if len(pieces) else np.zeros(1, np.int64)
        spans = [(lo, hi) for lo, hi in zip([0, *bounds.tolist()], bounds.tolist(), strict=False) if lo < hi]
        out, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        found = self.tokenizer.encode_batch_fast([between.join(pieces[lo:hi]).decode() for lo, hi in spans], add_special_tokens=False)
        for e, (lo, hi) in zip(found, spans, strict=True):
            ids = np.array(e.ids, np.int32)
            stops = ends[lo:hi] - gap - (ends[lo - 1] if lo else 0)
            reach = np.cumsum(self.width[ids])
            last = np.searchsorted(reach, stops)
            if len(ids) != last[-1] + 1 or (reach[last] != stops).any():
                raise ValueError("a token reaches over a cut")
            counts.append(np.diff(last, prepend=-1 - gap) - gap)
            if gap:
                inside = np.ones(len(ids), bool)
                inside[last[:-1] + 1] = False
                ids = ids[inside]
            out.append(ids)
        return np.concatenate(out), np.concatenate(counts)

    def _codes(self, words: pa.BinaryArray) -> np.ndarray:
        """The number of each of these distinct pieces; new ones are encoded. Pieces before or behind which a cut is not sure go alone."""
        pieces = words.to_numpy(zero_copy_only=False).tolist()
        code = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(code < 0)
        offsets, raw = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)
        first, size = raw[offsets[new]], np.diff(offsets)[new].astype(np.int64)
        angles = np.append(0, np.cumsum(raw == ord("<")))
        sure = angles[offsets[new + 1]] == angles[offsets[new]]
        spaced = sure & (first == 32) & (size > 1) & _SEEN[raw[np.minimum(offsets[new] + 1, len(raw) - 1)]]
        last = _KIND[raw[offsets[new + 1] - 1]]
        plain = sure & _SEEN[first] & (last > _OTHER) & (last < _BREAK)
        base, parts = len(self.sizes), []
        for which, between in ((spaced, b""), (plain, b"\n"), (~spaced & ~plain, None)):
            own = new[which]
            code[own] = np.arange(base, base + len(own))
            base += len(own)
            those = [pieces[i] for i in own]
            self.known.update(zip(those, code[own].tolist(), strict=True))
            if between is None:
                lists = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode() for x in those], add_special_tokens=False)]
                parts.append((np.fromiter(chain.from_iterable(lists), np.int32), np.array([len(x) for x in lists], np.int64)))
            else:
                parts.append(self._joined(those, size[which], between))
        self.flat, self.sizes = np.concatenate([self.flat, *[x for x, _ in parts]]), np.concatenate([self.sizes, *[x for _, x in parts]])
        self.starts = np.cumsum(self.sizes) - self.sizes
        return code

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Texts are taken in groups of about _AT_ONCE bytes."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _AT_ONCE, "right")) - 1)
            raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[at] : offsets[stop]] if texts.buffers()[2] else np.empty(0, np.uint8)
            yield from self._encoded(raw, offsets[at + 1 : stop + 1] - offsets[at])
            at = stop

    def _encoded(self, raw: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        places = cuts(raw, ends)
        where = np.append(places, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(where), pa.py_buffer(raw)]).dictionary_encode()
        if len(self.known) > _CACHE:
            self.forget()
        code = self._codes(pieces.dictionary)[pieces.indices.to_numpy()] if len(places) else places
        stops = np.searchsorted(places, ends)
        code = np.insert(code, stops, 0)
        sizes = self.sizes[code]
        ids = _gathered(self.flat, self.starts[code], sizes)
        return iter(np.split(ids, np.cumsum(sizes)[stops + np.arange(len(stops))][:-1]))


def repair(tokens: np.ndarray, vocab: int = VOCAB, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, rules [r, 2], lengths [r].

    Every place holds the number of its pair, -1 for pairs with too few places. A replaced pair changes the places around it
    alone, and what stands there then holds a new symbol, so only such places are numbered anew.
    """
    seq, rules, lengths = tokens.astype(np.int32), [], [np.ones(vocab, np.int64)]
    keys, counts, pair, new = np.empty(0, np.int64), np.empty(0, np.int64), np.full(len(seq), -1, np.int32), vocab
    places = np.arange(max(0, len(seq) - 1), dtype=np.int32)
    while True:
        # Pairs at `places` are numbered; those with too few places never get more.
        mixed = seq[places].astype(np.uint64)
        mixed <<= np.uint64(32)
        mixed |= seq[places + 1].astype(np.uint64)
        mixed *= _MIX  # pairs as they are make poor hashes
        if len(mixed) > 1 << 12:
            bin_ = (mixed >> np.uint64(64 - _BINS)).astype(np.int32)
            often = (np.bincount(bin_, minlength=1 << _BINS) >= least)[bin_]  # a pair is never more frequent than its bin
            places, mixed = places[often], mixed[often]
        coded = pa.array(mixed).dictionary_encode()
        index, own_keys = coded.indices.to_numpy(), (coded.dictionary.to_numpy() * _UNMIX).astype(np.int64)
        own_counts = np.bincount(index, minlength=len(own_keys))
        stays = own_counts >= least
        number = np.where(stays, np.cumsum(stays) - 1 + len(keys), -1).astype(np.int32)
        pair[places] = number[index]
        keys, counts = np.concatenate([keys, own_keys[stays]]), np.concatenate([counts, own_counts[stays]])
        chosen = np.flatnonzero(counts >= max(least, counts.max(initial=0) // 16))
        if not len(chosen):
            break
        chosen = chosen[np.argsort(keys[chosen])]
        found = keys[chosen]
        place_of = np.full(len(keys) + 1, -1, np.int32)  # the last one is that of -1
        place_of[chosen] = np.arange(len(chosen), dtype=np.int32)
        index = place_of[pair]
        spots = np.flatnonzero(index >= 0).astype(np.int32)
        index = index[spots]
        # Of overlapping pairs the most frequent one goes first, by a hash among equals, so that copies are cut alike;
        # in a run of one and the same pair, every other one.
        weight = ((counts[chosen] << 24) + ((found.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64))[index]
        close = np.diff(spots, prepend=-2) == 1
        head = np.flatnonzero(~close | (np.diff(index, prepend=-1) != 0))
        own, joined = weight[head], close[head]
        before = np.where(joined, np.concatenate([[0], own[:-1]]), 0)
        after = np.where(np.append(joined[1:], False), np.append(own[1:], 0), 0)
        size = np.diff(head, append=len(spots))
        taken = np.repeat((own >= before) & (own > after), size) & ((np.arange(len(spots), dtype=np.int32) - np.repeat(head.astype(np.int32), size)) & 1 == 0)
        pays = np.bincount(index[taken], minlength=len(found)) >= least
        if not pays.any():
            break
        taken &= pays[index]
        spots, index, found = spots[taken], (np.cumsum(pays) - 1)[index[taken]], found[pays]
        left, right = found >> 32, found & 0xFFFFFFFF
        rules.append(np.stack([left, right], 1))
        old = np.concatenate(lengths) if len(lengths) > 1 else lengths[0]
        lengths = [old, old[left] + old[right]]
        around = np.zeros(len(seq), bool)
        around[spots] = around[spots + 1] = around[np.maximum(spots - 1, 0)] = True
        lost = pair[around]
        counts -= np.bincount(lost[lost >= 0], minlength=len(counts))
        seq[spots] = index + new
        new += len(found)
        gone = np.ones(len(seq), bool)
        gone[spots + 1] = False
        seq, pair, around = seq[gone], pair[gone], around[gone]
        pair[around] = -1
        places = np.flatnonzero(around[:-1]).astype(np.int32)
        if len(keys) > 4 * (alive := int((counts >= least).sum())) + 1024:  # forget numbers that no pair needs
            stays = counts >= least
            again = np.append(np.where(stays, np.cumsum(stays) - 1, -1), -1).astype(np.int32)
            pair, keys, counts = again[pair], keys[stays], counts[stays]
            assert len(keys) == alive
    return seq, np.concatenate(rules).astype(np.int32) if rules else np.empty((0, 2), np.int32), np.concatenate(lengths)[vocab:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int = 0, stop: int | None = None, vocab: int = VOCAB) -> np.ndarray:
    """Tokens start to stop of a shard. Each nonterminal of the range is spelled out once."""
    size = np.concatenate([np.ones(vocab, np.int64), lengths])
    ends = np.cumsum(size[symbols])
    stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
    lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    seq, skipped = symbols[lo:hi].astype(np.int64), int(ends[lo - 1]) if lo else 0
    used = np.zeros(len(size), bool)
    used[seq] = True
    used = np.flatnonzero(used)
    flat = used
    while len(high := np.flatnonzero(flat >= vocab)):
        out = np.repeat(flat, 1 + (flat >= vocab))
        at = high + np.arange(len(high))
        out[at], out[at + 1] = rules[flat[high] - vocab].T
        flat = out
    first = np.zeros(len(size), np.int64)
    first[used] = np.cumsum(size[used]) - size[used]
    return _gathered(flat, first[seq], size[seq])[start - skipped : stop - skipped]


def token_shards(docs: DataFrame, tokenizer_path: str, shard: int = SHARD) -> DataFrame:
    """SCHEMA rows of docs (doc_id, text), to be written."""

    def packed(part: int, number: int, start: int, ids: list, tokens: list) -> pa.RecordBatch:
        ends, flat = np.cumsum([len(t) for t in tokens]), np.concatenate(tokens)
        symbols, rules, lengths = repair(flat)
        row = [part, number, start, len(flat), ids, ends.tolist(), rules.astype("<i4").tobytes(), lengths.astype("<i4").tobytes(), symbols.astype("<i4").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(tokenizer_path), TaskContext.get().partitionId()
        number = start = size = 0
        ids, tokens = [], []
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for doc_id, found in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                if ids and size + len(found) > shard:
                    yield packed(part, number, start, ids, tokens)
                    number, start, size, ids, tokens = number + 1, start + size, 0, [], []
                ids.append(doc_id)
                tokens.append(found)
                size += len(found)
        if ids:
            yield packed(part, number, start, ids, tokens)

    return docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def documents_of(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    totals = sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row a writing task
    before = dict(zip((t.part for t in totals), np.cumsum([0] + [t.n for t in totals]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules, lengths = np.frombuffer(row["rules"], "<i4").reshape(-1, 2), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
                flat = expand(np.frombuffer(row["symbols"], "<i4"), rules, lengths).astype("<u4")
                ends = np.array(row["doc_ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                first = before[row["part"]] + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + first, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_index(docs: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame]:
    """The shards as read back from files in the shared folder, and their documents."""
    shards = cut(token_shards(docs, tokenizer_path), "token-shards")
    return shards, documents_of(shards)
