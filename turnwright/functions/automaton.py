"""Compiled lexicons: all terms of a lexicon found by one scan of a text, over a trie with failure links.

A lexicon is compiled once, with its checks, and does not change after; it is shipped to the tasks with the function that
scans, so it is bounded by MAX_ENTRIES. A text is read once, whatever the number of terms and of their lengths, and letter
case is folded character by character, so places are those of the text. A term counts where no character of a word stands
next to it. `scan` finds all terms at a place, overlapping ones too; `chosen` takes the longest where they overlap, then the first.
"""

from __future__ import annotations

from bisect import bisect
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ENTRIES = 100_000
FOUND = "array<struct<start:int,end:int,cls:string,value:string>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cls", pa.string()), ("value", pa.string())]))


def folded(text: str) -> str:
    """Lower case, where that is one character as well."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def of_words(c: str) -> bool:
    """Whether a character is one of words: ASCII letters, digits and `_`, and all of Devanagari's block."""
    return c == "_" or (c.isascii() and c.isalnum()) or "ऀ" <= c <= "ॿ"


class CompiledLexicon:
    """Entries (term, class, value) by number, in the order of the terms, and the automaton that finds them."""

    __slots__ = ("entries", "_moves", "_back", "_ends")

    def __init__(self, entries: Iterable[tuple[str, str, str]]) -> None:
        terms: dict[str, tuple[str, str]] = {}
        for entry in entries:
            if not (isinstance(entry, tuple) and len(entry) == 3 and all(isinstance(x, str) for x in entry)):
                raise TypeError(f"an entry is a term, a class and a value, all texts, not {entry!r}")
            term, cls, value = folded(entry[0]), entry[1], entry[2]
            if not term.strip() or term != term.strip():
                raise ValueError(f"a term is not blank and has no spaces around it: {entry!r}")
            if terms.setdefault(term, (cls, value)) != (cls, value):
                raise ValueError(f"term {term!r} has two meanings: {terms[term]} and {(cls, value)}")
        if len(terms) > MAX_ENTRIES:
            raise ValueError(f"at most {MAX_ENTRIES} terms")
        own = tuple((term, *terms[term]) for term in sorted(terms))
        moves: list[dict[str, int]] = [{}]
        ends: list[tuple[int, ...]] = [()]
        for number, (term, _, _) in enumerate(own):
            at = 0
            for c in term:
                if c not in moves[at]:
                    moves[at][c] = len(moves)
                    moves.append({})
                    ends.append(())
                at = moves[at][c]
            ends[at] = (number,)
        back, todo = [0] * len(moves), deque(moves[0].values())
        while todo:
            at = todo.popleft()
            for c, to in moves[at].items():
                todo.append(to)
                up = back[at]
                while up and c not in moves[up]:
                    up = back[up]
                back[to] = moves[up].get(c, 0) if moves[up].get(c, 0) != to else 0
                ends[to] += ends[back[to]]
        for name, value in (("entries", own), ("_moves", tuple(MappingProxyType(m) for m in moves)), ("_back", tuple(back)), ("_ends", tuple(ends))):
            object.__setattr__(self, name, value)

    def __setattr__(self, name: str, value: object) -> None:
        raise AttributeError("a compiled lexicon does not change")

    def __reduce__(self):
        return CompiledLexicon, (list(self.entries),)

    def scan(self, text: str) -> Iterator[tuple[int, int, int]]:
        """start, end and number of every term that stands between characters that are not of words."""
        at, moves, back, ends = 0, self._moves, self._back, self._ends
        for i, c in enumerate(folded(text)):
            while at and c not in moves[at]:
                at = back[at]
            at = moves[at].get(c, 0)
            if ends[at] and not (i + 1 < len(text) and of_words(text[i + 1])):
                for number in ends[at]:
                    start = i + 1 - len(self.entries[number][0])
                    if not start or not of_words(text[start - 1]):
                        yield start, i + 1, number

    def chosen(self, text: str) -> list[tuple[int, int, int]]:
        """Those of scan() that do not overlap, the longest first, in the order of the text."""
        out: list[tuple[int, int, int]] = []
        for a, b, n in sorted(self.scan(text), key=lambda m: (m[0] - m[1], m[0])):
            at = bisect(out, (a, b, n))
            if not (at and out[at - 1][1] > a) and not (at < len(out) and out[at][0] < b):
                out.insert(at, (a, b, n))
        return out

    def found(self, text: Column) -> Column:
        """FOUND of every text, what chosen() gives; null for null."""

        def placed(text: str) -> list[dict]:
            return [{"start": a, "end": b, "cls": self.entries[n][1], "value": self.entries[n][2]} for a, b, n in self.chosen(text)]

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array([None if t is None else placed(t) for t in column.to_pylist()], _FOUND)

        return F.arrow_udf(run, FOUND)(text)


class Registry:
    """Named lexicons, each compiled at most once; a name that is not known has none."""

    def __init__(self) -> None:
        self._makers: dict[str, object] = {}
        self.get = cache(self._get)

    def add(self, name: str, make) -> None:
        if name in self._makers:
            raise ValueError(f"lexicon {name!r} is there already")
        self._makers[name] = make

    def names(self) -> list[str]:
        return sorted(self._makers)

    def _get(self, name: str) -> CompiledLexicon | None:
        make = self._makers.get(name)
        if make is None:
            return None
        made = make()
        return made if isinstance(made, CompiledLexicon) else CompiledLexicon(made)
