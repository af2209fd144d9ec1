"""Compiled lexicons against a search for every term at every place, and what spans are found over long texts."""

import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from turnwright.functions import spans
from turnwright.functions.automaton import CompiledLexicon, Registry, folded, of_words
from turnwright.functions.domain import LEXICONS, compiled, term_table
from turnwright.functions.domain import domain_terms as terms_in


def brute(entries, text):
    out = []
    for number, (term, _, _) in enumerate(entries):
        for i in range(len(text) - len(term) + 1):
            if folded(text)[i : i + len(term)] == term and not (i and of_words(text[i - 1])) and not (i + len(term) < len(text) and of_words(text[i + len(term)])):
                out.append((i, i + len(term), number))
    return sorted(out)


def test_scan_finds_every_term():
    draw = random.Random(5)
    for _ in range(60):
        entries = {" ".join(draw.choice(["a", "b", "ab", "लो", "İ"]) for _ in range(draw.randrange(1, 4))) for _ in range(12)}
        lexicon = CompiledLexicon((t, "c", t) for t in entries)
        text = "".join(draw.choice(["a", "b", "B", " ", " ", "-", "लो", "İ", "Ab", "😀"]) for _ in range(80))
        assert sorted(lexicon.scan(text)) == brute(lexicon.entries, text)


def test_lexicons_are_checked_and_do_not_change():
    for wrong in (["x"], [("a", "c", 1)], [("a", "c")]):
        with pytest.raises(TypeError):
            CompiledLexicon(wrong)
    for wrong in ([("a", "c", "1"), ("A", "c", "2")], [("", "c", "1")], [(" a", "c", "1")]):
        with pytest.raises(ValueError):
            CompiledLexicon(wrong)
    lexicon = CompiledLexicon([("b", "c", "2"), ("a", "c", "1"), ("A", "c", "1")])
    assert lexicon.entries == (("a", "c", "1"), ("b", "c", "2")) and pickle.loads(pickle.dumps(lexicon)).entries == lexicon.entries
    with pytest.raises(AttributeError):
        lexicon.entries = ()
    registry, made = Registry(), []
    registry.add("x", lambda: made.append(1) or [("a", "c", "1")])
    with pytest.raises(ValueError):
        registry.add("x", list)
    assert registry.get("x") is registry.get("x") and made == [1] and registry.get("y") is None and registry.names() == ["x"]
    assert LEXICONS.get("loan_terms") is compiled()


def test_domain_terms_are_those_of_one_pattern_for_each_length(spark):
    draw, known = random.Random(3), term_table()
    texts = [" ".join(draw.choice([*known, "xx", "और", "-", "bajaj finance.", "(EMI)", "emis"]) for _ in range(draw.randrange(12))) for _ in range(150)] + ["", None]

    def by_patterns(text):
        chosen = []
        for term in sorted(known, key=lambda t: -len(t)):
            for m in re.finditer(f"(?i)(?<![A-Za-z0-9_ऀ-ॿ])(?=({re.escape(term)})(?![A-Za-z0-9_ऀ-ॿ]))", text):
                chosen.append((-len(term), m.start(), m.start(1), m.end(1), known[term]))
        out = []
        for _, _, a, b, form in sorted(chosen):
            if all(b <= x or y <= a for x, y, _ in out):
                out.append((a, b, form))
        return sorted(out)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", terms_in(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(s.start, s.end, s.canonical) for s in r.s] == by_patterns(r.t or "") and all(r.t[s.start : s.end] == s.raw for s in r.s)


def test_matches_and_splices_of_long_texts(spark):
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["12%", "x", "😀é", "7%", "क"]) for _ in range(n)) for n in (0, 1, 30, 255, 256, 257, 900, 6000)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in table.select("t", spans.matches(F.col("t"), "[0-9]+%").alias("m")).collect():
        assert [(m.start, m.end, m.raw) for m in r.m] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+%", r.t)]
    marked = table.withColumn("s", F.transform(spans.matches(F.col("t"), "[0-9]+%"), lambda m: spans.span(F.lit("percent"), m["raw"], m["start"], m["end"], F.lit("r"), 1.0, F.lit("<p>"))))
    for r in marked.select("t", spans.applied(F.col("t"), F.col("s")).alias("out")).collect():
        assert r.out == re.sub("[0-9]+%", "<p>", r.t)
