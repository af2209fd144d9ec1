"""Exact dedup, licences, urls, mixing and chats against brute force on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwright.llm import chat, exact, licenses, mixing, urls

TEXTS = ["a  b", "a b", " a b", "", None, "x" * 5000, "x" * 5000 + "y", "x" * 2048, "x" * 4096, "x" * 4097, "ab" * 3000, "ab" * 3000, "a\tb", "a b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "junk") for i, t in enumerate(TEXTS)] + [(3, "", "twice"), (None, "a b", "no id"), (None, "alone", "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string, name string")


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), []).append(r.doc_id)
    return {hashlib.sha256(t.encode()).hexdigest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups(spark, docs, clash):
    how = {"fingerprint": lambda c: F.length(c).cast("long") % 2, "block": 512} if clash else {}
    got = exact.exact_groups(docs, **how).collect()
    want = brute_groups(docs.collect())
    assert len(got) == docs.count()
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in got)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(want)


def test_exact_keeps_columns_and_takes_empty_tables(spark, docs):
    kept = exact.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(brute_groups(docs.collect()))
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(0, "Foo GNU General Public License, v3"), (1, "mit license MIT LICENSE"), (2, None), (3, ""), (4, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (5, "all rights"), (6, "plain mit words"), (7, "z " * 5000 + "CC-BY")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, label int")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].base_labels, got[0].score) == (1, 1, "gpl", 1.0)
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 2)
    assert (got[2].n_words, got[2].labels, got[2].score, got[2].first_word) == (0, "", 0.0, None) and got[3].n_words == 0
    assert got[4].labels == "" and got[5].labels == "" and got[6].labels == ""
    assert (got[7].base_labels, got[7].first_word) == ("cc-by", 5000)


def brute_licenses(text):
    words = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", text.lower())
    best = {}
    for label, tokens, need, span in licenses.template_sets():
        most = max((len(set(tokens) & set(words[i : i + span])) for i in range(len(words))), default=0)
        if most >= need:
            best[label] = max(best.get(label, 0), most / len(tokens))
    return best


def test_license_templates_by_brute_force(spark, monkeypatch):
    parts = ["licensed under the apache license version 2 0", "all rights reserved", "this work is", "released under", "the mit license", "permission is hereby granted free of charge", "of the in and", "to any person obtaining a copy of this software"]
    rows = [(i, "\n".join(parts[(7 * j + i) % 8] + " " + parts[(j * i) % 8] + " x" * (j % 4) for j in range(i % 13 + 1))) for i in range(60)]
    vocabulary = sorted({w for _, tokens, _, _ in licenses.template_sets() for w in tokens})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, label): c for i, text in rows for label, c in brute_licenses(text).items()}
    for stride in (1, 3, 64):
        monkeypatch.setattr(licenses, "STRIDE", stride)
        got = {(r.row, r.label): r.containment for r in licenses.template_matches(licenses.marked_words(docs, vocabulary).withColumn("row", F.col("doc_id"))).collect()}
        assert got == pytest.approx(want) and len(want) > 20


def test_license_rows_keep_their_own_labels(spark):
    rows = [(1, "all rights reserved"), (1, "plain text"), (None, "all rights reserved"), (None, "nothing"), (None, None), (2, "released " + "a b c d " * 3 + "under " + "e f g " * 3 + "the license")]
    got = sorted((r.doc_id or 0, r.n_words, r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")).collect())
    assert got == [(0, 0, "", 0.0), (0, 1, "", 0.0), (0, 3, "all-rights-reserved", 1.0), (1, 2, "", 0.0), (1, 3, "all-rights-reserved", 1.0), (2, 25, "", 0.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert licenses.scan_licenses(table.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "the license of a copy " * 60_000 + "all rights reserved")], "doc_id long, text string")
    assert [(r.n_words, r.labels) for r in licenses.scan_licenses(long).collect()] == [(300_003, "all-rights-reserved")]


def test_wrapped_licence_headers(spark):
    headers = {
        "mit": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal",
        "apache": " * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n",
        "bsd": "// Redistribution and use in source and binary forms,\n// with or without modification, are permitted\n// provided that the following conditions are met:",
        "mpl": "This Source Code Form is subject to the terms\r\nof the Mozilla Public\r\nLicense, v. 2.0. If a copy",
        "": "Permission is hereby granted, free of charge, to any person " + "other words " * 30 + "\nobtaining a copy\nof this software and associated documentation files",
    }
    rows = [(i, "first words of a text\n" * 20 + text + "\nand words after it") for i, text in enumerate(headers.values())]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(len(headers))] == list(headers)
    assert all(got[i].score >= 0.8 and got[i].n_base == 0 for i in range(4)) and got[4].score == 0.0


def test_urls_and_page_rank(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [
        (1, "http://good.com/", link("a.org", "b.org")), (2, "https://X.Example.com/en/q?z", link("bad.org")), (3, "http://a.org/", link("b.org")), (4, "http://evil.org#f", link("x.example.com")),
        (5, None, None), (6, "no scheme", link("a.org")), (7, "https://www.example.com/en/1", ""), (8, "ftp://s.net/es/", None), (9, "http://far.org/", link("evil.org")), (1, "http://good.com/", link("a.org", "b.org")),
    ]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert (got[1].rule, got[1].verdict) == ("com/", "allow") and (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("x.example.com", "/en/q", "example.com/en/", "block")
    assert (got[7].rule, got[8].rule) == ("www.example.com/en/", "net/es/") and (got[5].host, got[5].verdict, got[6].path) == ("", "allow", "")
    assert got[4].verdict == "block" and got[9].verdict == "block" and got[3].verdict == "allow" and got[3].trust > 0
    edges = {("good.com", "a.org"): 2, ("good.com", "b.org"): 2, ("x.example.com", "bad.org"): 1, ("a.org", "b.org"): 1, ("evil.org", "x.example.com"): 1, ("far.org", "evil.org"): 1}
    seeds = {"trust": {"good.com": 2 / 3, "www.example.com": 1 / 3}, "distrust": {"x.example.com": 0.5, "s.net": 0.5}}
    for kind, seed in seeds.items():
        moves = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        rank = dict(seed)
        for _ in range(200):
            new = {h: s * (1 - urls.DAMPING) for h, s in seed.items()}
            for (a, b), n in moves.items():
                new[b] = new.get(b, 0) + rank.get(a, 0) * n / sum(m for (x, _), m in moves.items() if x == a) * urls.DAMPING
            rank = new
        assert all(r[kind] == pytest.approx(rank.get(r.host, 0.0), abs=1e-9) for r in got.values())
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_a_chain_of_hosts_behind_one_blocked_seed_is_blocked(spark):
    # Each host links to the one before; the first page is blocked by a rule. What reaches the last is some 1e-9 of the mass.
    name = lambda i: f"h{i}.org" if i else "seed.example.com"
    rows = [(i, f"http://{name(i)}/en/", f'<a href="http://{name(i - 1)}/">' if i else None) for i in range(121)] + [(200, "http://alone.org/", ""), (201, "http://friend.com/", '<a href="http://liked.org/">'), (202, "http://liked.org/", "")]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(121)] == ["block"] * 121 and (got[200], got[201], got[202]) == ("allow", "allow", "allow")


def test_verdicts_on_a_graph_are_those_of_a_converged_walk(spark):
    draw, n = random.Random(8), 1500
    links = {i: [draw.randrange(n) if draw.random() < 0.7 else draw.randrange(20) for _ in range(draw.randrange(4))] for i in range(n)}
    name = lambda i: f"h{i}.com" if i % 50 == 0 else f"h{i}.example.com" if i % 50 == 1 else f"h{i}.org"
    rows = [(i, f"http://{name(i)}/en/", "".join(f'<a href="http://{name(j)}/">' for j in links[i])) for i in range(n)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    ranks = []
    for back, want in ((False, 0), (True, 1)):
        move = np.zeros((n, n))
        for i, js in links.items():
            for j in js:
                if i != j:
                    move[(i, j) if back else (j, i)] += 1
        move /= np.maximum(1, move.sum(0))
        seed = np.array([float(i % 50 == want) for i in range(n)])
        rank = seed = seed / seed.sum()
        for _ in range(400):
            rank = 0.85 * move @ rank + 0.15 * seed
        ranks.append(rank)
    free = [i for i in range(n) if i % 50 > 1]
    assert [got[i].verdict for i in free] == ["block" if ranks[1][i] > ranks[0][i] else "allow" for i in free]
    assert {got[i].verdict for i in free} == {"block", "allow"}


def test_raking_is_that_of_an_independent_fit(spark):
    draw = random.Random(2)
    rows = [(f"s{i}", f"l{j}", f"t{k}", draw.randrange(1, 5000)) for i in range(5) for j in range(4) for k in range(3) if draw.random() < 0.8]
    targets = {"source": 0.5, "lang": {"l0": 4.0, "l1": 3.0, "l2": 2.0, "l3": 1.0}, "topic": {"t0": 1.0, "t1": 1.0, "t2": 1.0}}
    weight = {r[:3]: r[3] / sum(x[3] for x in rows) for r in rows}
    goals = []
    for at, dim in enumerate(mixing.DIMS):
        tokens = {}
        for r in rows:
            tokens[r[at]] = tokens.get(r[at], 0) + r[3]
        ask = {v: t**0.5 if dim == "source" else targets[dim][v] for v, t in tokens.items()}
        goals.append({v: w / sum(ask.values()) for v, w in ask.items()})
    for _ in range(500):
        for at, goal in enumerate(goals):
            have = {}
            for cell, w in weight.items():
                have[cell[at]] = have.get(cell[at], 0) + w
            weight = {cell: w * goal[cell[at]] / have[cell[at]] for cell, w in weight.items()}
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    for most in (mixing.MAX_BROADCAST, 0):  # in one expression, and as grouped sums
        got = mixing.rake(cells, targets, tolerance=1e-7 if most else 1e-3, most_cells=most).collect()
        assert len(got) == len(rows) and all(r.weight == pytest.approx(weight[r.source, r.lang, r.topic], rel=1e-5 if most else 1e-2) for r in got)


def test_raking_meets_marginals(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", None][i % 3], ["en", "fr"][i % 2], "t") for i in range(900)] + [(None, None, "a", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"a": 0.5, "b": 0.3, "unknown": 0.2}, "lang": {"en": 0.7, "fr": 0.3}}
    cells = mixing.with_cells(docs).groupBy(*[F.col(f"__{d}").alias(d) for d in mixing.DIMS]).agg(F.sum("__tokens").alias("tokens"))
    raked = mixing.rake(cells, targets).collect()
    for dim, goals in targets.items():
        for value, goal in goals.items():
            assert sum(r.weight for r in raked if r[dim] == value) == pytest.approx(goal, abs=1e-4)
    mixed = mixing.mix(docs, targets, fraction=0.5).collect()
    assert len(mixed) == 901 and sum(r["__tokens"] * r["__p"] for r in mixed) == pytest.approx(0.5 * sum(r["__tokens"] for r in mixed), rel=1e-3)
    assert mixing.sampled(docs, targets=targets).columns == docs.columns and mixing.sampled(docs.limit(0)).count() == 0


def test_mixing_keeps_unlisted_values_and_meets_targets_under_the_caps(spark):
    # Unlisted languages (no lang, it) keep their shares; source b is too small for the asked fraction and is drawn whole.
    rows = [(i, "w " * (1 + i % 3), "b" if i % 10 == 0 else "ac"[i % 2], ["en", "fr", None, "it"][(i // 10 + i) % 4], "t") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"a": 0.4, "b": 0.2, "c": 0.4}, "lang": {"en": 0.6, "fr": 0.4}}
    mixed = mixing.mix(docs, targets, fraction=0.9).collect()
    total = sum(r["__tokens"] for r in mixed)
    drawn = sum(r["__tokens"] * r["__p"] for r in mixed)
    part = lambda dim, value, p="__p": sum(r["__tokens"] * (r[p] if p else 1) for r in mixed if r[f"__{dim}"] == value)
    own = {v: part("lang", v, None) / total for v in ("en", "fr", "unknown", "it")}
    rest = own["en"] + own["fr"]
    for value, goal in {"en": 0.6 * rest, "fr": 0.4 * rest, "unknown": own["unknown"], "it": own["it"]}.items():
        assert part("lang", value) / drawn == pytest.approx(goal, rel=1e-3)
    for value, goal in targets["source"].items():
        assert part("source", value) / drawn == pytest.approx(goal, rel=1e-3)
    assert drawn / total == pytest.approx(part("source", "b", None) / total / 0.2, rel=1e-3) and max(r["__p"] for r in mixed) <= 1
    assert {r["__lang"] for r in mixed if r["__drawn"]} == set(own)


def test_chats(spark):
    a = [("user", "hi"), ("assistant", "yo"), ("user", "more")]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [(None, None)], 7: [("user", str(i)) for i in range(600)], 8: [("user", str(i)) for i in range(300)]}
    rows = [(c, i, *t) for c, turns in logs.items() for i, t in enumerate(turns)] + [(3, 0, "user", "hi"), (None, 0, "user", "x"), (9, None, "user", "x")]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, place int")
    got = {(r.conv_id, r.part): r for r in chat.format_chats(table).collect()}
    assert set(got) == {(3, 0), (5, 0), (6, 0), (7, 0), (7, 1), (7, 2)}
    assert got[3, 0].n_logged == 2 and got[3, 0].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[6, 0].chat == "<|im_start|>unknown\n<|im_end|>\n" and got[7, 2].chat.count("<|im_start|>") == 88 and got[7, 1].n_turns == 600
    assert chat.format_chats(table.limit(0)).count() == 0
