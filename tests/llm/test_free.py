"""Near-dedup, token files, toxicity, neighbours, pieces and the pipeline against brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from turnwright.llm import ann, minhash, sentencepiece_lattice, tokens, toxicity  # noqa: E402


def brute_components(rows, k):
    sets = [(i, minhash.shingles_of(t.encode() if t else None, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    draw = random.Random(k)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for family in range(6):
        base = [draw.choice(words) for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randrange(8)):
                copy[draw.randrange(120)] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, "One"), (101, "one\t"), (102, ""), (103, None), (104, " \n"), (105, "a b"), (106, "A B"), (107, " ".join(words * 60)), (None, "a b")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    got = minhash.near_duplicates(table, k).collect()
    want = brute_components(rows, k)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)
    assert minhash.near_duplicates(table.limit(0), k).count() == 0


def linked_through_near_texts(m, seed=1):
    """A base, m texts that differ from it in one word, and for each of these one with 22 more words changed, which only links with it."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(50_000)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(m):
        spot = draw.randrange(1, 399)
        near = list(base)
        near[spot] = f"n{i}"
        rows.append((1 + 2 * i, " ".join(near)))
        spots, free = [spot], [x for x in range(1, 399) if x != spot]
        draw.shuffle(free)
        for x in free:
            if len(spots) < 23 and all(abs(x - y) > 1 for y in spots):
                spots.append(x)
        for x in spots[1:]:
            near[x] = f"f{i}_{x}"
        rows.append((2 + 2 * i, " ".join(near)))
    return rows


def test_near_duplicates_keep_links_to_near_texts_in_large_buckets(spark):
    rows = linked_through_near_texts(700)
    sets = [minhash.shingles_of(t.encode(), 2) for _, t in rows[:3]]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) > 0.98 and share(sets[0], sets[2]) < 0.8 <= share(sets[1], sets[2])
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[:3])]  # classes equal to the base, the core of all, and to others
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 2).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_blocks_join_the_components_that_all_pairs_join(spark):
    # Many blocks and slices: each pair across components is met in one of them.
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(60)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(draw.randrange(14)):
            text[draw.randrange(60)] = draw.choice(words)
        rows.append((i, " ".join(text)))
    want = brute_components(rows, 2)
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc_id long, raw binary")
    members = spark.createDataFrame([(7, i, i) for i, _ in rows], "group long, rep long, root long")
    sizes = spark.createDataFrame([(i, len(minhash.shingles_of(t.encode(), 2))) for i, t in rows], "rep long, size long")
    pairs = [tuple(r) for r in minhash.blocked(members, sizes, texts, 2, 80, block=16, slice_=1500).collect()]
    sets = {i: minhash.shingles_of(t.encode(), 2) for i, t in rows}
    assert all(100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v]) for u, v in pairs)
    root = {i: i for i, _ in rows}
    for _ in rows:
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    assert root == want


def test_near_duplicates_take_large_buckets_apart(spark):
    # A base, its copies, copies of far copies, and texts that share a passage: buckets of many members and components.
    draw = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    base = [draw.choice(words) for _ in range(150)]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[draw.randrange(len(text))] = draw.choice(words)
        return text

    far = [edited(base, 30) for _ in range(4)]
    texts = [edited(base, draw.randrange(30)) for _ in range(60)] + [edited(draw.choice(far), draw.randrange(6)) for _ in range(40)]
    texts += [base[:90] + [draw.choice(words) for _ in range(60)] for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2)
    assert 10 < len(set(want.values())) < 120
    for small in (64, 6):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table, 2, small=small).collect()}
        assert got == want, small


def test_near_duplicates_join_rows_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, a), (5, a), (5, b), (7, b), (8, c), (9, ""), (9, c), (10, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 2, False), (7, 2, False), (8, 8, True), (9, 8, False), (9, 8, False), (10, 10, True)]
    kept = minhash.keep_representatives(spark.createDataFrame([*rows, (None, a)], "doc_id long, text string").withColumn("other_id", F.lit(1)), 2)
    assert sorted(kept.select("doc_id").toPandas().doc_id.fillna(-1)) == [-1, 2, 8, 10] and kept.columns == ["doc_id", "text", "other_id"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50)], "u long, v long")
    got = {r.node: r.root for r in minhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 41: 40, 50: 40}


def test_repair_round_trip():
    draw = np.random.default_rng(0)
    for flat in (draw.integers(0, 5, 5000), np.zeros(1000, np.int64), np.array([7]), np.array([], np.int64), np.tile([1, 2, 3], 500)):
        symbols, rules, lengths = tokens.repair(flat)
        assert (tokens.expand(symbols, rules, lengths) == flat).all()
        for a, b in ((0, 1), (3, 17), (len(flat) // 2, len(flat))):
            assert (tokens.expand(symbols, rules, lengths, a, b) == flat[a:b]).all()


def test_repair_leaves_no_frequent_pair():
    draw = np.random.default_rng(1)
    flat = np.concatenate([draw.integers(0, 400, 3000), np.tile(draw.integers(0, 400, 700), 12), draw.integers(0, 40, 3000)])
    symbols, rules, lengths = tokens.repair(flat)
    counts = np.unique(np.stack([symbols[:-1], symbols[1:]], 1), axis=0, return_counts=True)[1]
    assert counts.max() < 2 * tokens.LEAST and lengths.max() >= 200
    uses = np.bincount(np.concatenate([symbols, rules.ravel()]), minlength=tokens.VOCAB + len(rules))[tokens.VOCAB :]
    assert (uses > 0).all() and 4 * len(symbols) + 12 * len(rules) < 0.6 * 4 * len(flat)


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["it's  a test \n\n of spaces ", "", None, "é 日本 😀 <|endoftext|> x", "a\x1c b  c  d", "word " * 4000, "the same", "the same"]
    table = spark.createDataFrame([(10 * i, t, 0) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, start int")
    got = sorted(tokens.documents_of(tokens.token_shards(table, path, shard=100)).collect(), key=lambda r: r.start)
    plain, start = Tokenizer.from_file(path), 0
    for r, text in zip(got, ["x", *texts], strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.write_and_index(table.limit(0), path)[1].count() == 0


def test_cuts_change_no_ids():
    # Runs of spaces before the added token, contractions, single and double line breaks, accents, signs and digits beside letters.
    from tokenizers import Tokenizer

    path, draw = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    plain, parts = Tokenizer.from_file(path), ["  ", " ", "\n", "\n\n", "\t", " ", "　", "<|endoftext|>", "<|", "word", "don't", "'s", "é", "ß", "×", "é", "12", "a1", ",", "...", "(", "日本", "😀", "\x1c", "\r\n", "l'été,", "$5.00", "-->"]
    texts = ["a  <|endoftext|> b", "", "x\n<|endoftext|>", None, *("".join(draw.choice(parts) for _ in range(draw.randrange(1, 40))) for _ in range(3000))]
    got = list(tokens.Encoder(path)(pa.array(texts).fill_null("")))
    assert [x.tolist() for x in got] == [[*plain.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_token_work_is_done_once(monkeypatch):
    # A word is encoded once, whatever follows it, and few calls of the library do it; a place of Re-Pair is numbered again only where a pair beside it was replaced.
    class Counting:
        def __init__(self, inner):
            self.inner, self.sizes, self.calls = inner, 0, 0

        def encode_batch_fast(self, texts, **how):
            self.sizes, self.calls = self.sizes + sum(map(len, texts)), self.calls + len(texts)
            return self.inner.encode_batch_fast(texts, **how)

    encode = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode.tokenizer = counting = Counting(encode.tokenizer)
    words = [f" word{'x' * (i % 7)}q{chr(97 + i % 26)}" for i in range(182)]
    texts = pa.array(["".join(w + mark for w in words) for mark in (",", ".", ";", "!", "?", "")])
    assert len(list(encode(texts))) == 6 and counting.calls <= 4 and counting.sizes < 2 * sum(map(len, words))


def test_toxicity_on_held_out_documents(spark):
    draw = random.Random(1)
    say = lambda bad: " ".join([draw.choice(["tree", "house", "river", "cloud", "stone"]) for _ in range(30)] + ([draw.choice(["awfulword", "nastyword", "vileword"])] * bad))
    rows = [(i, say(i % 5 == 0), int(i % 5 == 0), int(i % 10 != 0)) for i in range(400)]
    docs = spark.createDataFrame([(r[0], r[1], 1.0) for r in rows] + [(900, None, 1.0), (901, "", 1.0), (None, "vileword", 1.0)], "doc_id long, text string, grade double")
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows[:200]] + [(0, 0, 1), (None, 1, 1), (5000, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.words) == {"awfulword", "nastyword", "vileword"} and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r["__severity"] for r in toxicity.scored(docs, model).collect()}
    assert all((got[i] >= toxicity.REJECT) == bool(bad) for i, _, bad, _ in rows[200:]) and got[900] < toxicity.REJECT and got[None] >= toxicity.REJECT
    kept = toxicity.filtered(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 320 + 2
    assert toxicity.filtered(docs, labels.limit(0)).count() == docs.count() and toxicity.filtered(docs.limit(0), labels).count() == 0


def test_toxicity_thresholds_hold_for_the_true_share(spark):
    # One in ten is toxic; 60 % of those and 15 % of the clean ones hold a weak cue: 31 % of the documents that hold it are toxic.
    def text(i):
        toxic, k = i % 10 == 0, i // 10
        return f"tree house {'vileword' if toxic and k % 5 >= 3 else 'cue' if (toxic or (7 * i) % 20 < 3) else 'river'}"

    rows = [(i, text(i)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    for sample in (20_000, 1_000, 400):  # no class, the clean ones, both classes capped
        model = toxicity.train(docs, labels, sample=sample)
        got = {r.text.split()[-1]: r["__severity"] for r in toxicity.scored(docs, model).collect()}
        assert "cue" in model.words and 0.2 < got["cue"] < 0.42 and got["vileword"] >= toxicity.REJECT and got["river"] < 0.1, sample


def test_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 16)).astype(np.float32)
    x[300:] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(400, None, 1), (500, [0.0] * 16, 1), (600, [float("nan")] * 16, 1), (700, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (5, x[5].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(table, index_block=150, query_block=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        hits += len({i for _, i, _ in found} & set(best))
        assert [k for k, _, _ in sorted(found)] == list(range(1, 11)) and all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in found)
    assert hits >= 36 and [i for _, i, _ in sorted(got[0])] == list(range(300, 310))
    assert ann.search(table.limit(0)).count() == 0


def test_recall_of_the_retrieval_on_vectors_without_structure():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(4000, 64))
    model = ann.learn(x, 10, len(x), 40)
    bits = (x - model.mean) @ model.rotations >= 0
    parts = bits[:, : model.length * model.substrings].reshape(len(x), model.substrings, model.length)
    found = 0
    for i in range(40):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        met = ((parts != parts[i]).sum(2) <= model.flips).any(1) & ((bits[:, : ann.SIGNATURE] != bits[i, : ann.SIGNATURE]).sum(1) <= model.radius)
        found += met[np.argsort(d)[:10]].sum()
    assert found >= 0.9 * 400 and model.flips <= 1


def test_near_copies_meet_once_and_the_radius_is_that_of_the_whole_table(spark):
    # Near copies are near in all substrings; in a longer table neighbours are nearer, so fewer pairs need a look.
    draw = np.random.default_rng(9)
    x = draw.normal(size=(6000, 16))
    x[:300] = x[0] + 1e-3 * draw.normal(size=(300, 16))
    distinct = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "lead long, v array<double>")
    sample = x[300:1300]
    place, near = ann.near_ones(distinct, sample, 10)
    for i in (744, 999):
        d = ((x - sample[i]) ** 2).sum(1)
        best = sorted(d[d > 0])[:10]
        assert sorted(((near[place == i] - sample[i]) ** 2).sum(1)) == pytest.approx(best)
    model = ann.learn(sample, 10, len(x), 60, known=(place, near))
    assert model.radius < ann.learn(sample, 10, len(x), 60).radius
    asked = spark.createDataFrame([(i,) for i in range(0, 300, 50)], "lead long")
    met = [tuple(r) for r in ann.meetings(ann.coded(distinct, model), asked, model).collect()]
    assert len(met) == len(set(met)) and {(q, i) for q in range(0, 300, 50) for i in range(300)} <= set(met)


def best_pieces(text, model):
    """An independent Viterbi over the whole text."""
    score = {p: (i, s) for p, i, s in model.pieces}
    unknown = min(s for _, _, s in model.pieces) - 10
    w, ways = "\u2581" + text.replace(" ", "\u2581"), [(0.0, 0, 0)]
    for e in range(1, len(w) + 1):
        best = None
        for s in range(max(0, e - model.longest), e):
            edge = score.get(w[s:e]) or ((-1, unknown) if e == s + 1 else None)
            if edge and (best is None or ways[s][0] + edge[1] > best[0]):
                best = (ways[s][0] + edge[1], s, edge[0])
        ways.append(best)
    out, e = [], len(w)
    while text and e:
        _, s, i = ways[e]
        out.append([i] if i >= 0 else [x + model.bytes_at for x in w[s:e].encode()])
        e = s
    return [i for x in reversed(out) for i in x]


PIECE_TEXTS = ["Hello world, this is 12345 text.", "", None, " two  spaces ", " " * 40 + "x", "日本語 😀 naïve ² အ执", "a" * 200, "x" * 70 + " " * 50 + "::;;" * 30, "ß" * 130 + "é", "line\nbreak\t tab", "same", "same"]


@pytest.mark.parametrize("fold", ["viterbi", "merges"])
def test_pieces_equal_the_library(spark, fold):
    """Viterbi ids are those of the library with the file read as a unigram model, merge order's those of the file as it is."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    raw, model = open(path, "rb").read(), sentencepiece_lattice.read_model(path)
    kind = raw.index(b"\x18\x02", raw.index(b"/mnt/test/datasets"))  # the trainer's model_type, 2 for BPE
    library = sentencepiece.SentencePieceProcessor(model_proto=raw if fold == "merges" else raw[:kind] + b"\x18\x01" + raw[kind + 2 :])
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PIECE_TEXTS)] + [(None, "no id", 1)], "doc_id long, text string, ids int")
    for pack, hot in ((3, 5), (100_000, 0), (10, 1000)):
        got = {r.doc_id: r for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(table, model, pack, hot, fold), model).collect()}
        assert len(got) == len(PIECE_TEXTS) + 1
        for i, text in [*enumerate(PIECE_TEXTS), (None, "no id")]:
            assert list(got[i].ids) == library.encode(text or "") and got[i]["__text"] == (text or "")
            assert fold == "merges" or list(got[i].ids) == best_pieces(text or "", model)
    assert sentencepiece_lattice.encode(table.limit(0), model, fold=fold).count() == 0


def test_pieces_of_very_long_chunks(spark):
    model, draw = sentencepiece_lattice.read_model(public_tokenizers.path("piece_bpe_32k.model")), random.Random(3)
    texts = [" " * 10_000, "".join(draw.choice("abcdefgh") for _ in range(100_000)), "".join(draw.choice(["a" * 50, " " * 300, ".;" * 99, "é日" * 33]) for _ in range(300)), "word " * 20_000]
    got = {r.doc_id: r for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model), model).collect()}
    for i, text in enumerate(texts):
        assert got[i]["__text"] == text and list(got[i].ids) == best_pieces(text, model)


def test_viterbi_is_the_best_path(spark):
    pieces = [("a", 10, -1.0), ("b", 11, -1.5), ("ab", 12, -2.0), ("ba", 13, -1.2), ("aba", 14, -3.4), ("bb", 15, -1.0)]
    model = sentencepiece_lattice.model_of(pieces, 0, 16, "unigram", ())
    score = {p: (i, s) for p, i, s in pieces}

    def best(word):
        ways = {0: (0.0, [])}
        for e in range(1, len(word) + 1):
            ways[e] = max((ways[s][0] + score[word[s:e]][1], ways[s][1] + [score[word[s:e]][0]]) for s in range(e) if s in ways and word[s:e] in score)
        return ways[len(word)][0]

    draw = random.Random(4)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(1, 12))) for _ in range(60)})
    by_id = {i: s for _, i, s in pieces}
    for r in sentencepiece_lattice.encode_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), model).collect():
        assert sum(by_id[i] for i in r.ids) == pytest.approx(best(r.word))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(9)
    clean = [" ".join(draw.choice(["tree", "house", "river", "cloud", "stone", "grass", "light"]) + str(draw.randrange(50)) for _ in range(60)) for _ in range(60)]
    texts = clean + [c + " nastyword" for c in clean[:12]] + clean[:10] + [c + " tail" for c in clean[10:20]]
    docs = spark.createDataFrame([(i, t, ["en", "fr"][i % 2], f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(60 <= i < 72)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], (80, 70, 60), strict=False):
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns and left.count() == want, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 20 < len(out) <= 60 and all(r.round_trip for r in out)
