"""The numbered queries, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact, kmeans, licenses, merkle, metric_join, minhash, mixing, sentencepiece_lattice, tokens, toxicity, urls
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_and_index(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))[1]


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = toxicity.scored(docs, toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    return marked.select("doc_id", F.round("__severity", 3).alias("severity"), F.col("__grade").alias("grade"), (F.col("__severity") >= toxicity.REJECT).alias("toxic"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = table(spark, sf_dir, "documents"), sentencepiece_lattice.read_model(tokenizer_file("piece_bpe_32k.model"))
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, model), model)
    return back.select("doc_id", "n_chunks", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), (F.xxhash64("__text") == F.col("h")).alias("round_trip"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__p", 4).alias("p"), F.col("__drawn").alias("drawn"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_token_files, op3_toxicity, op4_nearest_vectors, op5_license_scan, op6_exact_dedup, op7_sentencepiece, op8_url_filter, op9_mixing, op10_chat_format, op11_embedding_dedup, op12_centroid_clusters, op13_merkle_manifest)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_minhash_dedup": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
             s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
             e as (select doc_id, unnest(s) as x, len(s) as n from s),
             pair as (select a.doc_id as u, b.doc_id as v, a.n + b.n - count(*) as either, count(*) as n from e a join e b using (x) where a.doc_id < b.doc_id and a.n >= 0.79 * b.n and b.n >= 0.79 * a.n group by u, v, a.n, b.n),
             link as (select u, v from pair where 100 * n >= 80 * either union all select v, u from pair where 100 * n >= 80 * either),
             reach(doc_id, seen) as (select doc_id, doc_id from s union select r.doc_id, link.v from reach r join link on r.seen = link.u)
        select doc_id, len(any_value(s)) as n_shingles, min(seen) as component_id, min(seen) = doc_id as kept from reach join s using (doc_id) group by doc_id""",
    "op6_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
             g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)""",
    "op10_chat_format": r"""
        with t as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
             n as (select *, row_number() over (partition by conv_id order by turn, role, sha256(text)) - 1 as place, count(*) over (partition by conv_id) as n_turns from t),
             pre as (select conv_id, place, n_turns, sha256(string_agg(sha256(role || chr(1) || text), '' order by place) over (partition by conv_id order by place rows unbounded preceding)) as h from n),
             ends as (select place, h, min(conv_id) as conv_id, count(*) as n_logged from pre where place = n_turns - 1 group by place, h),
             stay as (select conv_id, n_logged from ends e where not exists (select 1 from pre p where p.place < p.n_turns - 1 and p.place = e.place and p.h = e.h))
        select n.conv_id, cast(floor(place / 256) as bigint) as part, n_turns, n_logged,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by place) as chat
        from n join stay using (conv_id) group by n.conv_id, floor(place / 256), n_turns, n_logged""",
}


def _license_sql() -> str:
    """Phrases by position over the words; templates by counting common tokens of every run that starts at a template's token."""
    phrases = ", ".join(f"({[*p.split()]!r}, '{label}')" for p, label in licenses.PHRASES)
    sets = licenses.template_sets()
    templates = ", ".join(f"('{label}', {tokens!r}, {need}, {span})" for label, tokens, need, span in sets)
    vocabulary, longest = sorted({w for _, tokens, _, _ in sets for w in tokens}), max(span for *_, span in sets)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
        with d as (select doc_id, {_LOWER} as t from documents),
             w as (select doc_id, regexp_extract_all(t, '{word}') as w from d),
             p(words, label) as (values {phrases}),
             hits as (select doc_id, label, unnest(list_filter(range(len(w) - len(words) + 1), lambda i: w[i + 1 : i + len(words)] = words)) as spot
                      from w, p where len(w) >= len(words) and contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(words, ' ') || ' ')),
             base as (select doc_id, count(*) as n, min(spot) as lo, max(spot) as hi, list(distinct label) as labels from hits group by doc_id),
             tpl(label, words, need, span) as (values {templates}),
             runs as (select doc_id, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains({vocabulary!r}, w[i])), lambda i: w[i : i + {longest} - 1])) as run from w),
             met as (select doc_id, label, len(list_intersect(words, run[1:span])) as c, len(words) as n, need from runs, tpl where list_contains(words, run[1])),
             more as (select doc_id, max(c / n) as best, list(distinct label) as labels from met where c >= need group by doc_id)
        select w.doc_id, len(w.w) as n_words, coalesce(base.n, 0) as n_base, lo as first_word, hi as last_word,
               coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') as labels,
               case when base.n > 0 then 1.0::double else coalesce(best, 0.0::double) end as score
        from w left join base using (doc_id) left join more using (doc_id)"""


ORACLE_SQL["op5_license_scan"] = _license_sql()


#: Steps of both walks in SQL: 5e-12 of the mass is still to come then.
_STEPS = 160


def _url_sql() -> str:
    """Rules by row_number; every step of both walks as a table of its own."""
    rules = ", ".join(map(str, urls.RULES))
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda x: lower(f"coalesce(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '')")
    steps = ", ".join(
        f"""s{i} as materialized (select kind, node, sum(rank) as rank from (
              select r.kind, dst as node, rank * share * {urls.DAMPING} as rank from s{i - 1} r join edges e on r.kind = e.kind and r.node = e.src
              union all select kind, node, seed * {1 - urls.DAMPING} from seeds) group by kind, node)"""
        for i in range(1, _STEPS + 1)
    )
    return rf"""
        with q as (select page_id, html, {host("url")} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
             r(verdict, base, head) as (values {rules}),
             j as (select page_id, host, path, base || head as rule, verdict, row_number() over (partition by page_id order by length(base || head) desc nulls last) as k
                   from q left join r on (host = base or ends_with(host, '.' || base)) and starts_with(path, head)),
             judged as (select * from j where k = 1),
             links as (select host as src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]+|//[^"''\s>]+)', 1)) as t from q where host != ''),
             pairs as (select src, {host("case when starts_with(t, '//') then 'http:' || t else t end")} as dst from links),
             counts as (select src, dst, count(*) as n from pairs where src != dst and dst != '' group by src, dst),
             both_ways as (select 'trust' as kind, src, dst, n from counts union all select 'distrust', dst, src, n from counts),
             edges as (select kind, src, dst, n / sum(n) over (partition by kind, src) as share from both_ways),
             seed_n as (select case when verdict = 'allow' then 'trust' else 'distrust' end as kind, host as node, count(*) as n from judged where rule is not null group by all),
             seeds as (select kind, node, n / sum(n) over (partition by kind) as seed from seed_n),
             s0 as (select kind, node, seed as rank from seeds), {steps},
             hosts as (select node, coalesce(sum(rank) filter (kind = 'trust'), 0) as trust, coalesce(sum(rank) filter (kind = 'distrust'), 0) as distrust from s{_STEPS} group by node)
        select page_id, host, path, rule, coalesce(verdict, case when coalesce(distrust, 0) > coalesce(trust, 0) then 'block' else 'allow' end) as verdict
        from judged left join hosts on host = node"""


ORACLE_SQL["op8_url_filter"] = _url_sql()


ORACLE_SQL["op11_embedding_dedup"] = """
    with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings),
         f as (select * from e where vec_id is not null and len(v) > 0 and len(list_filter(v, lambda x: x != 0)) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
         link as (select a.vec_id as u, b.vec_id as v from f a join f b on a.vec_id != b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.9),
         reach(vec_id, seen) as (select vec_id, vec_id from e union select r.vec_id, link.v from reach r join link on r.seen = link.u),
         n as (select u, count(*) as n from link group by u)
    select vec_id, coalesce(any_value(n.n), 0) as n_links, min(seen) as component_id, min(seen) = vec_id as kept from reach left join n on u = vec_id group by vec_id"""


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """Every assignment and every replacement as a table of its own."""
    squared = "list_sum(list_transform(list_zip(g.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select vec_id, any_value(g.x) as x, min(struct_pack(d := cast({squared} as bigint), j := c.j)) as near from g, c{i} c group by vec_id)")
        if i < rounds:
            steps.append(f"""s{i} as (select near.j as j, place, sum(x[place]) as s, count(*) as n from a{i}, range(1, 65) r(place) group by all),
                c{i + 1} as materialized (select c.j, coalesce(any_value(m.x), any_value(c.x)) as x from c{i} c
                    left join (select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as x from s{i} group by j) m on m.j = c.j group by c.j)""")
    return f"""
        with g as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x from embeddings
                   where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             c0 as (select cast(row_number() over (order by sha256('1:' || vec_id)) - 1 as int) as j, x from g order by sha256('1:' || vec_id) limit {k}),
             {", ".join(steps)},
             per as (select near.j as j, sum(near.d) as s from a{rounds} group by near.j)
        select vec_id, near.j as cluster, near.d as distance, cast(s as bigint) as cluster_inertia, cast(sum(near.d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
        from a{rounds} a join per on per.j = near.j join c{rounds} c on c.j = near.j"""


ORACLE_SQL["op12_centroid_clusters"] = _cluster_sql()


def _merkle_sql(levels: int = 8, top_levels: int = 3) -> str:
    """Levels of the trees one by one; a tree that has come down to one node stays as it is. Enough for 8 ** levels leaves of a group."""
    enc = lambda x: f"coalesce(strlen(cast({x} as varchar)) || ':' || {x}, '-')"
    leaf = lambda text: f"sha256({enc('doc_id')} || {enc('source')} || {enc('lang')} || {enc('n_chars')} || {enc(text)})"
    tables, folds = [], []
    for name, depth in (("t", levels), ("u", top_levels)):
        for i in range(depth):
            tables.append(f"{name}r{i} as materialized (select g, i // 8 as i, list(d order by i) as run, any_value(n) as n from {name}{i} group by g, i // 8)")
            tables.append(f"{name}{i + 1} as (select g, i, case when n = 1 then run[1] else sha256(array_to_string(run, '')) end as d, (n + 7) // 8 as n from {name}r{i})")
            at = f"(({'spot' if name == 't' else 'tree'} // {8**i}) % 8)"
            join = f"join {name}r{i} r on r.g = {'f.tree' if name == 't' else '0'} and r.i = {'f.spot' if name == 't' else 'f.tree'} // {8 ** (i + 1)}"
            last = "f0" if not folds else f"f{len(folds)}"
            folds.append(f"""f{len(folds) + 1} as (select doc_id, tree, spot, leaf, case when n = 1 then cur else sha256(array_to_string(run[:{at}], '') || cur || array_to_string(run[{at} + 2:], '')) end as cur,
                case when n = 1 then proof else proof || array_to_string(run[:{at}], '') || array_to_string(run[{at} + 2:], '') end as proof from {last} f {join})""")
        if name == "t":
            tables.append(f"u0 as materialized (select 0 as g, g as i, d, count(*) over () as n from t{levels})")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 of the id's digits, bit by bit
    bits = "list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda h, b: "
    step = "xor(h, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda y: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)[1]"
    return f"""
        with d as (select doc_id, lang, {leaf("text")} as leaf, case when xor({bits}{step}), 4294967295) % 3 = 0 then {leaf(lowered)} else {leaf("text")} end as start from documents),
             k as (select *, dense_rank() over (order by lang nulls first) - 1 as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as spot, count(*) over (partition by lang) as n from d),
             t0 as materialized (select tree as g, spot as i, leaf as d, n from k),
             {", ".join(tables)},
             f0 as (select doc_id, tree, spot, leaf, start as cur, '' as proof from k),
             {", ".join(folds)}
        select doc_id, leaf, t.d as subroot, u.d as root, sha256(proof) as proof_sha256, cur as folded_root, cur = u.d as verified
        from f{levels + top_levels} f join t{levels} t on t.g = f.tree cross join u{top_levels} u"""


ORACLE_SQL["op13_merkle_manifest"] = _merkle_sql()
