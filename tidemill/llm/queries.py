"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, languages, minhash, neurallm, packing, quality, shards, tokenfile, trie, urlfilter, vectors
from .decontaminate import find_contamination
from .textkit import crc_mod

QUALITY_CUT = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    score = F.col("quality_score")
    return quality.scored(docs, model).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        score.alias("score"),
        F.when(score >= QUALITY_CUT, 1).otherwise(0).alias("predicted"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    spans, items = F.col("contamination.spans"), F.col("contamination.item_ids")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return found.select("doc_id", F.col("contamination.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")).withColumn(
        "contaminated", F.col("n_hit") > 0
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    network = languages.train(docs, ~held_out)
    return languages.identified(docs.select("doc_id", "text"), network).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op6_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    model, words = neurallm.train(docs.where(~held_out))
    return neurallm.score_texts(docs, model, words, held_out=held_out)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, sf_dir, "embeddings"))


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleaved(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokenfile.token_rows(spark, folder)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.turns_of(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(*trie.with_shared_starts(turns))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    chats = chat.formatted_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    turns, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("segments"))
    read = chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.coalesce("error_turn", F.lit(-1)).alias("error_turn"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "error_turn",
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_quality_rules,
        op3_best_fit_packing,
        op4_decontamination,
        op5_language_id,
        op6_neural_lm,
        op7_embedding_dedup,
        op8_stratified_shards,
        op9_token_files,
        op10_minhash_dedup,
        op11_prefix_trie,
        op12_chat_format,
        op13_vector_codes,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_sql() -> str:
    def has(term: str) -> str:
        return rf"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}]){term}($|[^\p{{L}}\p{{N}}])')"

    strict = " OR ".join(has(t) for t, w in urlfilter.TERMS.items() if w >= urlfilter.STRICT)
    soft = " + ".join(f"{has(t)}::int" for t, w in urlfilter.TERMS.items() if w < urlfilter.STRICT)
    rules = ", ".join(f"('{r}', '{v}')" for r, v in urlfilter.RULES.items())
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(url, {_AZ}), '') AS low,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, verdict) AS (VALUES {rules}),
judged AS (
  SELECT *, (SELECT arg_max(r.rule, length(r.rule)) FROM rules r
             WHERE (host = split_part(r.rule, '/', 1) OR ends_with(host, '.' || split_part(r.rule, '/', 1)))
               AND starts_with(path, substr(r.rule, strpos(r.rule, '/')))) AS rule
  FROM parts)
SELECT page_id, host, path, j.rule,
       coalesce((SELECT any_value(r.verdict) FROM rules r WHERE r.rule = j.rule),
                CASE WHEN {strict} OR {soft} >= {urlfilter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j"""


_DECONTAMINATION_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win, least(10, len(w)) AS n
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row_id, i, n, list_slice(w, i, i + n - 1) AS win FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS (SELECT row_id, i, p.n, item_id FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
words AS (SELECT row_id, count(DISTINCT k) AS n_hit FROM hits, unnest(generate_series(i, i + n - 1)) AS t(k) GROUP BY row_id),
items AS (SELECT row_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT row_id, item_id::varchar AS s FROM hits) GROUP BY row_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)"""

_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::double[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
u AS (SELECT * FROM v WHERE list_bool_or([x <> 0 FOR x IN e])),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT g.vec_id, (SELECT count(*) FROM links l WHERE l.a = g.vec_id)::bigint AS n_links, component_id, g.vec_id = component_id AS kept
FROM groups g"""

_MINHASH_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS sh FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, doc_id = component_id AS kept
FROM groups LEFT JOIN n USING (doc_id)"""

_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(generate_series(0::bigint, 255::bigint)) AS i)))"""

_SHARDS_SQL = f"""
WITH {_CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text,
         coalesce(doc_id::varchar, '') AS name FROM documents),
c AS (
  SELECT row_id, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || x)::bigint FOR x IN regexp_extract_all(hex(encode(text)), '..')]),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc_table),
k AS (SELECT d.*, text_crc32, md5('7:' || name || ':' || text_crc32::bigint::varchar) AS key FROM d JOIN c USING (row_id)),
f AS (
  SELECT k.*, (2 * row_number() OVER (PARTITION BY source ORDER BY key, text_crc32) - 1) / (2.0::double * count(*) OVER (PARTITION BY source)) AS fraction
  FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source IS NULL, coalesce(source, ''), key, text_crc32) - 1 AS position, count(*) OVER () AS n FROM f),
q AS (SELECT *, ((8 * (position + 1) - 1) // n)::int AS shard FROM p)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'rows' AS law, shard,
       (position - shard * n // {shards.SHARDS})::bigint AS slot, NULL::int AS grown_shard FROM q"""



def _chat_sql() -> str:
    template = chat.INST
    controls = "|".join(re.escape(c) for c in template.controls())
    extra = lambda c: f"len({c}) + len(regexp_extract_all({c}, '{controls}|\\\\'))"
    markers = " ".join(f"WHEN '{r}' THEN {len(t.open + t.close)}" for r, t in template.roles.items())
    other = f"{len(template.other.open + template.said + template.other.close)} + {extra('role')}"
    loss = ", ".join(f"'{r}'" for r, t in template.roles.items() if t.loss)
    moves = ", ".join(f"('{a}', '{role}', '{b}')" for (a, role), b in template.moves.items())
    ends = ", ".join(f"'{s}'" for s in template.accepting)
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
moves(state, role, next) AS (VALUES {moves}),
run AS (
  SELECT DISTINCT conv_id, 0::bigint AS place, '{template.start}' AS state, NULL::bigint AS error FROM n
  UNION ALL
  SELECT r.conv_id, r.place + 1, coalesce(m.next, '{chat.ERROR}'), coalesce(r.error, CASE WHEN m.next IS NULL THEN r.place END)
  FROM run r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.place = r.place LEFT JOIN moves m ON m.state = r.state AND m.role = n.role),
judged AS (
  SELECT conv_id, coalesce(error, CASE WHEN state NOT IN ({ends}) THEN place END)::int AS error_turn
  FROM run QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
g AS (
  SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role IN ({loss})), '') AS loss,
         sum({extra('text')} + CASE role {markers} ELSE {other} END)::bigint AS formatted_chars
  FROM n GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, len(loss)::bigint AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, error_turn IS NULL AS valid, coalesce(error_turn, -1)::int AS error_turn
FROM g JOIN judged j ON j.conv_id IS NOT DISTINCT FROM g.conv_id"""


def _codes_sql() -> str:
    """The rounds of integer k-means one after the other: a0 .. a6 assign, b1 .. b6 move."""
    width = "(SELECT max(len(i)) FROM v)"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_id, vec_id, label, [floor({codes.SCALE} * x::double)::bigint FOR x IN embedding] AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
x AS MATERIALIZED (
  SELECT row_id, p, i[p * {width} // {codes.PARTS} + 1 : (p + 1) * {width} // {codes.PARTS}] AS x FROM v, generate_series(0, {codes.PARTS - 1}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row_id - 1 AS e, x AS c FROM x WHERE row_id <= {codes.ENTRIES})"""
    ]
    far = "list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    for r in range(codes.ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT row_id, p, any_value(x.x) AS x, min(({far} * 256 + b.e)) % 256 AS e, min({far}) AS d FROM x JOIN b{r} b USING (p) GROUP BY row_id, p)"
        )
        if r < codes.ROUNDS:
            steps.append(
                f"""m{r} AS (
  SELECT p, e, list(s ORDER BY k) AS c FROM (
    SELECT p, e, k, floor(sum(x[k])::double / count(*))::bigint AS s FROM a{r}, generate_series(1, len(x)) AS t(k) GROUP BY p, e, k) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e))"""
            )
    last = codes.ROUNDS
    return f"""
WITH {", ".join(steps)},
c AS (SELECT row_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::bigint AS error FROM a{last} GROUP BY row_id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, codebooks_sha256 FROM v JOIN c USING (row_id), s"""


_TRIE_SQL = f"""
WITH {_CRC_TABLE},
s AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) AS s, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'s': s, 'b': b}} ORDER BY turn NULLS FIRST, s) AS turns FROM s GROUP BY conv_id),
c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ascii((conv_id::varchar)[i])::bigint)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM l, crc_table),
r AS (
  SELECT l.conv_id, list_concat(coalesce(CASE WHEN h > 0 THEN d.turns[1:h] END, []), l.turns[h + 1:]) AS turns
  FROM l JOIN c USING (conv_id) LEFT JOIN l d ON d.conv_id = l.conv_id - l.conv_id % 5),
p AS MATERIALIZED (
  SELECT conv_id, d, md5(array_to_string(list_transform(turns[1:d], lambda x: x.s), ',')) AS node, coalesce(turns[d].b, 0) AS b, d = len(turns) AS ends
  FROM r, unnest(generate_series(0, len(turns))) AS t(d)),
n AS MATERIALIZED (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, string_agg(CASE WHEN ends THEN conv_id::varchar END, ',' ORDER BY conv_id) AS ends
  FROM p GROUP BY node, d),
e AS (SELECT DISTINCT a.node, a.d, b.node AS parent FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d = a.d - 1),
k AS MATERIALIZED (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM e GROUP BY 1, 2),
u AS (
  SELECT a.node, a.d, sum((n.n_convs - 1) * n.b) AS saved, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN k ON k.node = n.node AND k.d = n.d GROUP BY a.node, a.d)
SELECT n.conv_id, n.d::bigint AS depth, q.conv_id AS parent_conv_id, n.n_convs::bigint AS n_convs, coalesce(n_children, 0)::bigint AS n_children,
       n_leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN u USING (node, d) LEFT JOIN k USING (node, d) LEFT JOIN e USING (node, d) LEFT JOIN n q ON q.node = e.parent AND q.d = n.d - 1"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": _url_sql(),
    "op4_decontamination": _DECONTAMINATION_SQL,
    "op7_embedding_dedup": _EMBEDDING_SQL,
    "op8_stratified_shards": _SHARDS_SQL,
    "op10_minhash_dedup": _MINHASH_SQL,
    "op11_prefix_trie": _TRIE_SQL,
    "op12_chat_format": _chat_sql(),
    "op13_vector_codes": _codes_sql(),
}
