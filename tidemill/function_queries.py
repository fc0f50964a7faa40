"""Queries of single functions and small operators over the given tables, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog_queries import CORPUS, corpus, query, read
from .functions import administrative, dates, extract, ids, text, vectors
from .operators import catalog, conversations, retrieval, telemetry
from .sources import files

NL = "chr(10)"


def _s(c: str) -> Column:
    return F.col(c).cast("string")


# texts


@query(f"SELECT o_orderkey AS id, 'a' || {NL} || {NL} || 'b ' || o_orderkey || {NL} || o_orderpriority AS t FROM orders")
def normalised_lines(spark, sf_dir):
    raw = F.concat(F.lit("\u200b  a \t\n\n\n\nb "), _s("o_orderkey"), F.lit("\ufeff \u00a0\n"), F.col("o_orderpriority"), F.lit("  \n "))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.normalise_lines(raw).alias("t"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE rtrim(substr(text, 1, 100)) END AS t FROM documents")
def truncated_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.truncate_tokens("text", 25).alias("t"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, repeat(o_orderkey || ';', (o_orderkey % 9 + 1)::int) AS t FROM orders)
    SELECT id, CASE WHEN strlen(t) <= 11 THEN t ELSE left(t, 6) || {NL} || '... [' || (strlen(t) - 11) || ' bytes omitted] ...' || {NL} || right(t, 5) END AS t FROM o""")
def head_and_tail(spark, sf_dir):
    long = F.repeat(F.concat(_s("o_orderkey"), F.lit(";")), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.head_tail(long, 6, 5).alias("t"))


@query("SELECT doc_id, substr(text, 101, 40) AS t FROM documents")
def text_slices(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.sliced("text", 100, 40).alias("t"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def escaped_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(text.escape_boundary("html"), 256).alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts, string_split(text, chr(10)) AS lines FROM documents),
    t AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> '') AS parts, list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> '') AS lines FROM d)
    SELECT doc_id, CASE WHEN len(parts) > 1 THEN len(parts) ELSE len(lines) END::int AS n, sha256(array_to_string(CASE WHEN len(parts) > 1 THEN parts ELSE lines END, '|')) AS digest FROM t WHERE parts IS NOT NULL""")
def sentence_texts(spark, sf_dir):
    """The sentences themselves, by their digest."""
    cut = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.sentences("text").alias("s"))
    return cut.select("doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query(f"""SELECT o_orderkey AS document_id, f AS field, v AS value FROM orders, (VALUES ('number'), ('recipient')) AS t(f),
    LATERAL (SELECT CASE WHEN f = 'number' THEN o_orderkey || '/QĐ-' || o_orderstatus ELSE 'Kho ' || o_custkey END AS v) AS x WHERE NOT (f = 'recipient' AND o_orderkey % 4 = 0)""")
def labelled_lines(spark, sf_dir):
    """A value behind its label, one on the line after it, and none at the text's end."""
    k = F.col("o_orderkey")
    number = F.concat(F.lit("SỐ : "), k.cast("string"), F.lit("/QĐ-"), F.col("o_orderstatus"), F.lit("\nGhi chú: không\n"))
    body = F.concat(number, F.when(k % 4 == 0, "Kính gửi:").otherwise(F.concat(F.lit("Kính gửi:\n Kho "), _s("o_custkey"), F.lit(" \nSố: khác"))))
    return extract.labelled_values(read(spark, sf_dir, "orders").select(k.alias("document_id"), body.alias("text")), {"so": "number", "kinh gui": "recipient"})


@query("""SELECT o_orderkey AS id, 'Giá [1]' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' và [2]' END || ', rồi [1].' AS t FROM orders""")
def cited_answers(spark, sf_dir):
    k = F.col("o_orderkey")
    label = lambda n: F.concat(F.lit("[E"), n.cast("string"), F.lit("]"))
    answer = F.concat(F.lit("Giá "), label(k), F.when(k % 3 == 0, F.lit(" [E0999999]")).otherwise(F.concat(F.lit(" và "), label(k + 1))), F.lit(", rồi "), label(k), F.lit("."))
    known = F.array(F.concat(F.lit("E"), k.cast("string")), F.concat(F.lit("E"), (k + 1).cast("string")))
    return read(spark, sf_dir, "orders").select(k.alias("id"), extract.renumbered_citations(answer, known).alias("t"))


@query("SELECT o_orderkey AS id, 'Hình 1: a; xem Hình 2' || CASE WHEN o_orderkey % 2 = 0 THEN '. Hình 3' ELSE '' END AS t FROM orders")
def renumbered_figures(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.concat(F.lit("Hình "), k.cast("string"), F.lit(": a; xem hình  7"), F.when(k % 2 == 0, ". HÌNH 1").otherwise(""))
    return read(spark, sf_dir, "orders").select(k.alias("id"), extract.renumbered(raw, "Hình").alias("t"))


@query("SELECT o_orderkey AS id, NOT contains((o_orderkey % 25) || 'QDAB', (o_orderkey % 50) || 'QDAB') AS abstains FROM orders")
def abstentions(spark, sf_dir):
    k = F.col("o_orderkey")
    question = F.concat(F.lit("Văn bản "), (k % 50).cast("string"), F.lit("/QĐ-AB nói gì?"))
    evidence = F.concat(F.lit("Theo "), (k % 25).cast("string"), F.lit("-QĐ/AB"))
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.coalesce(extract.abstains(question, evidence), F.lit(False)).alias("abstains"))


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Bộ Tài chính' WHEN 1 THEN 'Công Ty Kho ' || o_custkey ELSE '' END AS issuer,
      CASE o_orderkey % 4 WHEN 0 THEN 'Về việc giao hàng ' || o_orderkey || ' cho kho' WHEN 1 THEN 'Về việc thu tiền ' || o_custkey WHEN 2 THEN 'Về việc nghỉ lễ' ELSE '' END AS subject,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Nguyễn Thị Hoa' END AS name, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Phó Giám đốc' WHEN 2 THEN 'Thứ trưởng' ELSE 'Chánh Văn phòng' END AS role FROM orders"""
)
def administrative_fields(spark, sf_dir):
    """Issuer, subject and signatory of a letter on each order, in several layouts."""
    k, number = F.col("o_orderkey"), _s("o_orderkey")
    issuer = F.when(k % 3 == 0, "**BỘ TÀI CHÍNH**").when(k % 3 == 1, F.concat(F.lit("CÔNG TY KHO "), _s("o_custkey"))).otherwise("QUYẾT ĐỊNH CỤC THUẾ")
    subject = (
        F.when(k % 4 == 0, F.concat(F.lit("QUYẾT ĐỊNH Về việc giao hàng "), number, F.lit("\ncho kho.\nHà Nội")))
        .when(k % 4 == 1, F.concat(F.lit("V/v: thu tiền "), _s("o_custkey"), F.lit(";")))
        .when(k % 4 == 2, "THÔNG BÁO\nvề việc nghỉ lễ\nCăn cứ Luật")
        .otherwise("Chúng tôi nói về việc khác\nCăn cứ Nghị định về việc phí\nVề việc sai")
    )
    head = F.split(F.concat(issuer, F.lit("\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\n\n"), subject), "\n")
    role = F.when(k % 5 == 0, "Người lập").when(k % 5 == 1, "KT. GIÁM ĐỐC").when(k % 5 == 2, "THỨ TRƯỞNG").otherwise("TL. Chánh văn phòng")
    tail = F.split(F.concat(F.lit("Giám đốc đã duyệt.\n# "), role, F.lit("\n(Đã ký)\nNơi nhận: VT\n  NGUYỄN thị Hoa  \nLưu kho")), "\n")
    tail = F.when(k % 5 == 0, F.slice(tail, 2, 9)).otherwise(tail)
    out = files.spread(read(spark, sf_dir, "orders")).select(k.alias("id"), administrative.issuer(head).alias("issuer"), administrative.subject(head).alias("subject"), administrative.signatory(tail).alias("s"))
    return out.select("id", *(F.coalesce(c, F.lit("")).alias(n) for n, c in (("issuer", F.col("issuer")), ("subject", F.col("subject")), ("name", F.col("s.name")), ("role", F.col("s.role")))))


# fields


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || '>' || o_orderstatus WHEN 1 THEN o_orderpriority ELSE '' END AS path FROM orders")
def heading_paths(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.to_json(F.array("o_orderpriority", "o_orderstatus"))).when(k == 1, F.col("o_orderpriority")).when(k == 2, "  ")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(ids.heading_list(raw), ">").alias("path"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'status' WHEN o_orderkey % 3 = 1 THEN 'priority,status' ELSE 'priority' END AS keys FROM orders")
def full_anchors(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    m = F.create_map(F.lit("status"), F.when(k != 2, F.col("o_orderstatus")), F.lit("priority"), F.when(k == 0, " ").otherwise(F.col("o_orderpriority")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.array_sort(F.map_keys(ids.without_empty(m))), ",").alias("keys"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders")
def first_full_field(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("id"), ids.first_full(F.lit(None).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("  "), F.col("o_orderstatus"))).otherwise(" "), "o_orderpriority").alias("v"))


@query("""SELECT o_orderkey AS message_id, n::int - 1 AS place, 'd' || (o_custkey + n) AS document_id FROM orders, unnest(generate_series(1, o_orderkey % 3)) AS t(n)""")
def cited_documents(spark, sf_dir):
    listed = F.transform(F.sequence(F.lit(1), F.greatest((F.col("o_orderkey") % 3).cast("int"), F.lit(1))), lambda n: F.struct(F.concat(F.lit("d"), (F.col("o_custkey") + n).cast("string")).alias("document_id"), n.alias("page")))
    listed = F.when(F.col("o_orderkey") % 3 > 0, listed)
    meta = F.to_json(F.struct(F.struct(listed.alias("citations"), F.lit(1).alias("v")).alias("data")))
    return conversations.citations_of(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), meta.alias("metadata")))


# times and numbers


@query("SELECT event_id, ts + interval 7 hour AS shown FROM events")
def shown_times(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", dates.in_zone(F.col("ts").cast("timestamp"), "Asia/Ho_Chi_Minh").cast("timestamp_ntz").alias("shown"))


@query("""SELECT event_id, user_id % 3 <> 0 AND hour(ts) * 60 + minute(ts) BETWEEN 480 AND 839 AS due FROM events""")
def due_briefings(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withColumns({"last": F.when(F.col("user_id") % 3 == 0, F.col("at")).when(F.col("user_id") % 3 == 1, F.col("at") - F.expr("interval 1 day")), "start": F.lit(480)})
    return e.select("event_id", dates.briefing_due("start", "last", "at").alias("due"))


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) AS p FROM events")
def logit_shares(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(vectors.sigmoid((F.col("value") - 50) / 10), 9).alias("p"))


# ranked evidence


_HITS = "SELECT l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS document_id, 1.0::double / (60 + l_linenumber) AS fusion_score, l_quantity, l_returnflag, l_discount FROM lineitem"


@query(f"""WITH h AS ({_HITS}), s AS (SELECT *, fusion_score + 0.5::double * (l_quantity % 3) + CASE WHEN l_returnflag = 'R' THEN 0.4::double ELSE 0 END + 0.3::double * l_discount AS s FROM h)
    SELECT query_id, rank, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rule_rank FROM s""")
def rule_reranked(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    hits = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), (F.lit(1.0) / (60 + F.col("l_linenumber"))).alias("fusion_score"), "l_quantity", "l_returnflag", "l_discount")
    out = retrieval.rule_rerank(hits, F.col("l_quantity") % 3, F.col("l_returnflag") == "R", F.col("l_discount"))
    return out.select("query_id", "rank", F.round("rule_score", 9).alias("score"), F.col("rule_rank").cast("long").alias("rule_rank"))


@query("SELECT l_orderkey AS query_id, string_agg(DISTINCT l_partkey::varchar, ',' ORDER BY l_partkey::varchar) AS documents FROM lineitem GROUP BY 1")
def used_documents(spark, sf_dir):
    units = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), _s("l_partkey").alias("document_id"))
    return retrieval.documents_used(units).select("query_id", F.array_join("documents", ",").alias("documents"))


@query("""SELECT l_orderkey AS query_id, 'E' || l_linenumber AS label, l_linenumber AS rank, l_partkey AS document_id, sha256(l_returnflag || l_shipdate::date) AS content_hash,
      l_linenumber % 2 = 1 AS cited, CASE WHEN l_linenumber % 2 = 1 THEN (l_linenumber + 1) // 2 ELSE 0 END::int AS number FROM lineitem""")
def evidence_snapshots(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    units = li.select(F.col("l_orderkey").alias("query_id"), n.alias("unit_rank"), F.lit("PARENT").alias("kind"), _s("l_partkey").alias("unit_id"), F.col("l_partkey").alias("document_id"), F.concat("l_returnflag", F.col("l_shipdate").cast("date").cast("string")).alias("text"))
    cited = li.where(n % 2 == 1).select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("E"), n.cast("string")).alias("label"), F.floor((n + 1) / 2).cast("int").alias("number")).distinct()
    out = retrieval.evidence_snapshot(units, cited)
    return out.select("query_id", "label", "rank", "document_id", "content_hash", "cited", F.coalesce("citation_number", F.lit(0)).alias("number"))


@query("SELECT o_orderkey AS query_id, least(20 + o_orderkey % 90 + 10, 100)::int AS k, 'PARENT' AS expansion FROM orders WHERE o_orderstatus <> 'F'")
def retried_queries(spark, sf_dir):
    k = F.col("o_orderkey")
    verdicts = read(spark, sf_dir, "orders").select(k.alias("query_id"), F.when(F.col("o_orderstatus") == "F", "SUFFICIENT").otherwise("PARTIAL").alias("status"), (20 + k % 90).cast("int").alias("k"), F.lit("NONE").alias("expansion"))
    return retrieval.retry_queries(verdicts, 1).select("query_id", "k", "expansion")


@query("""WITH p AS (SELECT *, string_split(p_name, ' ') AS words, ['red', 'ring', 'none'] AS wanted FROM part),
    s AS (SELECT p_partkey AS chunk_id, len(list_distinct(list_filter(words, lambda w: list_contains(wanted, w)))) / 3 AS dense, len(list_filter(wanted, lambda w: contains(lower(p_type || ' ' || p_name), w))) / 3 AS sparse FROM p)
    SELECT chunk_id, round(dense, 9) AS dense_score, round(sparse, 9) AS sparse_score, round((dense + sparse) / 2, 9) AS hybrid_score FROM s""")
def simulated_rankings(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.split("p_name", " ").alias("keywords"), F.concat_ws(" ", "p_type", "p_name").alias("content_raw"))
    out = telemetry.simulated_scores(p, F.array(*map(F.lit, ("red", "ring", "none"))))
    return out.select("chunk_id", *(F.round(c, 9).alias(c) for c in ("dense_score", "sparse_score", "hybrid_score")))


@query("""WITH m AS (SELECT event_type AS config, 'value' AS metric, value FROM events UNION ALL SELECT event_type, 'odd', CASE WHEN user_id % 2 = 1 THEN value / 2 END FROM events)
    SELECT config, metric, round_even(avg(value), 4) AS mean, count(value) AS measured FROM m GROUP BY 1, 2""")
def config_means(spark, sf_dir):
    odd = F.when(F.col("user_id") % 2 == 1, F.col("value") / 2)
    items = read(spark, sf_dir, "events").select(F.col("event_type").alias("config"), F.create_map(F.lit("value"), F.col("value"), F.lit("odd"), odd).alias("metrics"))
    return telemetry.config_report(items)


# catalog


@query("""WITH e AS (SELECT o_orderkey, 'Cust ' || o_custkey AS name, 'cust ' || o_custkey AS name_norm, o_orderstatus = 'P' AS party FROM orders
      UNION ALL SELECT o_orderkey, o_orderpriority, lower(o_orderpriority), false FROM orders)
    SELECT name_norm, arg_min(name, lpad(o_orderkey::varchar, 9, '0')) AS name, count(DISTINCT o_orderkey) AS n_documents FROM e WHERE NOT party GROUP BY 1""")
def entity_names(spark, sf_dir):
    entity = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"), F.lower(name).alias("name_norm"))
    made = F.array(entity(F.when(F.col("o_orderstatus") == "P", "party").otherwise("signer"), F.concat(F.lit("Cust "), _s("o_custkey"))), entity(F.lit("issuer"), F.col("o_orderpriority")))
    return catalog.known_names(read(spark, sf_dir, "orders").select(F.lpad(_s("o_orderkey"), 9, "0").alias("document_id"), made.alias("entities")))


@query("SELECT l_orderkey AS document_id, coalesce((array_agg('S' || l_suppkey ORDER BY l_linenumber, 'S' || l_suppkey) FILTER (l_returnflag = 'R'))[1], '') AS signer FROM lineitem GROUP BY 1")
def document_signers(spark, sf_dir):
    line = F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", "signer").otherwise("party").alias("kind"), F.concat(F.lit("S"), _s("l_suppkey")).alias("name"))
    profiles = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.sort_array(F.collect_list(line)).alias("entities"))
    return catalog.first_signer(profiles).select("document_id", F.coalesce("signer", F.lit("")).alias("signer"))


@query("""SELECT o_orderkey AS document_id, round(((o_orderkey % 3 <> 0)::int + (o_orderkey % 5 <> 0)::int + 1) / 3, 6) AS completeness FROM orders""")
def profile_completeness(spark, sf_dir):
    k = F.col("o_orderkey")
    number, subject = F.when(k % 3 != 0, F.concat(k.cast("string"), F.lit("/QĐ"))), F.when(k % 5 != 0, F.col("o_orderpriority")).otherwise(" ")
    out = catalog.profile_of(read(spark, sf_dir, "orders").select(k.alias("document_id"), F.col("o_orderstatus").alias("title"), "o_orderkey", "o_orderpriority"), number, subject)
    return out.select("document_id", F.round("completeness", 6).alias("completeness"))


@query(f"""WITH {CORPUS} SELECT document_id, logical_document_id % 4 <> 0 AND version_number = max(version_number) OVER (PARTITION BY logical_document_id) AS is_active FROM corpus""")
def deleted_versions(spark, sf_dir):
    c = corpus(spark, sf_dir).withColumn("gone", F.when(F.col("logical_document_id") % 4 == 0, True))
    return catalog.activated(c, deleted="gone").select("document_id", "is_active")


@query("""WITH l AS (SELECT l_orderkey, min(CASE WHEN trim(l_quantity::int::varchar) <> '' THEN l_quantity::int::varchar END) AS quantity, min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS flag FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS document_id, coalesce(quantity, '') AS quantity, coalesce(flag, '') AS flag FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def filled_tables(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").alias("document_id")
    cells = li.select(key, F.lit("quantity").alias("column"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    cells = cells.union(li.select(key, F.lit("flag"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("  ")))
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    return catalog.filled_table(docs, cells, {"quantity": "number", "flag": "text"}).select("document_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("quantity", "flag")))


# people's own rows


@query("SELECT conv_id AS conversation_id, turn FROM conversations WHERE conv_id % 3 = 1")
def owned_messages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn")
    parents = c.select("conversation_id").distinct().withColumn("user_id", F.concat(F.lit("u"), (F.col("conversation_id") % 3).cast("string")))
    return conversations.owned(c, parents, "conversation_id", "u1")


def _tasks(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("Gọi  KHÁCH "), _s("o_custkey"), F.lit(" "), "o_orderpriority").alias("title"), F.col("o_orderdate").alias("due"), (F.col("o_orderstatus") == "F").alias("done"))


@query("SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= timestamp '1996-01-01'")
def overdue_tasks(spark, sf_dir):
    return conversations.due_tasks(_tasks(spark, sf_dir), F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz")).select("task_id")


@query("SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus <> 'F' AND contains(o_custkey || ' ' || lower(o_orderpriority), '12')")
def matched_tasks(spark, sf_dir):
    return conversations.matching_tasks(_tasks(spark, sf_dir), "khách 12 a").select("task_id")


@query("""WITH r AS (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 2 = 0)
    SELECT user_id, 'mail' AS kind, lower(event_type) AS target, true AS active FROM r UNION ALL
    SELECT DISTINCT user_id, 'mail', lower(event_type), true FROM events e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND r.event_type = e.event_type)""")
def watch_rules_added(spark, sf_dir):
    """Rules that the users of even numbers have already, in other letters, are not added again."""
    e = read(spark, sf_dir, "events").select("user_id", F.lit("mail").alias("kind"), F.col("event_type").alias("target")).distinct()
    held = e.where(F.col("user_id") % 2 == 0).withColumns({"target": F.upper("target"), "active": F.lit(True)})
    out = catalog.add_watch_rules(held, e.withColumn("active", F.lit(True)))
    return out.select("user_id", "kind", F.lower("target").alias("target"), "active")
