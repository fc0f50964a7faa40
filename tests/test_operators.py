"""Retrieval, chunking, catalog and streaming against literal expectations."""

from __future__ import annotations

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill import catalog_queries
from tidemill.functions import text, vectors
from tidemill.operators import catalog, chunking, conversations, retrieval, sizes, telemetry
from tidemill.sources import files
from tidemill.streaming import jobs


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_fusion_keeps_dense_order_on_ties(spark):
    d = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 2)], "query_id int, chunk_id string, document_id string, dense_rank int")
    s = spark.createDataFrame([(1, "c", "y", 1), (1, "b", "x", 2)], "query_id int, chunk_id string, document_id string, sparse_rank int")
    out = retrieval.fuse(d, s).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["b", "a", "c"]
    assert out[0].fusion_score == pytest.approx(2 / 62)


def test_diversity(spark):
    c = spark.createDataFrame([(1, "a", "d1", "Same  text", 1), (1, "b", "d2", "same text ", 2), (1, "c", "d1", "other", 3), (1, "d", "d1", "third", 4), (1, "e", "d1", "  ", 5), (1, "a", "d1", "again", 6)], "query_id int, chunk_id string, document_id string, content_raw string, rank int")
    assert [r.chunk_id for r in retrieval.diversify(c, cap=2).orderBy("rank").collect()] == ["a", "c"]
    assert [r.chunk_id for r in retrieval.diversify(c).orderBy("rank").collect()] == ["a", "c", "d"]


def test_packing_skips_and_goes_on(spark):
    u = spark.createDataFrame([(1, i, f"u{i}", t) for i, t in enumerate([50, 60, 30, 40])], "query_id int, unit_rank int, unit_id string, tokens int")
    r = retrieval.pack(u, 100).first()
    assert (r.total_tokens, r.kept, r.dropped) == (80, ["u0", "u2"], 2)


def test_parent_priority_and_missing_parent(spark):
    hits = [(1, "c1", "p1", "d", 0.50, 1), (1, "c2", "p2", "d", 0.45, 2), (1, "c3", "p2", "d", 0.40, 3), (1, "c4", None, "d", 0.52, 4), (1, "c5", "gone", "d", 0.10, 5)]
    h = spark.createDataFrame(hits, "query_id int, chunk_id string, parent_id string, document_id string, score double, rank int")
    out = retrieval.expand_parents(h, spark.createDataFrame([("p1",), ("p2",)], "parent_id string")).orderBy("unit_rank").collect()
    assert [(r.kind, r.unit_id, r.chunk_id) for r in out] == [("PARENT", "p2", "c2"), ("CHILD", "c4", "c4"), ("PARENT", "p1", "c1"), ("CHILD", "c5", "c5")]


def test_neighbours_go_by_index(spark):
    chunks = spark.createDataFrame([(f"c{i}", "p", i, f"t{i}") for i in (0, 1, 2, 4, 5, 9)], "chunk_id string, parent_id string, chunk_index int, content_raw string")
    hits = spark.createDataFrame([(1, "c1", "p", 0.9, 1), (1, "c5", "p", 0.8, 2)], "query_id int, chunk_id string, parent_id string, score double, rank int")
    out = retrieval.expand_neighbours(hits, chunks).first()
    assert out.chunk_ids == ["c0", "c1", "c2", "c4", "c5"] and out.text == "t0\n\nt1\n\nt2\n\nt4\n\nt5"


def test_sparse_queries(spark):
    docs = spark.createDataFrame([("a", "d", "The quick brown fox"), ("b", "d", "quick the brown dog"), ("c", "d", "Brown quick FOX jumps")], "chunk_id string, document_id string, content_raw string")
    q = spark.createDataFrame([(1, ["quick"], [["brown", "fox"]], [], []), (2, [], [], ["dog", "jumps"], ["fox"])], "query_id int, terms array<string>, phrases array<array<string>>, any_of array<string>, none_of array<string>")
    out = retrieval.sparse(q, retrieval.postings(docs))
    assert [(r.query_id, r.chunk_id) for r in out.orderBy("query_id", "sparse_rank").collect()] == [(1, "a"), (2, "b")]


def test_dense_in_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(9)], "chunk_id int, document_id int, embedding array<double>")
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "query_id int, vector array<double>")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert rows(retrieval.dense(q, chunks, 1).select("query_id", "chunk_id"), "query_id") == [(i, i) for i in range(9)]


def test_sparse_counts_plain_queries_by_chunks(spark):
    """Queries of any_of alone: 0.1 for each place to the last digit, ties by chunk, equal queries alike, none without a term."""
    docs = [("b", "x " * 60_000 + "y"), ("a", "x " * 60_000 + "y"), *((f"d{i:02d}", "y " * (i % 3 + 1) + "z") for i in range(30)), ("n", "x")]
    chunks = spark.createDataFrame([(c, "doc", t) for c, t in docs], "chunk_id string, document_id string, content_raw string").repartition(3)
    q = spark.createDataFrame(
        [(1, [], [], ["x"], []), (2, [], [], ["x"], []), (3, [], [], ["y", "z", "y"], ["x"]), (4, [], [], ["absent"], []), (5, [], [], [], ["x"]), (6, ["z"], [], ["y"], []), (7, [], [], None, [])],
        "query_id int, terms array<string>, phrases array<array<string>>, any_of array<string>, none_of array<string>",
    )
    got = retrieval.sparse(q, retrieval.postings(chunks), 3).select("query_id", "chunk_id", "score", "sparse_rank")
    x = [("a", 6000.0, 1), ("b", 6000.0, 2), ("n", 0.1, 3)]
    y = [(f"d{i:02d}", 0.4, n + 1) for n, i in enumerate((2, 5, 8))]
    assert rows(got.where("query_id <> 6"), "query_id", "sparse_rank") == [*((1, *r) for r in x), *((2, *r) for r in x), *((3, *r) for r in y)]
    assert rows(got.where("query_id = 6").select("chunk_id"), "chunk_id") == [("d00",), ("d01",), ("d02",)]


def _pair_by_pair(q, chunks, k):
    own = q.select("query_id", "vector", vectors.norm("vector").alias("query_norm"))
    pairs = retrieval._all_pairs(own, chunks.select("chunk_id", "document_id", "embedding", vectors.norm("embedding").alias("chunk_norm")))
    return retrieval.best(pairs, "score", "dense_rank", k)


@pytest.mark.parametrize("block,k", [(1000, 200), (1, 7)])
def test_dense_is_exact_on_odd_vectors_and_ties(spark, monkeypatch, block, k):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "WIDEST", 30)
    nan, inf = float("nan"), float("inf")
    some = [[float((i * j * 7919) % 13 - 6) for j in range(1, 7)] for i in range(1, 60)]
    odd = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [nan] + [1.0] * 5, [inf] + [1.0] * 5, [1.0, 2.0], [3.0, 4.0], [1e-160] * 6, [1e200] * 6]
    rows_ = [(f"c{i * 37 % 127:03d}", i, v) for i, v in enumerate([*some, *odd, *some[:20], *[some[3]] * 30])]
    chunks = spark.createDataFrame(rows_, "chunk_id string, document_id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, v) for i, v in enumerate([*some[::6], *odd, *some[::6]])], "query_id int, vector array<double>")
    both = [sorted(map(repr, (r[:] for r in x.select("query_id", "chunk_id", "document_id", "score", "dense_rank").collect()))) for x in (retrieval.dense(q, chunks, k), _pair_by_pair(q, chunks, k))]
    assert both[0] == both[1]


def test_dense_measures_few_pairs_by_expressions(spark):
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.array(*(F.sin((F.col("id") + 1) * (i + 1)) for i in range(8))).alias("embedding"))
    q = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = retrieval.dense(q, chunks, 3)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out.select("query_id", "chunk_id", "score", "dense_rank"), "query_id", "dense_rank") == rows(_pair_by_pair(q, chunks, 3).select("query_id", "chunk_id", "score", "dense_rank"), "query_id", "dense_rank")


MARKDOWN = "# A\n\nintro\n\n## B\n- one\n- two\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n```\ncode # not a heading\n\nmore\n```\n# C\nend"


def test_markdown_nodes():
    got = [(n.kind, n.path) for n in chunking.parse_markdown(MARKDOWN)]
    assert got == [("HEADING", ("A",)), ("PARAGRAPH", ("A",)), ("HEADING", ("A", "B")), ("LIST", ("A", "B")), ("TABLE", ("A", "B")), ("CODE", ("A", "B")), ("HEADING", ("C",)), ("PARAGRAPH", ("C",))]


def test_chunks_stay_within_their_sizes():
    text = "# T\n\n" + "\n\n".join(" ".join(f"word{i}" for i in range(n)) + "." for n in (10, 900, 3, 5000, 40)) + "\n\n" + "x" * 30000
    parents = chunking.parents_of(chunking.parse_markdown(text))
    assert all(chunking.tokens(p.text) <= chunking.PARENT_MOST + 5 for p in parents)
    children = [c for p in parents for c in chunking.children_of(p)]
    assert all(chunking.tokens(c.text) <= chunking.CHILD_MOST for c in children)
    assert sum(c.text.count("w") for c in children) == text.count("w")  # a hard cut may part a word
    assert sum(c.text.count("x") for c in children) == 30000


def test_large_tables_repeat_their_header():
    rows_ = [f"| {i} | {'y' * 200} |" for i in range(40)] + ["| big | " + "z" * 5000 + " |"]
    parts = chunking.table_rows("\n".join(["| a | b |", "|---|---|", *rows_]))
    assert all(p.startswith("| a | b |\n|---|---|\n") for p in parts)
    assert sum(p.count("\n") - 1 for p in parts) == 41
    assert parts[-1].count("\n") == 2


def test_chunk_table(spark):
    df = spark.createDataFrame([("d", MARKDOWN), ("e", None), ("f", "")], "document_id string, text string")
    out = chunking.chunks(df)
    assert out.where("error is not null").count() == 0
    ids = {r.chunk_id for r in out.where("hierarchy_level = 0").collect()}
    assert {r.parent_id for r in out.where("hierarchy_level = 1").collect()} <= ids and out.where("document_id <> 'd'").count() == 0


def test_metadata_and_visibility(spark):
    docs = spark.createDataFrame([("1", None, True, "b"), ("2", "me", True, "a"), ("3", "you", True, "c"), ("4", None, False, "d")], "document_id string, user_id string, is_active boolean, title string")
    prof = spark.createDataFrame([(str(i), None, "contract", "x", "n", "N", datetime.date(2024, i, 1) if i < 4 else None, "", "") for i in range(1, 5)], "document_id string, title string, doc_category string, doc_subtype string, doc_number string, doc_number_norm string, doc_date date, issuer_norm string, entity_names_norm string")
    ask = lambda who, **k: [r[0] for r in catalog.query_metadata(docs, prof, catalog.MetadataFilter(**k), who).collect()]
    assert ask("me") == ["2", "1"] and ask(None) == ["1"] and ask("me", operation="latest") == ["2"] and ask("me", operation="count") == [2]


def test_tool_paths(spark):
    runs = spark.createDataFrame([(i, "s") for i in range(60)], "run_id int, skill string")
    calls = spark.createDataFrame([(i, t, n) for i in range(60) for n, t in enumerate(["read", "write"] if i else ["write"])], "run_id int, tool_name string, executed_at int")
    r = telemetry.tool_paths(runs, calls).first()
    assert (r.path, r.of_path, r.runs) == (["read", "write"], 59, 60)
    assert telemetry.tool_paths(runs.limit(20), calls).count() == 0


def test_classifier(spark):
    docs = spark.createDataFrame([("1", "quyet dinh khen thuong", "qd.pdf", "dieu 1"), ("2", "bao cao", "x.pdf", "tong ket")], "document_id string, title string, filename string, body string")
    rules = spark.createDataFrame([("decision", "title", "quyet dinh", 0), ("decision", "filename", "qd", 0), ("decision", "marker", "dieu", 0), ("report", "title", "bao cao", 1), ("report", "marker", "khen", 0)], "category string, kind string, pattern string, position int")
    assert rows(telemetry.classify(docs, rules).select("document_id", "category", F.round("score", 2)), "document_id") == [("1", "decision", 5.2), ("2", "report", 2.94)]


def test_mail_and_dictionary(spark):
    m = spark.createDataFrame([("Job alert: OTP",), ("Mã OTP của bạn",), ("Daily digest",), ("Hi",)], "s string")
    assert [r[0] for r in m.select(conversations.mail_bucket("s")).collect()] == ["work", "critical", "news", "other"]
    t = spark.createDataFrame([("1", "Ông Nguyễn Văn A gặp Văn B")], "text_id string, text string")
    names = spark.createDataFrame([("nguyen van a",), ("van a",), ("van b",), ("van",)], "name string")
    assert rows(conversations.dictionary_matches(t, names).select("name"), "name") == [("nguyen van a",), ("van b",)]


def test_document_kinds(spark):
    cases = [("a.PDF", "", b"%PDF-1.4", "PDF"), ("x", "", b"plain", None), ("x.md", "", b"# t", "MARKDOWN"), ("x.docx", "", b"PK\x03\x04", "DOCX"), ("x.xlsx", "", b"PK\x03\x04", "XLSX"), ("x", "", b"PK\x03\x04", None), ("x.md", "", b"\x00\x01", "MARKDOWN"), ("x.zip", "application/pdf", b"%PDF", "PDF")]
    df = spark.createDataFrame([c[:3] for c in cases], "n string, m string, c binary")
    assert [r[0] for r in df.select(files.document_kind("n", "m", "c")).collect()] == [c[3] for c in cases]


def test_corpus_and_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# hi")
    (tmp_path / "in/b.txt").write_text("no")
    corpus = files.read_corpus(spark, str(tmp_path / "in"))
    assert [(r.kind, bytes(r.content)) for r in corpus.collect()] == [("MARKDOWN", b"# hi")]
    assert files.changed_files(corpus, corpus).count() == 0
    files.export_markdown(spark.createDataFrame([("d1", "T", "body")], "document_id string, title string, text string"), str(tmp_path / "out"), ["title"])
    [part] = (tmp_path / "out").glob("*.md")
    assert part.read_text() == '---\ntitle: ["T"]\n---\n\nbody'


EVENTS = "user string, ts timestamp, text string"


def _events(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    data = [("u", at + datetime.timedelta(seconds=s), f"Alert number {s}") for s in (0, 10, 20, 30, 950, 960)]
    spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/e")
    return spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/e")


def _collected(stream, tmp_path, mode="append"):
    out = []
    jobs.run_available(stream, f"{tmp_path}/ck", lambda df, _: out.extend(tuple(r) for r in df.collect()), mode)
    return sorted(out)


def test_stream_limits_match_the_batch(spark, tmp_path):
    stream, batch = _events(spark, tmp_path)
    got = _collected(jobs.anchored_limit(stream, "user", "ts", 3, 900), tmp_path)
    assert [r[2:] for r in got] == [(1, True), (2, True), (3, True), (4, False), (1, True), (2, True)]
    assert got == sorted(tuple(r) for r in jobs.anchored_limit_batch(batch, "user", "ts", 3, 900).collect())


def test_stream_rules_once(spark, tmp_path):
    stream, _ = _events(spark, tmp_path)
    rules = spark.createDataFrame([(1, "number ALERT", True, None), (2, "alert missing", True, None), (3, "alert", False, None)], "rule_id int, target string, active boolean, expires_at timestamp")
    hits = jobs.rule_matches(jobs.since(stream, "ts", F.lit("2024-01-01 00:00:15").cast("timestamp")), rules, "text", "ts")
    got = _collected(jobs.once(hits, F.concat_ws(":", F.lit("watch"), "rule_id", "user"), "ts").select("dedup_key"), tmp_path)
    assert got == [("watch:1:u",)]


def test_stream_windows(spark, tmp_path):
    stream, batch = _events(spark, tmp_path)
    want = sorted(tuple(r) for r in jobs.windowed_counts(batch, "ts", ["user"], "10 minutes").collect())
    assert _collected(jobs.windowed_counts(stream, "ts", ["user"], "10 minutes"), tmp_path, "update") == want


def test_queries_grow_with_the_table(spark, tmp_path):
    vectors = {i: [float(i * 7 % 61), float(i % 13) + 1.0, 3.0] for i in range(100)}
    text = {i: f"w{i % 10} v{i % 4}" for i in vectors}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(list(text.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = {q: sorted(round(-cosine(vectors[q], v), 9) for v in vectors.values())[:10] for q in range(0, 100, 20)}
    got = {q: [] for q in want}
    for r in catalog_queries.dense_top_k_all(spark, str(tmp_path)).collect():
        got[r.query_id].append(round(-r.score, 9))
    assert {q: sorted(x) for q, x in got.items()} == want

    def cover(q, c):
        return round(0.1 * sum(w in text[q].split() for w in text[c].split()), 12)

    ranked = {q: sorted((c for c in vectors if cover(q, c)), key=lambda c: (-cover(q, c), c))[:10] for q in want}
    fused = [r for r in catalog_queries.hybrid_fusion_all(spark, str(tmp_path)).collect() if r.sparse_rank]
    assert {q: [r.chunk_id for r in sorted(fused, key=lambda r: r.sparse_rank) if r.query_id == q] for q in want} == ranked


def test_memories_of_all_queries(spark, tmp_path, monkeypatch):
    text = {i: f"w{i % 7} v{i % 5} u{i % 3}" for i in range(100)}
    spark.createDataFrame(list(text.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(text.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for q in range(0, 100, 20):
        hits = {m: len(set(text[q].split()) & set(text[m].split())) for m in text}
        scores = [(round(0.7 * h / 3 + 0.3 * (m % 10) / 10, 9), m) for m, h in hits.items() if h]
        want += [(q, m, s) for s, m in sorted(scores, key=lambda x: (-x[0], x[1]))[:10]]
    monkeypatch.setattr(conversations, "QUERY_BLOCK", 2)
    got = catalog_queries.memory_scores_all(spark, str(tmp_path))
    assert sorted((r.query_id, r.memory_id, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_names_in_every_language(spark, tmp_path):
    docs = [(1, "out of the box", "en"), (2, "The end of the road, the", "de"), (3, "the", None), (4, None, "en"), (5, "nothing", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog_queries.dictionary_matches_all(spark, str(tmp_path))
    assert rows(got, "text_id", "name") == [(1, "of the", 1), (2, "of the", 1), (2, "the", 2), (3, "the", 1)]


def covers_by_hand(words, must, any_of):
    """Each run of positions that has all, and of which no shorter part does, by trying them all."""
    def holds(run):
        return must <= set(run) and (not any_of or bool(any_of & set(run)))

    runs = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if holds(words[i : j + 1])]
    least = [(i, j) for i, j in runs if not any((a, b) != (i, j) and i <= a and b <= j for a, b in runs)]
    asked = must | any_of
    return sum(0.1 / (1 + sum(w not in asked for w in words[i : j + 1])) for i, j in least)


def test_cover_density(spark):
    rng = random.Random(3)
    texts = {i: [rng.choice("abcdefg") for _ in range(rng.randrange(1, 25))] for i in range(60)}
    chunks = spark.createDataFrame([(i, i, " ".join(w)) for i, w in texts.items()], "chunk_id long, document_id long, content_raw string")
    asked = [(1, ["a", "b"], [], [], []), (2, ["a"], [["c", "d"]], [], ["g"]), (3, [], [], ["a", "e"], []), (4, ["b"], [], ["c", "d"], [])]
    queries = spark.createDataFrame(asked, "query_id long, terms array<string>, phrases array<array<string>>, any_of array<string>, none_of array<string>")
    index = retrieval.postings(chunks)
    full = rows(index.select("term", "chunk_id", "positions"), "term", "chunk_id")
    assert full == sorted((t, i, [k for k, w in enumerate(ws) if w == t]) for i, ws in texts.items() for t in set(ws))
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.sparse(queries, index, 1000).collect()}
    want = {}
    for q, terms, phrases, any_of, none in asked:
        must = {*terms, *(w for p in phrases for w in p)}
        for i, ws in texts.items():
            in_row = all(any(ws[k : k + len(p)] == p for k in range(len(ws))) for p in phrases)
            if must <= set(ws) and in_row and not set(none) & set(ws) and (not any_of or set(any_of) & set(ws)):
                want[q, i] = covers_by_hand(ws, must, set(any_of))
    assert got == pytest.approx(want) and len(want) > 40
    few = retrieval.postings(chunks, wanted=retrieval.asked_terms(queries.where("query_id = 3")).select("term"))
    assert {r[0] for r in few.select("term").distinct().collect()} == {"a", "e"}


def test_stored_index(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i, f"w{i % 5} v{i}") for i in range(40)], "chunk_id long, document_id long, content_raw string")
    retrieval.write_index(retrieval.postings(chunks), f"{tmp_path}/index", 8)
    own = retrieval.read_index(spark, f"{tmp_path}/index", ["w1", "v3"], 8)
    assert rows(own.select("term", "chunk_id"), "term", "chunk_id") == [("v3", 3), *(("w1", i) for i in range(1, 40, 5))]
    assert "PartitionFilters: [bucket" in own._jdf.queryExecution().toString().replace("isnotnull(bucket#", "[bucket") or "bucket" in own._jdf.queryExecution().toString()


def test_indexed_percentiles(spark):
    rng = random.Random(4)
    data = {"a": [round(rng.expovariate(1), 3) for _ in range(900)], "b": [1.0] * 40, "c": [5.0], "d": [float(x) for x in rng.sample(range(10_000), 300)]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("e", None)], "k string, v double")
    want = sorted((k, sorted(v)[len(v) // 2], sorted(v)[int(0.95 * len(v))], min(v), max(v)) for k, v in data.items())
    assert rows(telemetry.indexed_percentiles(df, ["k"], "v").select("k", "p50", "p95", "least", "most"), "k") == want


def test_rate_windows_by_hand(spark):
    rng = random.Random(5)
    at = datetime.datetime(2024, 1, 1)
    data = sorted({(f"u{rng.randrange(3)}", at + datetime.timedelta(seconds=rng.randrange(20_000))) for _ in range(400)})
    want, open_ = [], {}
    for user, ts in data:
        start, n = open_.get(user, (None, 0))
        if start is None or (ts - start).total_seconds() >= 900:
            start, n = ts, 0
        open_[user] = (start, n + 1)
        want.append((user, ts, n + 1, n < 5))
    got = jobs.anchored_limit_batch(spark.createDataFrame(data, "user string, ts timestamp"), "user", "ts")
    assert rows(got, "user", "ts") == want


def test_matches_of_many_lengths(spark):
    """The longest first, then the first: by trying all, on texts of few words."""
    rng = random.Random(6)
    names = ["a", "a b", "b c a", "c c", "a a a", "b b c c"]
    texts = {i: [rng.choice("abc") for _ in range(rng.randrange(0, 30))] for i in range(40)}
    want = []
    for i, w in texts.items():
        found = sorted((-len(n.split()), k, n) for n in names for k in range(len(w)) if w[k : k + len(n.split())] == n.split())
        taken = set()
        for n, k, name in found:
            if not taken & set(range(k, k - n)):
                taken |= set(range(k, k - n))
                want.append((i, k, k - n, name))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "text_id int, text string")
    assert rows(conversations.dictionary_matches(df, spark.createDataFrame([(n,) for n in names], "name string")), "text_id", "start") == sorted(want)


def test_sheets_become_nodes(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def sheet(rows_):
        cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in row.items()) + "</row>" for r, row in rows_.items())
        return f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>"

    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="Second" r:id="r2"/><sheet name="First" r:id="r1"/><sheet name="Empty" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="r3" Target="worksheets/sheet3.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet({1: {"A": "alone"}}))
        z.writestr("xl/worksheets/sheet2.xml", sheet({1: {"A": "Report"}, 2: {"A": "k", "C": "v"}, 3: {"A": "x", "C": "1"}, 4: {"A": "y"}, 7: {"B": "note"}, 8: {"B": "more"}}))
        z.writestr("xl/worksheets/sheet3.xml", sheet({1: {"A": "  "}}))
    got = files.xlsx_nodes(spark, str(tmp_path / "t.xlsx")).orderBy("sheet_index", "block", "part").select("sheet", "kind", "text").collect()
    assert [tuple(r) for r in got] == [
        ("Second", "HEADING", "Second"),
        ("Second", "PARAGRAPH", "Report"),
        ("Second", "TABLE", "| k | v |\n|---|---|\n| x | 1 |\n| y |  |"),
        ("Second", "PARAGRAPH", "note\nmore"),
        ("First", "HEADING", "First"),
        ("First", "PARAGRAPH", "alone"),
    ]
    assert files.read_xlsx_table(spark, str(tmp_path / "t.xlsx")).columns[1] == "Report"


def test_tables_are_split_at_headings_and_totals(spark):
    cells = [["n", "v"], ["Part one", ""], ["a", "1"], ["Tổng cộng", "1"], ["b", "2"], ["", "Part two"], ["c", "3"], ["last", ""]]
    df = spark.createDataFrame([("t", i, c) for i, c in enumerate(cells)] + [("s", i, c) for i, c in enumerate(cells[:3])], "table_id string, row_no int, cells array<string>")
    out = files.split_tables(df)
    assert [(r.heading, r.piece) for r in out.where("table_id = 't'").orderBy("row_no").collect()] == [(False, 0), (True, 1), (False, 1), (False, 1), (False, 2), (True, 3), (False, 3), (False, 3)]
    assert {r.piece for r in out.where("table_id = 's'").collect()} == {0}


def test_scope_level_and_policies(spark):
    docs = spark.createDataFrame([("d1", None, True), ("d2", "me", True), ("d3", "you", True), ("d4", None, False)], "document_id string, user_id string, is_active boolean")
    chunks = spark.createDataFrame([(f"{d}-{lv}", d, lv) for d in ("d1", "d2", "d3", "d4") for lv in (0, 1)], "chunk_id string, document_id string, hierarchy_level int")
    ask = lambda *a, **k: [r.chunk_id for r in retrieval.candidates(chunks, docs, *a, **k).orderBy("chunk_id").collect()]
    assert ask("me") == ["d1-1", "d2-1"] and ask(None, level=0) == ["d1-0"]
    assert ask("me", ["d2", "d3"]) == ["d1-1", "d2-1"] and ask("me", ["d2", "d3"], mode="DOCUMENT_SEARCH") == ["d2-1"]
    assert ask("me", docs.where("document_id = 'd1'"), mode="COMPARE_DOCUMENTS") == ["d1-1"] and ask("me", [], mode="DOCUMENT_SEARCH") == []
    hits = spark.createDataFrame([(1, "c1", "d1", 0.2, 2, 0.01), (1, "c2", "d2", 0.9, 1, 0.02)], "query_id int, chunk_id string, document_id string, score double, rank int, fusion_score double")
    assert [(r.unit_id, r.unit_rank) for r in retrieval.unexpanded(hits).orderBy("unit_rank").collect()] == [("c2", 1), ("c1", 2)]
    assert retrieval.documents_used(hits).first().documents == ["d1", "d2"]
    ranked = retrieval.rule_rerank(hits, F.when(F.col("chunk_id") == "c1", 2).otherwise(0), F.lit(False), F.lit(0.1)).orderBy("rule_rank").collect()
    assert [(r.chunk_id, round(r.rule_score, 2)) for r in ranked] == [("c1", 1.04), ("c2", 0.05)]
    cited = spark.createDataFrame([(1, "E1", 1)], "query_id int, label string, number int")
    kept = retrieval.evidence_snapshot(retrieval.unexpanded(hits).withColumn("text", F.col("unit_id")), cited).orderBy("rank").collect()
    assert [(r.label, r.cited, r.citation_number) for r in kept] == [("E1", True, 1), ("E2", False, None)]


def test_rows_of_catalogs(spark):
    t = spark.createDataFrame([("1", "c", "x"), ("2", "n", "y 5"), ("2", "n", "7"), ("1", "other", "z"), ("2", "c", " ")], "document_id string, column string, value string")
    d = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "document_id string, title string")
    assert rows(catalog.filled_table(d, t, {"c": "text", "n": "number"}), "document_id") == [("1", "A", "x", None), ("2", "B", None, "7"), ("3", "C", None, None)]
    rules = spark.createDataFrame([(1, "u", "mail", "Hợp đồng", True), (2, "u", "mail", "Cũ", False)], "rule_id int, user_id string, kind string, target string, active boolean")
    wanted = spark.createDataFrame([("u", "mail", "HOP DONG", True), ("u", "mail", "cũ", True), ("u", "mail", "cu", True), ("v", "mail", "hợp đồng", True)], "user_id string, kind string, target string, active boolean")
    assert catalog.add_watch_rules(rules, wanted).count() == 4
    assert rows(catalog.stop_watch_rules(rules, "u", "dong").select("rule_id", "active"), "rule_id") == [(1, False), (2, False)]
    p = spark.createDataFrame([([("A", "party"), ("B", "signer"), ("C", "signer")],), ([],)], "entities array<struct<name:string,kind:string>>")
    assert [r.signer for r in catalog.first_signer(p).collect()] == ["B", None]
    o = spark.createDataFrame([(None, "1"), (2, None), (2, "0"), (1, "9")], "doc_date int, doc_number string")
    assert [tuple(r) for r in catalog.table_order(o).collect()] == [(1, "9"), (2, "0"), (2, None), (None, "1")]


def test_tasks_events_and_tools(spark):
    m = spark.createDataFrame([("c", i, "tool" if i % 2 else "user", "x" * (3000 if i != 5 else 10)) for i in range(12)], "conversation_id string, turn int, role string, content string")
    out = {r.turn: (r.pruned, r.content) for r in conversations.pruned_tool_results(m).collect()}
    assert [t for t, (p, _) in sorted(out.items()) if p] == [1, 3] and out[1][1] == "[tool result pruned: 3000 characters]"
    tasks = spark.createDataFrame([("Gửi báo cáo", False, 3), ("Báo cáo tuần", True, 1), ("Khác", False, 9)], "title string, done boolean, due int")
    assert [r.title for r in conversations.matching_tasks(tasks, "bao cao a").collect()] == ["Gửi báo cáo"]
    assert [r.title for r in conversations.due_tasks(tasks, F.lit(5)).collect()] == ["Gửi báo cáo"]
    day = datetime.datetime(2024, 5, 1)
    events = spark.createDataFrame([("a", day, None), ("b", day + datetime.timedelta(hours=25), None), ("c", day + datetime.timedelta(hours=9), "cancelled"), ("d", day + datetime.timedelta(hours=23), "ok")], "id string, start timestamp, status string")
    assert [r.id for r in conversations.day_events(events, F.lit(day.date())).collect()] == ["a", "d"]
    own = conversations.owned(m, spark.createDataFrame([("c", "u"), ("x", "v")], "conversation_id string, user_id string"), "conversation_id", "v")
    assert own.count() == 0


def test_reports(spark):
    items = spark.createDataFrame([("x", {"r": 1.0}), ("x", {"r": 0.5, "m": None}), ("y", {"r": 0.0})], "config string, metrics map<string,double>")
    assert rows(telemetry.config_report(items), "config", "metric") == [("x", "m", None, 0), ("x", "r", 0.75, 2), ("y", "r", 0.0, 1)]
    c = spark.createDataFrame([(["a", "b"], "has B only")], "keywords array<string>, content_raw string")
    assert telemetry.simulated_scores(c, F.array(F.lit("a"), F.lit("b"))).select("dense_score", "sparse_score", "hybrid_score").first()[:] == (1.0, 1.0, 1.0)
    gold = spark.createDataFrame([("dev", ["q1", "q2"], ["has q1"], ["Yes"], "well, yes", False, False), ("test", [], [], [], "", True, False)], "split string, gold_quotes array<string>, retrieved array<string>, must_include array<string>, answer string, should_abstain boolean, abstained boolean")
    r = telemetry.gold_scores(gold, "dev").collect()
    assert [(x.quote_hit, x.included, x.abstains) for x in r] == [(0.5, True, True)]


def test_nodes_and_chunks_by_hand(spark):
    """Every word of a text is in one parent and in its children, in order; sizes and pages hold."""
    rng = random.Random(7)
    parts = []
    for i in range(40):
        kind = rng.choice("hpplt\f")
        words = " ".join(f"w{i}x{k}" + rng.choice(["", ".", "!"]) for k in range(rng.randrange(1, 900 if kind == "p" else 30)))
        parts.append({"h": f"# H{i}", "p": words, "l": f"- {words}", "t": "| a | b |\n|---|---|\n" + "\n".join(f"| {w} | 1 |" for w in words.split()), "\f": "\f"}[kind])
    whole = "\n\n".join(parts)
    assert whole.count("\f") > 2
    out = chunking.chunks(spark.createDataFrame([("d", whole)], "document_id string, text string")).collect()
    wanted = [w for p in parts if not p.startswith("#") for w in re.findall(r"w\d+x\d+", p)]
    for level in (0, 1):
        assert [w for r in out if r.hierarchy_level == level for w in re.findall(r"w\d+x\d+", r.content_raw)] == wanted
    page = {w: k for k, p in enumerate(whole.split("\f"), 1) for w in re.findall(r"w\d+x\d+", p)}
    for r in out:
        own = [page[w] for w in re.findall(r"w\d+x\d+", r.content_raw)] or [r.page_start]
        assert r.page_start <= min(own) and max(own) <= r.page_end and (r.hierarchy_level == 1 or (r.page_start, r.page_end) == (min(own), max(own)))
        assert r.token_count <= (chunking.PARENT_MOST + 10 if r.hierarchy_level == 0 else chunking.CHILD_MOST)
    nodes = chunking.nodes(spark.createDataFrame([("d", whole)], "document_id string, text string")).orderBy("node_index").collect()
    assert [r.text for r in nodes if r.kind == "HEADING"] == [p[2:] for p in parts if p.startswith("#")]
    assert [w for r in nodes if r.kind != "HEADING" for w in re.findall(r"w\d+x\d+", r.text)] == wanted


def test_html_against_a_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    rng = random.Random(8)
    pages = []
    for i in range(30):
        body = "".join(rng.choice([f"<p>w{i} a&amp;b</p>", f"<div class='x'>v{k} &lt;ok&gt;</div>", "<br>", "<script>var x = 1 < 2;</script>", "<style>p {}</style>", f"<ul><li>i{k}</li><li><b>j</b>k</li></ul>", "<!-- no -->"]) for k in range(12))
        pages.append(f"<html><head><title>t</title></head><body>{body}</body></html>")
    got = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", text.html_to_text("h").alias("t")).orderBy("i").collect()
    for (_, t), page in zip(got, pages, strict=True):
        plain = Plain()
        plain.feed(page)
        assert "".join(t.split()) == "".join("".join(plain.out).split())


def test_large_catalogs_are_not_broadcast(spark):
    rng = random.Random(8)
    words = ["an", "Än", "ba", "co", "de"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)], "text_id long, text string")
    names = spark.createDataFrame([(n,) for n in ("an ba", "ba", "ba co de", "de an an ba", "co", "zz", "", " ")], "name string")
    small, large = (conversations.dictionary_matches(texts, names, broadcast_bytes=b) for b in (1 << 20, 0))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) != []
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # only matches cross an exchange: neither texts nor their words do
    assert all("ahead" not in line and "word" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    events = spark.createDataFrame([(1, "Báo cáo quý III", 5), (2, "báo", 5), (3, None, 5)], "event_id long, title string, at long")
    rules = spark.createDataFrame([(7, "bao cao", True, None), (8, "BÁO", True, 5), (9, "quy", False, None), (10, "", True, None)], "rule_id long, target string, active boolean, expires_at long")
    for b in (1 << 20, 0):
        assert [(r["event_id"], r["rule_id"]) for r in jobs.rule_matches(events, rules, "title", "at", b).collect()] == [(1, 7)]
    assert sizes.measured_bytes(names.select(F.split("name", " ").alias("w"))) > sizes.measured_bytes(names.limit(0)) == 0


def test_window_places():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted(rng.randint(0, 60) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))]
        want, begins = [], None
        for times in runs:
            begin = n = None
            for t in times:
                if begin is None or t >= begin + 10:
                    begin, n = t, 0
                n += 1
                want.append(n)
            begins = begin
        at = np.concatenate([np.array(r) for r in runs])
        run = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        got, begun = jobs.window_places(at, run, 10)
        assert got.tolist() == want and begun == begins
        cut = rng.randint(1, len(at))
        one, begun = jobs.window_places(at[:cut], run[:cut], 10)
        if cut < len(at):
            goes_on = run[cut] == run[cut - 1]
            two, _ = jobs.window_places(at[cut:], run[cut:], 10, begun if goes_on else None, int(one[-1]))
            assert one.tolist() + two.tolist() == want


def test_an_asked_index_reads_its_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, i, f"w{i % 9} common v{i}") for i in range(200)] + [(900, 900, None), (901, 901, "")], "chunk_id long, document_id long, content_raw string")
    retrieval.write_index(retrieval.postings(docs), f"{tmp_path}/index", 16)
    terms = spark.createDataFrame([("w3",), ("v7",), ("none",), ("w3",)], "term string")
    got = retrieval.asked_of_index(spark, f"{tmp_path}/index", terms, 16)
    want = retrieval.postings(docs).where("term in ('w3', 'v7')")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) != []
    scan = next(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "positions" in line)
    assert "bucket#" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
