"""Graphs, HTML tables, sentence gates, and operators that no other test names."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import extract, ids, text, vectors
from tidemill.operators import catalog, conversations, graphs, retrieval
from tidemill.plans import dag
from tidemill.sources import files, html_tables


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_depths_of_a_graph(spark):
    rng = random.Random(1)
    needs = {f"t{i}": [f"t{j}" for j in rng.sample(range(i), min(i, rng.randint(0, 3)))] for i in range(40)}
    edges = [(t, n) for t, of in needs.items() for n in of]
    tasks = spark.createDataFrame([(t,) for t in needs] + [("alone",), (None,)], "id string")
    got = graphs.depths(spark.createDataFrame(edges + edges[:5] + [("t1", None)], "id string, needs string"), tasks)
    assert {r["id"]: r["depth"] for r in got.collect()} == dag.depths(needs) | {"alone": 0}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("e", "f")], "id string, needs string")
    with pytest.raises(dag.CycleError):
        graphs.depths(loop)
    assert {r["id"]: r["depth"] for r in graphs.depths(loop, cyclic="null").collect()} == {"f": 0, "e": 1, "a": None, "b": None, "c": None, "d": None}
    assert graphs.depths(loop.limit(0)).count() == 0


def test_html_tables(spark):
    assert html_tables.laid_out(["<td>a<td rowspan=2>b<td>c", "<td>d</td><td colspan=2>e", "<th>f"]) == [
        [("a", False), ("b", False), ("c", False), None],
        [("d", False), ("b", False), ("e", False), ("e", False)],
        [("f", True), None, None, None],
    ]
    assert html_tables.laid_out(["<td rowspan=0>a<td colspan=0>b", "<td colspan='2'>c", ""]) == [[("a", False), ("b", False), None], [("a", False), ("c", False), ("c", False)], [("a", False), None, None]]
    page = "x <TABLE id=1><tr><th>k</th><th>v &amp; w</th></tr>\n<tr><td> 1\n 2</td><td><i>z</i></td></tr></TABLE> <table></table><table><tr><td>only</table>"
    got = html_tables.table_rows(spark.createDataFrame([(1, page), (2, None), (3, "no table")], "page_id long, html string"))
    assert [tuple(r) for r in got.orderBy("table_no", "row_no").collect()] == [(1, 0, 0, ["k", "v & w"], True), (1, 0, 1, ["1 2", "z"], False), (1, 2, 0, ["only"], False)]
    rows = got.select(F.concat_ws("-", "page_id", "table_no").alias("table_id"), "row_no", "cells")
    assert files.split_tables(rows).where("table_id = '1-0'").count() == 2


def test_sentence_gates(spark):
    body = "# Kết quả\n\nDoanh thu 1.500.000 đồng [3]. Tài liệu không đề cập chi phí. Lãi 2,5 tỷ năm 2024.\n1. Có 12 người. Có 99 người.\n---\n\n\n\n## Trống\n## Cuối\n- Chỉ 77."
    got = one(spark, extract.gated(F.lit(body), F.lit("doanh thu 1500000; năm 2024: 12 người")))
    assert got["text"] == "# Kết quả\n\nDoanh thu 1.500.000 đồng [3]. Lãi 2,5 tỷ năm 2024.\n1. Có 12 người.\n\n## Cuối"
    assert got["meta"] == ["Tài liệu không đề cập chi phí."] and got["unverified"] == ["Có 99 người.", "Chỉ 77."]
    assert one(spark, extract.gated(F.lit(None).cast("string"), F.lit("x"))) is None
    assert one(spark, extract.gated(F.lit("Có 12."), F.lit(None).cast("string")))["text"] == ""
    assert one(spark, extract.gated(F.lit("Xem doc-1a2b. Được."), F.lit("")))["text"] == "Được."


def test_numbers_as_they_are_written(spark):
    values = lambda t: sorted(map(int, one(spark, extract.number_values(F.lit(t)))))
    assert values("1.234.567 và 1,5 hay 13/4/2026") == [1, 4, 5, 13, 2026, 1234567]
    assert values("12345.678") == [12345678] and values("") == []


def test_invalid_pattern_matches_nothing(spark):
    assert not one(spark, text.trigger_matches(F.lit("a(b"), "/a(b/")) and one(spark, text.trigger_matches(F.lit("a(b"), r"/a\(b/"))


def test_operators_without_a_query(spark):
    assert one(spark, text.escape_boundary(F.lit("<a & b>"))) == "&lt;a &amp; b&gt;"
    assert one(spark, vectors.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, ids.without_empty(F.create_map(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("x")))) == {"b": "x"}
    entities = "array<struct<kind:string,name:string,name_norm:string>>"
    profiles = spark.createDataFrame([("d2", [("signer", "Án", "an"), ("party", "Bê", "be")]), ("d1", [("issuer", "AN", "an"), ("signer", "", " ")]), ("d3", None)], f"document_id string, entities {entities}")
    assert [tuple(r) for r in catalog.known_names(profiles).collect()] == [("an", "AN", 2)]
    docs = spark.createDataFrame([("x", "80/QĐ-A", None), (None, None, "s")], "title string, number string, about string")
    assert [r["completeness"] for r in catalog.profile_of(docs, F.col("number"), F.col("about")).collect()] == pytest.approx([2 / 3, 1 / 3])
    verdicts = spark.createDataFrame([(1, "SUFFICIENT", 20, "NONE"), (2, "PARTIAL", 20, "NONE"), (3, "NONE", 95, "PARENT")], "query_id int, status string, k int, expansion string")
    assert [tuple(r) for r in retrieval.retry_queries(verdicts, 1).orderBy("query_id").collect()] == [(2, "PARTIAL", 30, "PARENT"), (3, "NONE", 100, "PARENT")]
    assert retrieval.retry_queries(verdicts, 2).count() == 0
    people = spark.createDataFrame([(1, "Nguyễn An", ["Án"]), (2, "Trần Bê", [])], "entity_id int, name string, aliases array<string>")
    asked = spark.createDataFrame([("an",), ("TRẦN BÊ",), ("nobody",)], "mention string")
    assert sorted(map(tuple, conversations.alias_lookup(people, asked).collect())) == [("TRẦN BÊ", 2), ("an", 1)]
    versions = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, None)], "logical_document_id string, version_number int, gone boolean")
    active = catalog.activated(versions, deleted="gone")
    assert {(r[0], r[1]): r["is_active"] for r in active.collect()} == {("a", 1): False, ("a", 2): False, ("b", 1): True}


def test_small_tables_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert files.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    assert files.spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3
