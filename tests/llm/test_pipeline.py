"""The pipeline end to end on a small made-up corpus."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    kinds = {"en": "the thing is with ing tion er".split(), "de": "und der schau keit ung ü ß".split()}

    def text(lang, n=60):
        return " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)) + "."

    rows = [(i, text(lang), lang, f"s{i % 3}") for i in range(200) for lang in [rng.choice(["en", "de"])]]
    passage = text("en", 30)
    bad = [(200 + i, " | ".join(text("en").upper().split()) + "!!", "en", "s0") for i in range(40)]
    odd = [(300, rows[5][1], "en", "s1"), (301, rows[6][1] + " end", "en", "s1"), (302, f"{text('en')} {passage} {text('en')}", "en", "s2"), (303, None, "en", None), (304, "12345 678", None, "s0")]
    # half of it in each language
    odd += [(310 + i, f"{text('en', 30)} {text('de', 30)}", None, "s1") for i in range(5)]
    docs = [(*r, len(r[1] or "")) for r in rows + bad + odd]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "benchmark", "packing"]
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert not kept & {*range(200, 240), 300, 301, 302, 303, 304}
    assert len(kept & set(range(310, 315))) <= 1
    assert len(kept & set(range(200))) >= 195


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_tables(spark, tmp_path, name, stage):
    """Repeated ids, nulls, clashing columns, which come out as they went in; and no rows at all."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the and of was in that".split()) + str(rng.randrange(90)) for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en"), (4, "another text of that id", "en"), (None, texts[0], None), (50, None, None), (51, "", "en"), (52, "word " * 30_000, "en")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in ("quality_score", "lang_pred", "lang_score", "contamination", "component_id", "kept", "group", "row")})
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", texts[5])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name != "packing":
        assert out.columns == docs.columns
        assert all(r.quality_score == "quality_score" and r.contamination == "contamination" and r.kept == "kept" for r in got)
        assert {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows}
    if name == "near_duplicates":
        assert [r.doc_id for r in got].count(3) == 1 and [r.doc_id for r in got].count(4) == 2
    if name == "benchmark":
        assert {r.doc_id for r in got} == {r[0] for r in rows} - {5}
