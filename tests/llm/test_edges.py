"""Rows that an operator meets seldom: repeated ids, colliding hashes, odd white space, many blocks, wide leaves."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, languages, minhash, neurallm, packing, quality, shards, storage, textkit, tokenfile, urlfilter, vectors

from .test_operators import contamination_by_hand, frame, sentence, union_find, words


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


TWINS = [thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))]


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_hashes_of_long_words_differ():
    """Two words that any sum of bytes times powers modulo 2**64 takes for one."""
    (_, w), *_ = textkit.batches(pa.array([" ".join(TWINS) + " " + " ".join(t[:1000] for t in TWINS)]), textkit.WORDS_SPACE)
    for seed in (0, 1):
        assert len(set(w.hashes(seed).tolist())) == 4
    assert not set(w.hashes(0).tolist()) & set(w.hashes(1).tolist())


def test_same_bytes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    data[3000:] = data[:3000]
    data[4500] = 100
    eights = textkit.lanes(data)
    for n in (0, 1, 7, 8, 9, 40, 1025, 1600):
        a = rng.integers(0, 1300, 200)
        b = np.where(rng.random(200) < 0.5, a + 3000, a + 1)
        got = textkit.same_bytes(eights, a, b, np.full(200, n))
        assert got.tolist() == [data[i : i + n].tobytes() == data[j : j + n].tobytes() for i, j in zip(a, b, strict=True)]


def test_colliding_words_keep_their_own_ids_and_links(spark, monkeypatch):
    """Also where every hash is the same: bytes are compared."""
    path, tool = tokenizer()
    for hashes in (None, lambda data, start, end, seed=0, eights=None: np.full(len(start), 7, np.uint64)):
        if hashes:
            monkeypatch.setattr(tokenfile, "range_hashes", hashes)
        own = tokenfile.PieceEncoder(path)
        for texts in ([*TWINS, "a bc de"], ["de bc " + TWINS[1], TWINS[0] + " bc"]):
            for _, data, offsets in textkit.runs(pa.array(texts)):
                ids, bounds = own.encode(data, offsets)
                assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.undo()
    rows = [(i, " ".join([t] * 3)) for i, t in enumerate(TWINS)]
    assert [r.kept for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [True, True]


def test_token_ids_of_any_white_space():
    path, tool = tokenizer()
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    signs = [*"abzAZ019.,!'-_\"<>|", "é", "ß", "à", "漢", "字", "🙂", "ا", "'s", "'ll", "́", "<|endoftext|>", "  ", "\n\n", "²"]
    rng = random.Random(20)
    texts = ["".join(rng.choice(spaces if rng.random() < 0.4 else [" "] if rng.random() < 0.3 else signs) for _ in range(rng.randrange(24))) for _ in range(20_000)]
    texts += ["a \xa0 \xa0", ""]
    got = []
    for _, ids, bounds in tokenfile.encoded(pa.array(texts), path):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_repeated_and_null_ids(spark):
    path, tool = tokenizer()
    rng = random.Random(21)
    rows = [(rng.choice([None, 1, 1, 2, 3]), rng.choice([None, "", sentence(rng, 30), "same text"])) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = tokenfile.token_rows(spark, tokenfile.write_token_files(df, path, file_ids=300)).collect()
    ids = [(i, [*tool.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_one_id_with_several_texts(spark):
    """Each row is linked by its own text."""
    rng = random.Random(22)
    base = [sentence(rng, 61, 3000) for _ in range(3)]
    near = base[0].rsplit(" ", 1)[0] + " end"
    rows = [(1, base[0]), (1, base[1]), (1, base[1]), (5, near), (7, base[1] + " end"), (9, base[2]), (9, base[2]), (9, base[2]), (2, ""), (2, ""), (None, base[0]), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("other", F.monotonically_increasing_id())
    out = minhash.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out) == Counter(
        [(1, 1, True)] * 3 + [(5, 1, False), (7, 1, False)] + [(9, 9, True)] * 3 + [(2, 2, True)] * 2 + [(None, None, True)] * 2
    )
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, base[0]), (1, base[1]), (9, base[2]), (2, ""), (2, ""), (None, base[0]), (None, base[0])])


def test_contamination_in_many_blocks(spark, monkeypatch):
    """String ids, a clashing column, repeated and null documents; one broadcast is alive at a time."""
    rng = random.Random(23)
    items = [(f"i{k}", sentence(rng, 14, 80)) for k in range(12)] + [("i1", "two words"), ("i1", "two words")]
    texts = [f"{sentence(rng, 20, 80)} {items[k][1]} two words {sentence(rng, 5)}" for k in range(6)] + [None, "", sentence(rng, 3000)]
    docs = frame(spark, texts).withColumn("contamination", F.lit("mine"))
    docs = docs.union(docs.where("doc_id = 2")).union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame(items, "item_id string, text string")
    alive, most, made = set(), [0], [0]
    first, last = decontaminate._indexed, None
    from pyspark.core.broadcast import Broadcast

    destroy = Broadcast.destroy

    def indexed(*args):
        out = first(*args)
        alive.add(out.id if hasattr(out, "id") else id(out))
        made[0] += 1
        most[0] = max(most[0], len(alive))
        return out

    monkeypatch.setattr(decontaminate, "_indexed", indexed)
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: (alive.discard(self.id if hasattr(self, "id") else id(self)), destroy(self, blocking))[1])
    by_hand = contamination_by_hand(texts, items)
    for block in (7, 100_000):
        found = decontaminate.find_contamination(docs, bench, block_windows=block)
        for r in found.collect():
            c = r.contamination
            assert (c.n_words, sum(s.end - s.start for s in c.spans), c.item_ids) == by_hand[1 if r.doc_id is None else r.doc_id]
        assert found.count() == len(texts) + 2
        if block == 7:
            assert made[0] > 5 and most[0] == 1
    clean = decontaminate.decontaminated(docs, bench, block_windows=7)
    assert clean.columns == docs.columns and {r.contamination for r in clean.collect()} == {"mine"}
    assert {r.doc_id for r in clean.collect()} == {i for i, h in enumerate(by_hand) if not h[1]}


def by_cosine(rows, cosine=0.95):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = []
    for at in range(0, len(x), 2000):
        i, j = np.nonzero(x[at : at + 2000] @ x.T >= cosine)
        links += [(a + at, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a + at < b]
    return links


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (4, [0.01, 1.0, 0.0]), (5, [1.0, 0.01, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, 2.0])]
    got = vectors.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter([(1, 1, 1, True)] * 2 + [(4, 1, 1, False), (5, 1, 1, False), (5, 1, 5, True), (6, 1, 5, False)])


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 40, "cell_rows": 300, "sample": 2000}])
def test_vectors_through_real_trees(spark, options):
    """Many vectors with planted links, a cluster that no split divides, against brute force."""
    rng = np.random.default_rng(24)
    n = 22_000 if not options else 9000
    base = rng.normal(size=(n, 32))
    twin = base[: n // 10] + rng.normal(0, 0.06, (n // 10, 32))
    dense = rng.normal(size=32) + rng.normal(0, 0.05, (700 if options else 300, 32))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.concatenate([base, twin, dense]).astype(np.float32))]
    links = by_cosine(rows)
    degree, groups = Counter(v for pair in links for v in pair), union_find(links, range(len(rows)))
    got = vectors.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **options).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.98 * 2 * len(links) and len(links) > n // 20
    assert all(r.n_links <= degree[r.vec_id] for r in got)
    assert sum(r.component_id == groups[r.vec_id] for r in got) >= 0.99 * len(rows)


def test_hot_id_is_packed_in_many_groups(spark):
    rows = [(None, "same text of six words here", "s")] * 400 + [(i, f"text {i}", "s") for i in range(40)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=32, capacity=64).collect()
    assert len(out) == len(rows)
    sizes = Counter(r.bin_id.split("-")[1] for r in out)
    assert max(sizes.values()) < 120
    assert all(n == 1 for n in Counter(r.bin_id for r in out if r.doc_id is None).values())


def test_shards_of_null_ids(spark):
    rows = [(None, f"text {i}", None) for i in range(300)] + [(None, "same", "s")] * 20
    out = shards.interleaved(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket_rows=8).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [40] * 8
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(40)) for s in range(8))


def test_urls_of_any_length(spark):
    long = "http://ok.com/" + "a/" * 200_000
    df = spark.createDataFrame([(long, "old", 1), (long + "?x=casino", "old", 2)], "url string, verdict string, rule int")
    out = urlfilter.judge_urls(df).collect()
    assert [(r.verdict, r.rule) for r in out] == [("allow", None), ("block", None)]
    terms = urlfilter.vocabulary(spark.createDataFrame([("Foo", 2), ("foo", 1), ("bar", None), (None, 2), ("", 2)], "term string, weight int"))
    assert terms == {"foo": 2, "bar": 1}
    asked = spark.createDataFrame([("http://a.com/FOO",), ("http://a.com/bar",), ("http://a.com/casino",)], "url string")
    assert [r.verdict for r in urlfilter.judge_urls(asked, terms=terms).collect()] == ["block", "allow", "allow"]


def test_awkward_input_of_the_learned_operators(spark, monkeypatch):
    monkeypatch.setattr(neurallm, "STEPS", 100)
    rng = random.Random(25)
    texts = [sentence(rng, 30) for _ in range(60)] + [None, "", "word " * 60_000]
    docs = frame(spark, texts, lang={i: "ab"[i % 2] for i in range(60)}).withColumns({"quality_score": F.lit("q"), "lang_pred": F.lit("p"), "lang_score": F.lit("s")})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, F.lit(True))
    assert quality.scored(docs.limit(0), model).count() == 0
    assert all(0 <= r.quality_score <= 1 for r in quality.scored(docs, model).collect())
    assert quality.train(docs.limit(0), labels, F.lit(True)).rules == ()
    network = languages.train(docs, F.col("doc_id") < 60)
    rows = languages.identified(docs, network).collect()
    assert len(rows) == len(texts) and {r.lang_pred for r in rows} == {"a", "b", "und"}
    assert languages.identified(docs.limit(0), network).count() == 0 and languages.train(docs.limit(0), F.lit(True)) is None
    # of equal probabilities the first language wins
    network.v[:], network.b[:] = 0, 0
    assert {(r.lang_pred, r.lang_score) for r in languages.identified(docs.where("doc_id < 60"), network).collect()} == {("a", 0.5)}
    some = docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    fitted, table = neurallm.train(some)
    scores = neurallm.score_texts(some, fitted, table).collect()
    assert len(scores) == len(texts) + 2
    own = {r.doc_id: r for r in scores}
    assert own[None].score == pytest.approx(own[2].score, abs=1e-3) and own[62].n_tokens == 60_001
    assert own[0].train_tokens == sum(len(words(t)) + 1 for t in texts) + 2 * 31


def test_shared_folder_is_named_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        storage.shared_dir(Session)


def test_bins_hold_two_pieces_of_a_source(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10)), "abc"[i % 3]) for i in range(60)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=100, group_rows=16).collect()
    held: dict[tuple[str, str], int] = {}
    for r in out:
        key = (r["bin_id"], "abc"[r["doc_id"] % 3])
        held[key] = held.get(key, 0) + 1
    assert sum(held.values()) == 60 and max(held.values()) == packing.PER_SOURCE
