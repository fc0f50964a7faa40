"""Operators against plain versions of themselves, with awkward rows among the input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import languages, minhash, neurallm, packing, quality, shards, textkit, tokenfile, urlfilter, vectors
from tidemill.llm.components import components
from tidemill.llm.decontaminate import find_contamination

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, cell string"


def words(text, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, (text or "").translate(AZ))


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts, **columns):
    """Documents with clashing extra columns; None and '' among the texts are kept."""
    rows = [(i, t, columns.get("lang", {}).get(i, "en"), f"s{i % 3}" if i % 5 else None, len(t or ""), "k", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(rng):
    base = sentence(rng, 60)
    out = [None, "", "   \n", "one", "one two three", "One TWO three", base, base.upper(), base, base + " more", sentence(rng, 30_000), "x" * 50_000, "é ñ 漢字 🙂 " * 30, "\x00\x1f odd", "tab\tnew\nline"]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        out.append(" ".join(w))
    return out + [sentence(rng, rng.randrange(5, 80)) for _ in range(60)]


def union_find(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("kind,pattern", [(textkit.WORDS_SPACE, "[^\x20\x09-\x0d]+"), (textkit.WORDS_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words(kind, pattern):
    texts = awkward(random.Random(1))
    got = []
    for _, w in textkit.batches(pa.array(texts).slice(1), kind, step=700):
        hashes = w.hashes()
        for i in range(len(w.bounds) - 1):
            own = [w.word(k).decode() for k in range(w.bounds[i], w.bounds[i + 1])]
            assert len(set(own)) == len(set(hashes[w.bounds[i] : w.bounds[i + 1]].tolist()))
            got.append(own)
    assert got == [words(t, pattern) for t in texts[1:]]
    assert list(textkit.batches(pa.array([], pa.string()), kind)) == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (5, None)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == union_find(real, {x for e in real for x in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_duplicates_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union_find(links, ids).items()}


def test_minhash(spark):
    texts = awkward(random.Random(3))
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == near_duplicates_by_hand(list(enumerate(texts)))
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, (_, c) in got.items() if i == c}


def test_minhash_group_of_diverging_copies(spark):
    """Copies that are near a base but not near each other, and repeated, null and missing rows."""
    rng = random.Random(4)
    base = sentence(rng, 150, 10_000).split()
    texts = [" ".join(base)]
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 8)):
            w[rng.randrange(len(w))] = f"n{i}"
        texts.append(" ".join(w))
    rows = [(i + 1000, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    df = spark.createDataFrame([*rows, rows[0], (None, texts[0])], "doc_id long, text string")
    out = minhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == near_duplicates_by_hand(rows)
    assert len(out) == len(rows) + 2
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def contamination_by_hand(texts, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    item_words = [(i, words(t, pattern)) for i, t in items if i is not None]
    for t in texts:
        w, hit, found = words(t, pattern), set(), set()
        for i, own in item_words:
            n = min(10, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == own[k : k + n]:
                        hit.update(range(at, at + n))
                        found.add(i)
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [3, 100_000])
def test_decontamination(spark, block):
    rng = random.Random(5)
    texts = awkward(rng)[:12] + [sentence(rng, 60, 60) for _ in range(30)]
    texts[10] = sentence(rng, 2000)
    items = [(1, sentence(rng, 25, 60)), (2, "Short One"), (3, "one"), (4, None), (5, " ,,, "), (6, sentence(rng, 10, 60)), (6, "three"), (None, "w1"), (12, texts[6])]
    texts += [f"Lead-in {items[0][1].upper()} end", items[0][1].replace(" ", ", "), " ".join(items[0][1].split()[3:14]), " ".join(items[0][1].split()[:9]), items[5][1] * 2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(frame(spark, texts), bench, block_windows=block).orderBy("doc_id").select("contamination").collect()
    got = [(r[0].n_words, sum(s.end - s.start for s in r[0].spans), r[0].item_ids) for r in found]
    assert got == contamination_by_hand(texts, items)
    assert find_contamination(frame(spark, texts[:3]), bench.limit(0)).where("size(contamination.spans) > 0").count() == 0
    assert find_contamination(frame(spark, texts).limit(0), bench).count() == 0


def test_url_filter(spark):
    cases = {
        "https://a.NET/x": ("a.net", "/x", "net/", "block"),
        "http://x.example.net/en/a?b": ("x.example.net", "/en/a", "example.net/en/", "allow"),
        "http://example.net/english": ("example.net", "/english", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://example.com/de/porn": ("example.com", "/de/porn", "example.com/de/", "block"),
        "http://w.org/fr/xxx": ("w.org", "/fr/xxx", "org/fr/", "allow"),
        "http://ok.com/a-xxx-b": ("ok.com", "/a-xxx-b", None, "block"),
        "http://ok.com/axxxb": ("ok.com", "/axxxb", None, "allow"),
        "http://ok.com/free-bet": ("ok.com", "/free-bet", None, "block"),
        "http://ok.com/free-free": ("ok.com", "/free-free", None, "allow"),
        "http://b.net": ("b.net", "", None, "allow"),
        "http://b.net?q": ("b.net", "", None, "allow"),
        "no scheme casino": ("", "", None, "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u, "old") for u in cases] * 2, "url string, host string")
    got = urlfilter.judge_urls(df).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_shards(spark):
    texts = awkward(random.Random(6))
    df = frame(spark, texts).union(frame(spark, texts[:4]))
    rows = shards.interleaved(df, bucket_rows=7).collect()
    assert len(rows) == len(texts) + 4
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    source = {r.doc_id: r.source for r in df.collect()}
    for name in set(source.values()):
        own = Counter(r.shard for r in rows if source[r.doc_id] == name)
        assert max(own.values()) - min(own.get(s, 0) for s in range(8)) <= 2
    assert shards.interleaved(df.limit(0)).count() == 0
    assert shards.interleaved(df.limit(3)).count() == 3


def test_token_files(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = [*awkward(random.Random(7)), "a<|endoftext|> b\n\n<|endoftext|>", "it's  two   spaces . , !!\n\n x", " lead", "trail "]
    df = frame(spark, texts).withColumn("doc_id", F.col("doc_id") * 3 - 50).repartition(3)
    got = {}
    for limit in (500, 2_000_000):
        folder = tokenfile.write_token_files(df, path, file_ids=limit)
        rows = sorted(tokenfile.token_rows(spark, folder).collect(), key=lambda r: r.doc_id)
        got[limit] = [tuple(r) for r in rows]
    tool, at, want = Tokenizer.from_file(path), 0, []
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i * 3 - 50, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got[500] == got[2_000_000] == want
    none = tokenfile.write_token_files(df.limit(0), path)
    assert tokenfile.token_rows(spark, none).count() == 0


def test_token_blocks():
    rng = np.random.default_rng(8)
    for n in (1, 7, 1000, 1024):
        for top in (1, 2, 300, 50_257, 2**32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[rng.integers(0, n)] = top - 1
            assert (tokenfile.decode_block(memoryview(tokenfile.encode_block(ids)), n) == ids).all()
    ids = rng.integers(0, 50_000, 5000).astype(np.uint32)
    file = tokenfile.TokenFile(tokenfile.encode_file(ids, [(1, 2000, True), (None, 3000, True)], 0, 0))
    assert (file.ids(1500, 2700) == ids[1500:4200]).all()


def test_token_blocks_together():
    """Blocks that are packed together are those that are packed one by one."""
    rng, block = np.random.default_rng(9), tokenfile.BLOCK
    for n in (0, block - 1, block, 3 * block + 5, (tokenfile.TOGETHER + 3) * block + 1):
        for top in (1, 2, 5, 300, 50_257, 2**17, 2**25, 2**31, 2**32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[rng.integers(0, n, n // 60) if n else []] = rng.integers(0, 2**32, n // 60)
            assert tokenfile.encode_blocks(ids) == [tokenfile.encode_block(ids[i : i + block]) for i in range(0, n, block)]
            file = tokenfile.TokenFile(tokenfile.encode_file(ids, [(1, n, True)], 0, 0))
            for at, size in ((0, n), (n // 3, n // 2), (n, 0)):
                assert np.array_equal(file.ids(at, size), ids[at : at + size])


def test_token_files_are_read_once(spark):
    """Documents over a file's edge, and the others, come from one reading of the files."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    rng = random.Random(23)
    df = frame(spark, [sentence(rng, rng.randrange(120)) for _ in range(40)])
    folder = tokenfile.write_token_files(df, path, file_ids=100)
    rows = tokenfile.token_rows(spark, folder)
    assert "binaryFile" not in rows._jdf.queryExecution().executedPlan().toString()
    whole = tokenfile.read_token_files(spark, folder).where("ends and (place > 0 or number = 0)").collect()
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows.collect()}
    assert 0 < len(whole) < len(found) == 40
    assert all(found[r.doc_id] == (len(r.ids) // 4, zlib.crc32(r.ids)) for r in whole)


def best_fit_by_hand(items, capacity, per_source):
    """Every bin is looked at for every item: of the compatible ones the one with the least room, for the longest time."""
    room, inside, out, since = [], [], [], []
    for size, source, cluster in items:
        fit = [b for b in range(len(room)) if room[b] >= size and cluster not in [c for _, c in inside[b]] and sum(s == source for s, _ in inside[b]) < per_source]
        if not fit:
            room.append(capacity)
            inside.append([])
            since.append(0)
            fit = [len(room) - 1]
        least = min(room[b] for b in fit)
        out.append(least - size)
        b = min((b for b in fit if room[b] == least), key=lambda b: since[b])
        room[b] -= size
        since[b] = len(out)
        inside[b].append((source, cluster))
    return out, len(room)


@pytest.mark.parametrize("per_source", [1, 2, 5])
def test_best_fit_is_tightest(per_source):
    rng = random.Random(9)
    items = [(rng.randrange(1, 60), rng.randrange(4), rng.randrange(40)) for _ in range(300)]
    items.sort(key=lambda x: -x[0])
    bins = packing.pack(*map(np.array, zip(*items, strict=True)), capacity=100, per_source=per_source)
    room, left = {}, []
    for (size, source, cluster), b in zip(items, bins.tolist(), strict=True):
        inside = room.setdefault(b, [])
        assert cluster not in [c for _, _, c in inside] and sum(s == source for _, s, _ in inside) < per_source
        inside.append((size, source, cluster))
        left.append(100 - sum(s for s, _, _ in inside))
        assert left[-1] >= 0
    want_left, want_bins = best_fit_by_hand(items, 100, per_source)
    assert len(room) == want_bins
    assert left == want_left


def test_packing(spark):
    texts = awkward(random.Random(10))
    df = frame(spark, texts).union(frame(spark, texts[:9]))
    rows = packing.packed(df, capacity=100, group_rows=20).collect()
    n = Counter()
    for r in rows:
        n[r.doc_id] += r.n_words
        assert r.start == r.piece * 100 or r.n_words == 0
        assert (r.bin_id is None) == (r.n_words == 0)
    assert all(n[i] == len(words(t)) * (2 if i < 9 else 1) for i, t in enumerate(texts))
    bins = {}
    for r in rows:
        if r.bin_id and r.bin_id.startswith("g"):
            bins.setdefault(r.bin_id, []).append(r)
    clusters = [hashlib.md5((t or "").encode()).hexdigest() for t in texts]
    for inside in bins.values():
        assert sum(r.n_words for r in inside) <= 100
        own = [clusters[r.doc_id] for r in inside]
        assert len(set(own)) == len(own)
    assert packing.packed(df.limit(0)).count() == 0


def test_network_gradients():
    net = languages.Network(["a", "b", "c"], states=4)
    for p in net.parameters():
        p[...] = np.random.default_rng(0).normal(0, 0.3, p.shape)
    x, y = np.array([[97, 98, 99, 97], [100, 97, 97, 98]]).T, np.array([0, 2])
    for part in (net.ahead, net.back):
        part.w, part.u = part.w.astype(np.float64), part.u.astype(np.float64)
    net.v, net.b = net.v.astype(np.float64), net.b.astype(np.float64)
    _, grads = net.gradients(x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = p[at], 1e-4
        p[at] = old + h
        up = net.gradients(x, y)[0]
        p[at] = old - h
        down = net.gradients(x, y)[0]
        p[at] = old
        assert math.isclose((up - down) / (2 * h), g[at], rel_tol=1e-3, abs_tol=1e-4)


def test_languages(spark):
    rng = random.Random(11)
    kinds = {"en": "the thing is with ing tion er".split(), "de": "und der schau keit ung ü ß".split(), "fr": "le eau que ç è ment".split()}
    texts, lang = [], {}
    for i in range(300):
        lang[i] = rng.choice(list(kinds))
        texts.append(" ".join("".join(rng.choice(kinds[lang[i]]) for _ in range(rng.randrange(1, 4))) for _ in range(30)))
    texts += [None, "", "123 ...", "x" * 100, texts[0]]
    lang |= {300: None, 304: lang[0]}
    docs = frame(spark, texts, lang=lang)
    network = languages.train(docs, F.col("doc_id") % 5 != 0)
    rows = languages.identified(docs, network).collect()
    assert all(0 <= r.lang_score <= 1 for r in rows) and len(rows) == len(texts)
    held = [r for r in rows if r.doc_id % 5 == 0 and r.doc_id < 300]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert [rows[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3
    assert rows[304].lang_score == rows[0].lang_score
    assert languages.train(docs, F.lit(False)) is None
    assert {r.lang_pred for r in languages.identified(docs, None).collect()} == {"und"}
    # the same network for any partitioning
    again = languages.train(docs.repartition(7), F.col("doc_id") % 5 != 0)
    assert all((p == q).all() for p, q in zip(network.parameters(), again.parameters(), strict=True))
    # against one position at a time, one text at a time
    for t in texts[:4]:
        x = np.frombuffer(t.encode().lower(), np.uint8)
        got = languages.label_sums(network, x, np.array([0, len(x)]))[0]
        assert np.allclose(got, labels_by_hand(network, x), atol=1e-2)
        cut = languages.label_sums(network, x, np.array([0, len(x)]), span=32)[0]
        assert np.allclose(cut / len(x), got / len(x), atol=0.02)


def labels_by_hand(network, x):
    def read(direction, order):
        h, out = np.zeros(direction.n), []
        for byte in order:
            a, u, n = direction.w[:, byte].astype(float), direction.u.astype(float), direction.n
            gate = a[: 2 * n] + u[: 2 * n] @ h
            gate = 0.5 * (1 + gate / (1 + abs(gate)))
            c = a[2 * n :] + u[2 * n :] @ (gate[n:] * h)
            h = h + gate[:n] * (c / (1 + abs(c)) - h)
            out.append(h)
        return out

    total = 0
    for one, two in zip(read(network.ahead, x), read(network.back, x[::-1])[::-1], strict=True):
        e = np.exp(network.v @ np.concatenate([one, two]) + network.b[:, 0])
        total = total + e / e.sum()
    return total


def test_quality(spark):
    rng = random.Random(12)
    texts, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = sentence(rng, rng.randrange(20, 80), 5000)
        texts.append(w + "." if good else rng.choice([w.upper() + "!!", " | ".join(w.split()), " ".join([w.split()[0]] * 40)]))
        labels.append((i, int(good), 0))
    texts += [None, "", texts[0]]
    docs = frame(spark, texts)
    table = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, table, F.col("doc_id") % 4 != 2)
    rows = quality.scored(docs, model).select("doc_id", "quality_score").orderBy("doc_id").collect()
    assert len(rows) == len(texts) and all(0 <= r.quality_score <= 1 for r in rows)
    held = [i for i in range(600) if i % 4 == 2]
    assert sum((rows[i].quality_score >= 0.5) == labels[i][1] for i in held) >= 0.95 * len(held)
    assert rows[602].quality_score == rows[0].quality_score
    assert quality.train(docs, table.limit(0), F.lit(True)).rules == ()
    # the compiled column against the rules in numpy
    measured, names = quality.statistics(docs)
    x = np.array([list(r) for r in measured.orderBy("doc_id").select(*names).collect()])
    assert np.allclose(model.predict(x), [r.quality_score for r in rows])


@pytest.fixture
def few_steps(monkeypatch):
    monkeypatch.setattr(neurallm, "STEPS", 200)


def test_language_model(spark, few_steps):
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["the cat", "a dog", "der hund", "die katze"]) for _ in range(20)) for _ in range(200)] + [None, "", "  ", "Unseen words HERE", "x" * 2000]
    docs = frame(spark, texts)
    held = F.col("doc_id") % 7 == 2
    model, table = neurallm.train(docs.where(~held))
    rows = {r.doc_id: r for r in neurallm.score_texts(docs, model, table, held_out=held).collect()}
    counts, n = Counter(), 0
    for i, t in enumerate(texts):
        if i % 7 != 2:
            counts.update([*words(t), None])
    n = sum(counts.values())
    for i, t in enumerate(texts):
        own = [*words(t), None]
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[w] > 0 for w in own), n, i % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in own), rel_tol=1e-9)
    better = [i for i in range(200) if i % 7 == 2]
    assert sum(rows[i].score for i in better) > 0.8 * sum(rows[i].base_score for i in better)
    assert neurallm.score_texts(docs.limit(0), model, table).count() == 0
    # the same model for any partitioning
    again, _ = neurallm.train(docs.where(~held).repartition(5))
    assert np.allclose(model.r, again.r, atol=1e-4) and all(np.allclose(x[0], y[0], atol=1e-2) for x, y in zip(model.words, again.words, strict=True))
    empty_model, empty_table = neurallm.train(docs.limit(0))
    assert {(r.n_known, r.base_score, r.score) for r in neurallm.score_texts(docs.limit(3), empty_model, empty_table).collect()} == {(0, 0.0, 0.0)}


def log_softmax(s):
    return s - s.max() - math.log(np.exp(s - s.max()).sum())


@pytest.mark.parametrize("head", [12, 65_536])
def test_scores_token_by_token(spark, few_steps, head):
    """Every factor of every token by plain sums; all words of a place and the unseen one sum to 1."""
    rng = random.Random(14)
    texts = [sentence(rng, 30, 60) for _ in range(60)] + ["w1 nothing w2", None, "w3"]
    docs = frame(spark, texts)
    model, table = neurallm.train(docs.where("doc_id < 60"), head=head, frequent=5)
    counts = {r.word: r.n for r in table.collect()}
    (_, found), *_ = textkit.batches(pa.array(texts), textkit.WORDS_SPACE)
    hashes, suffix, bounds = neurallm.tokens(found)
    _, rank = model.look_up(hashes)
    want, checked = [], 0
    for d in range(len(texts)):
        total = 0.0
        for t in range(bounds[d], bounds[d + 1]):
            q = np.zeros(neurallm.WIDTH)
            for back, vectors in model.tables:
                p = t - back
                context = model.contexts - 1 if p < bounds[d] else rank[p] if rank[p] < model.frequent else model.frequent + suffix[p]
                q += vectors[context]
            classes = log_softmax(model.r.astype(float) @ q + model.b)
            seen = math.log(1 - 1 / (model.total + model.types + 1))
            if rank[t] < model.head:
                k = int(model.class_of[rank[t]])
                within = log_softmax(model.words[k][0].astype(float) @ q + model.words[k][1])
                total += (classes[k] + within[model.members[k].tolist().index(rank[t])] + seen) / math.log(10)
            elif (n := counts.get(int(hashes[t].view(np.int64)))) is not None:
                k = suffix[t] % neurallm.TAILS
                total += (classes[model.classes + k] + seen) / math.log(10) + math.log10(n / model.tails[k])
            else:
                total -= math.log10(model.total + model.types + 1)
            checked += 1
            assert math.isclose(np.exp(classes).sum(), 1, rel_tol=1e-6)
        want.append(total)
    got = [r.score for r in neurallm.score_texts(docs, model, table).orderBy("doc_id").collect()]
    assert checked > 1500 and got == pytest.approx(want, rel=1e-3)
    # other words' shares of their classes
    own = Counter()
    for word, n in counts.items():
        if word not in set(model.hashes.view(np.int64).tolist()):
            own["n"] += n
    assert own["n"] == model.tails.sum() and model.sizes.sum() == model.total


def test_words_are_scored_by_what_stands_before(spark, few_steps):
    """Also rare words, and also where it stands two places before."""
    rng = random.Random(16)
    rare = {"a": [f"r{i}x" for i in range(60)], "b": [f"s{i}x" for i in range(60)]}
    docs = frame(spark, [" ".join(f"{c} of {rng.choice(rare[c])}" for c in rng.choices("ab", k=20)) for _ in range(200)])
    asked = frame(spark, [f"{c} of {w}" for c in "ab" for k in "ab" for w in rare[k][:20]])
    model, table = neurallm.train(docs)
    scores = {r.doc_id: r.score for r in neurallm.score_texts(asked, model, table).collect()}
    right, wrong = sum(scores[i] for i in [*range(20), *range(60, 80)]), sum(scores[i] for i in range(20, 60))
    assert right > wrong + 40 * 0.2


def test_sums_over_classes_by_products_of_exponentials():
    """Also where a context's scores are too large for them."""
    rng = np.random.default_rng(18)
    head = 1000
    counts = np.sort(rng.integers(1, 500, head))[::-1]
    model = neurallm.Model(rng.integers(1, 1 << 62, head).astype(np.uint64), counts, rng.integers(0, 256, head), int(counts.sum()) + 640, 1200, 100)
    model.look_around()
    model.cluster(rng.normal(size=(head, neurallm.WIDTH)) * counts[:, None], np.full(neurallm.TAILS, 10.0))
    rows, _ = model.start()
    rows[: model.contexts, : neurallm.WIDTH] *= 5
    rows[:3, : neurallm.WIDTH] *= 200
    model.use(rows)
    codes, bounds = rng.integers(0, head, 3000), np.arange(0, 3001, 100)
    contexts, q = [model.context(codes, bounds, back) for back, _ in model.tables], model.vectors(codes, bounds)
    output = model.output(codes)
    got = model.class_log10(q, contexts, output)
    want = [log_softmax(model.r.astype(float) @ x[:-1] + model.b)[k] / math.log(10) for x, k in zip(q, output, strict=True)]
    assert any(np.isnan(x).any() for x in model.powers) and np.allclose(got, want, atol=1e-4, rtol=1e-4)


def test_rare_words_of_a_document_are_joined_once(spark, few_steps):
    """Each document's words are put together where they are found, so that nothing is shuffled before the join with the counts."""
    rng = np.random.default_rng(19)
    words, gain = rng.integers(0, 9, 300).astype(np.uint64), rng.normal(size=300)
    bounds = np.array([0, 0, 120, 121, 121, 300, 300])
    once, times, sums, ends = neurallm._once(words, gain, bounds)
    for d in range(len(bounds) - 1):
        own = slice(bounds[d], bounds[d + 1])
        want = {w: (int((words[own] == w).sum()), pytest.approx(gain[own][words[own] == w].sum())) for w in set(words[own].tolist())}
        part = slice(ends[d], ends[d + 1])
        assert dict(zip(once[part].tolist(), zip(times[part].tolist(), sums[part].tolist(), strict=True), strict=True)) == want and len(once[part]) == len(want)
    assert [len(x) for x in neurallm._once(words[:0], gain[:0], np.zeros(1, np.int64))] == [0, 0, 0, 1]
    docs = frame(spark, ["a b c " * 9 + "rare rare", "rare other", None] * 4)
    model, table = neurallm.train(docs, head=4)
    scored = neurallm.score_texts(docs, model, table)
    assert not re.search(r"hashpartitioning\(uid#\d+L?, word", scored._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in scored.collect()} == {i: ((30, 30), (3, 3), (1, 1))[i % 3] for i in range(12)}


def test_every_place_trains_the_network(spark, monkeypatch):
    """In several shards and rounds; the network does not depend on how the rows are dealt."""
    monkeypatch.setattr(neurallm, "STEPS", 1)
    rng = random.Random(17)
    docs = frame(spark, [sentence(rng, 60, 200) for _ in range(400)] + [None, "", "word " * 3000])
    trained, weights = neurallm._trained, Counter()

    def counted(encoded, model, shards, rounds):
        assert shards > 2 and rounds == neurallm.ROUNDS
        shared = spark.sparkContext.broadcast((model, *model.start()))
        for k in range(rounds):
            own = encoded.where(F.col("round") == k).select("shard", "low", "high")
            run = neurallm._train_shards(shared, (0.0, 1.0), 1000, 1, k)
            for r in own.mapInArrow(run, f"row long, weight double, {', '.join(f'{c} float' for c in neurallm.ROWS)}").select("row", "weight").collect():
                weights["contexts" if r.row < model.contexts else r.row - model.contexts] += r.weight
        return trained(encoded, model, shards, rounds)

    monkeypatch.setattr(neurallm, "_trained", counted)
    model, _ = neurallm.train(docs)
    monkeypatch.setattr(neurallm, "_trained", trained)
    assert weights.pop("contexts") == neurallm.POSITIONS * model.total and set(weights.values()) == {model.total}
    again, _ = neurallm.train(docs.repartition(5))
    assert np.allclose(model.r, again.r, atol=1e-3)


def test_vectors(spark):
    rng = np.random.default_rng(15)
    base = rng.normal(size=(40, 16))
    near = base[rng.integers(0, 40, 300)] + rng.normal(0, 0.05, (300, 16))
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.concatenate([base, near, rng.normal(size=(200, 16))]))]
    rows += [(600, rows[3][1]), (601, rows[3][1]), (602, [2 * v for v in rows[3][1]])]
    odd = [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [None] + [1.0] * 15), (705, [1.0] * 8), (None, rows[3][1]), (706, [1e200] * 16), (707, [1e200] * 16)]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<double>, rep int")
    for options in ({}, {"leaf_rows": 60, "cell_rows": 150}):
        got = {r.vec_id: r for r in vectors.linked_vectors(df, **options).collect()}
        x = np.array([r[1] for r in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if i < j]
        degree = Counter(v for pair in links for v in pair)
        groups = union_find(links, [r[0] for r in rows])
        found = sum(got[i].n_links for i in groups)
        assert found >= (0.99 if options == {} else 0.9) * 2 * len(links)
        assert all(got[i].n_links <= degree[i] for i in groups)
        if not options:
            assert {i: got[i].component_id for i in groups} == groups
        for i in (700, 701, 702, 703, 704, 705, None):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[706].n_links == 1 and got[707].component_id == 706
    assert vectors.linked_vectors(df.limit(0)).count() == 0
