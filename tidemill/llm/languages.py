"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the (A-Z lower-cased) bytes of a text, spaces included, in both
directions, gives each position a distribution over the languages from its two
states, and a document the mean of the distributions of all its positions.  No
position is skipped, and no state is reset inside a text of up to SPAN bytes.  A
longer text is read in spans of SPAN bytes; before each direction labels a span it
reads the WARM bytes that come before it, whose labels it leaves to the span they
are in.  A gated state forgets: README has the difference that this makes to the
labels of one unbroken reading.

Training is backpropagation through time with Adam, in numpy, on a bounded sample
of labelled rows: `sample_docs` documents on average, drawn by a hash of their id.
Each step draws documents and then places anywhere in their whole texts.  Rows are
sorted before they are used, so that the network does not depend on partitions.

Scores are rounded to six places: they depend on the text alone, not on the rows
that are read beside it.  Of equally likely languages the first by name wins.

Nulls and empties: a text that is null or has no letter gets `und` and score 0;
so does every text if there is nothing to learn from.  A row with a null id is
learned from as any other, if the caller lets it.  Repeated rows are predicted
row by row; other columns are kept, but for those of the two result columns' names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, runs

UND = "und"
SAMPLE_DOCS = 4000
SPAN = 1024
WARM = 48
STATES = 8
STEPS = 400
#: spans of a training step, and their bytes
BATCH = 192
LENGTH = 64
#: spans that are read side by side
ROWS = 2048
#: a prefix of the rows of a step is rounded up to so many: kernels then treat each row alike
ALIGN = 64


def _bent(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the squashing function of states and gates."""
    down = np.abs(x)
    down += 1
    x /= down
    return x


class Direction:
    """One direction's gated recurrent layer.

    w: a column for each byte, u: recurrent matrices; rows for gates z, r and the candidate.
    States are columns, one for each text that is read side by side.
    """

    def __init__(self, rng: np.random.Generator, states: int):
        self.n = states
        self.w = rng.normal(0, 0.5, (3 * states, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (3 * states, states)).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(new states, z, r, candidate) of a byte each."""
        n = self.n
        a = np.empty((3 * n, len(x)), self.w.dtype)
        self.w.take(x, axis=1, out=a, mode="clip")
        gates = a[: 2 * n]
        gates += self.u[: 2 * n] @ h
        _bent(gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:n], gates[n:]
        c = a[2 * n :]
        c += self.u[2 * n :] @ (r * h)
        _bent(c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list]:
        """States after each of the bytes x (length, batch), and what backward needs."""
        h, out, trace = np.zeros((self.n, x.shape[1]), self.w.dtype), [], []
        for own in x:
            new, z, r, c = self.step(own, h)
            trace.append((h, z, r, c))
            out.append(new)
            h = new
        return out, trace

    def backward(self, x: np.ndarray, trace: list, grads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, u = self.n, self.u
        dw, du = np.zeros_like(self.w), np.zeros_like(u)
        dh = np.zeros_like(grads[0])
        full = np.empty((len(x), 3 * n, x.shape[1]))
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c = trace[t]
            dh = dh + grads[t]
            dc = dh * z * (1 - np.abs(c)) ** 2
            dz = dh * (c - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            drh = u[2 * n :].T @ dc
            dr = drh * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dzr = np.concatenate([dz, dr])
            du[2 * n :] += dc @ (r * h).T
            du[: 2 * n] += dzr @ h.T
            full[t, : 2 * n], full[t, 2 * n :] = dzr, dc
            dh = dh * (1 - z) + drh * r + u[: 2 * n].T @ dzr
        for k in range(3 * n):
            dw[k] = np.bincount(x.ravel(), weights=full[:, k].ravel(), minlength=256)
        return dw, du


class Network:
    def __init__(self, languages: list[str], states: int = STATES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(rng, states), Direction(rng, states)
        self.v = rng.normal(0, 0.3, (len(languages), 2 * states)).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of texts x (length, batch) of one length, each position labelled y."""
        ahead, trace_a = self.ahead.forward(x)
        back, trace_b = self.back.forward(x[::-1])
        n, at = self.ahead.n, np.arange(x.shape[1])
        loss, dv, db, da, dback = 0.0, np.zeros_like(self.v), np.zeros_like(self.b), [], []
        for t in range(len(x)):
            both = np.concatenate([ahead[t], back[len(x) - 1 - t]])
            p = self._softmax(self.v @ both + self.b)
            loss -= float(np.log(p[y, at] + 1e-12).sum())
            p[y, at] -= 1
            dv += p @ both.T
            db += p.sum(axis=1, keepdims=True)
            down = self.v.T @ p
            da.append(down[:n])
            dback.append(down[n:])
        dwa, dua = self.ahead.backward(x, trace_a, da)
        dwb, dub = self.back.backward(x[::-1], trace_b, dback[::-1])
        return loss, [dwa, dua, dwb, dub, dv, db]

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.v, self.b]

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, length: int = LENGTH, seed: int = 4) -> None:
        """texts of one byte at least; a span that is longer than its text goes on from the text's begin."""
        rng = np.random.default_rng(seed)
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            own = rng.integers(0, len(texts), size=batch)
            start = (rng.random(batch) * np.maximum(1, size[own] - length + 1)).astype(np.int64)
            x = data[begin[own] + (start + np.arange(length)[:, None]) % size[own]]
            _, grads = self.gradients(x, labels[own])
            rate = 0.03 * (1 - step / (steps + 1))
            for p, g, m, s in zip(self.parameters(), grads, first, second, strict=True):
                g = g / x.size
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)

    def summed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of the labels of the positions first..last of each range start..end of data; ranges in order of falling length."""
        n, length, count = self.ahead.n, end - start, len(start)
        pad = -count % ALIGN
        low, high = np.pad(first - start, (0, pad)), np.pad(last - start, (0, pad))
        start, last_byte = np.pad(start, (0, pad)), max(0, len(data) - 1)
        unread, shortest = low.max(), np.minimum.accumulate(high[:count])
        active = np.searchsorted(-length, -np.arange(length[0]), side="left").tolist()  # rows longer than t
        ahead, h = [], np.zeros((n, len(start)), np.float32)
        for t, own in enumerate(active):
            m = -(-own // ALIGN) * ALIGN
            h = h if h.shape[1] == m else np.ascontiguousarray(h[:, :m])
            h = self.ahead.step(data[np.minimum(start[:m] + t, last_byte)], h)[0]
            ahead.append(h)
        total = np.zeros((len(self.languages), len(start)), np.float32)
        ahead_v, back_v = np.ascontiguousarray(self.v[:, :n]), np.ascontiguousarray(self.v[:, n:])
        h = np.zeros((n, 0), np.float32)
        for t in range(length[0] - 1, -1, -1):
            own = active[t]
            m = -(-own // ALIGN) * ALIGN
            h = h if h.shape[1] == m else np.pad(h, ((0, 0), (0, m - h.shape[1])))
            h = self.back.step(data[np.minimum(start[:m] + t, last_byte)], h)[0]
            h[:, own:] = 0
            s = ahead_v @ ahead.pop()
            s += back_v @ h
            s += self.b
            p = self._softmax(s)
            p[:, own:] = 0
            if t < unread or t >= shortest[own - 1]:
                p *= (low[:m] <= t) & (t < high[:m])
            total[:, :m] += p
        return total[:, :count].T.astype(np.float64)


def spans(offsets: np.ndarray, span: int = SPAN, warm: int = WARM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, first, last) of the spans of texts: bytes first..last are labelled, start..end are read."""
    size = np.diff(offsets)
    pieces = -(-size // span)
    text = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = offsets[:-1][text] + span * number
    last = np.minimum(first + span, offsets[1:][text])
    return text, np.maximum(first - warm, offsets[:-1][text]), np.minimum(last + warm, offsets[1:][text]), first, last


def label_sums(network: Network, data: np.ndarray, offsets: np.ndarray, span: int = SPAN, warm: int = WARM) -> np.ndarray:
    """Sum of the labels of all positions of each text; data are lower-cased bytes."""
    text, start, end, first, last = spans(offsets, span, warm)
    order = np.argsort(start - end, kind="stable")
    sums = np.zeros((len(text), len(network.languages)))
    for i in range(0, len(order), ROWS):
        own = order[i : i + ROWS]
        sums[own] = network.summed(data, start[own], end[own], first[own], last[own])
    out = np.zeros((len(offsets) - 1, sums.shape[1]))
    np.add.at(out, text, sums)  # in the order of a text's spans
    return out


def _predict(shared):
    def predict(texts: pa.Array) -> pa.Array:
        network = shared.value
        best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, data, offsets in runs(texts):
            mean = label_sums(network, LOWER[data], offsets) / np.maximum(np.diff(offsets), 1)[:, None]
            mean = np.round(mean, 6)
            best.append(mean.argmax(axis=1))
            score.append(np.clip(mean.max(axis=1), 0, 1))
        names = pa.array(network.languages, pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(score))], names=["lang", "score"])

    return predict


def train(docs: DataFrame, learn: Column, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network from the rows of docs where `learn` holds; None if there are none with text."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    total = rows.count()
    if not total:
        return None
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / total)) + 1
    sample = rows.where(part).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).toArrow()
    pairs = sorted(zip(sample["lang"].to_pylist(), sample["text"].to_pylist(), strict=True), key=lambda p: (hashlib.md5(p[1].encode()).digest(), p))
    languages = sorted({lang for lang, _ in pairs})
    if not languages:
        return None
    network = Network(languages)
    network.fit([LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for _, t in pairs], np.array([languages.index(lang) for lang, _ in pairs]))
    return network


def identified(docs: DataFrame, network: Network | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """docs with the language and its mean probability; columns of those names are replaced."""
    text = F.col(text_col)
    if network is None:
        return docs.withColumns({lang_out: F.lit(UND), score_out: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(network)
    found = docs.withColumn("__tidemill_lang", F.arrow_udf(_predict(shared), "struct<lang: string, score: double>")(text))
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return found.withColumns(
        {lang_out: F.when(letters, F.col("__tidemill_lang.lang")).otherwise(UND), score_out: F.when(letters, F.col("__tidemill_lang.score")).otherwise(0.0)}
    ).drop("__tidemill_lang")


__all__ = ["Network", "identified", "label_sums", "spans", "train"]
