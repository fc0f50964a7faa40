"""Class-factored log-bilinear language model, trained by noise-contrastive estimation.

Vocabulary: all tokens of the training documents are counted in Spark.  The `head` most frequent
words are the network's own.  Their neighbours, summed over all their occurrences, cluster them
into classes of about the square root of their number (halved again and again along the main
direction of their neighbours).  All other words make TAILS classes by their last two bytes.

A token's context is the words at the last POSITIONS places: a frequent word (at least FREQUENT, and
more with the root of the number of types) by a vector of its own, others by one for their last two
bytes, places before the document's begin by one for that.

    q = sum over positions k of E[word at k] C[k]
    P(class | q)   = exp(q . R[class] + b[class]) / Z(q)
    P(w | class, q) = n(w) exp(q . D[w] + e[w]) / T(class, q)   for words of the head
    P(w | class, q) = n(w) / n(class)                           for all others

E, C, R and b are trained by noise-contrastive estimation on every place of the training documents;
noise classes come from the classes' counts.  A hash of id and text deals the documents to shards of
at least STEPS * BATCH places and, within a shard, to ROUNDS.  In a round each shard takes its places
in steps of about BATCH from the network that all shards begin with; then a context's vector becomes
the mean of the shards' weighted by its occurrences, and the others that weighted by places.  Fewer
places are one shard, which takes all of them again and again until it made STEPS steps.

Every word of the head has a vector D from all of its occurrences: one
Newton step of the likelihood from the word's share of its class, with a prior as strong as PRIOR
occurrences; e keeps the share, for contexts spread as those of the class.  Z and T are sums over all
classes, and over all words of a class, from batched matrix products: every token gets a normalised
log-probability.  An unseen word has the base's probability 1 / (N + V + 1), which the V seen types
leave: the model is normalised over them and one unseen type, as is the base.

Memory: the network and the head go to the workers by broadcast, both of fixed size; rarer words'
counts come by a join on 64-bit word hashes.

Nulls and empties: a null text is an empty one, whose one token is the end.
Without training documents all counts are 0 and both scores are log10 of the
uniform distribution over the one unseen type: 0.  A null doc_id is in the
training part (crc32 of null is none).  Repeated rows are scored row by row and
counted as often as they occur.  Very long texts are scored whole.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, staged
from .textkit import WORDS_SPACE, Words, batches, mix

HEAD = 65_536
#: least number of words that have vectors of their own as contexts, and the suffix classes of the others
FREQUENT = 4096
SUFFIXES = 256
TAILS = 64
POSITIONS = 3
WIDTH = 24
#: least steps of a shard, a step's places and noise classes, and how often the shards' networks are averaged
STEPS = 1500
BATCH = 4096
NOISE = 64
ROUNDS = 8
#: places of a shard that are taken in an order of their own
MIXED = 1 << 20
#: occurrences that the prior of a word's vector weighs
PRIOR = 8.0
#: the end token's hash; words' hashes are mixed, and none is expected to meet it
END = np.uint64(1)
#: words of one task that are counted before they are passed on
HELD = 2_000_000
#: tokens whose scores are computed at once: few enough for a core's cache
BLOCK = 1024
#: tokens whose sums over the classes, and whose contexts' vectors, are computed at once, for the same reason
MULTIPLIED = 256
GATHERED = 8192
#: three times the score of a context, and sums of exponentials (or their inverse), beyond which the largest score is taken off first
LARGE, SMALL = 60.0, 1e-20
#: tokens whose neighbours are summed at once
SUMMED = 1 << 17


def tokens(words: Words, suffixes: int = SUFFIXES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (with each document's end), suffix classes, and documents + 1 places."""
    n_docs = len(words.bounds) - 1
    bounds = words.bounds + np.arange(n_docs + 1)
    out = np.full(int(bounds[-1]), END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[bounds[1:] - 1] = False
    out[is_word] = words.hashes()
    suffix = np.zeros(len(out), np.int64)
    last = words.lower[words.end - 1].astype(np.int64)
    before = np.where(words.end - 2 >= words.start, words.lower[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
    suffix[is_word] = (last * 31 + before) % suffixes
    return out, suffix, bounds


class Model:
    """What the workers need: the head with its counts and classes, and the network."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, suffixes: np.ndarray, total: int, types: int, frequent: int = FREQUENT):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.rank = order  # words come by descending count: a word's place in that order
        self.by_rank = counts.astype(np.float64)
        self.head, self.total, self.types = len(hashes), total, types
        self.frequent = min(self.head, max(frequent, 2 * int(types**0.5)))
        self.contexts = self.frequent + SUFFIXES + 1
        # a token's code is its place in the head, or the head's size and its suffix class
        self.own = np.concatenate([np.arange(self.frequent), self.frequent + suffixes[self.frequent :], self.frequent + np.arange(SUFFIXES)]).astype(np.int64)
        self.unseen = -np.log10(total + types + 1)
        self.tables: list[tuple[int, np.ndarray]] = []
        # places in `hashes` by the first bits, the last of each
        self.bits = np.uint64(64 - max(1, 4 + self.head.bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.bits)), np.int32)
        self.slots[self.hashes >> self.bits] = np.arange(self.head)
        first = np.flatnonzero(self.hashes[:-1] >> self.bits == self.hashes[1:] >> self.bits)
        self.crowded = self.hashes[first], first  # those that others took the slots of

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count in the head, else -1; place in the head, else its size) of each token."""
        if not self.head:
            return np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        at = self.slots.take((hashes >> self.bits).astype(np.int64))
        known = self.hashes.take(at) == hashes
        if len(self.crowded[0]):
            left = np.flatnonzero(~known)
            k = np.minimum(np.searchsorted(self.crowded[0], hashes[left]), len(self.crowded[0]) - 1)
            same = self.crowded[0][k] == hashes[left]
            at[left[same]], known[left[same]] = self.crowded[1][k[same]], True
        return np.where(known, self.counts.take(at), -1), np.where(known, self.rank.take(at), self.head)

    def codes(self, rank: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return np.where(rank < self.head, rank, self.head + suffix)

    def context(self, codes: np.ndarray, bounds: np.ndarray, back: int) -> np.ndarray:
        """The context of each token that is the token `back` places before it in its document (behind it, if negative)."""
        own, out = self.own.take(codes), np.full(len(codes), self.contexts - 1)
        if back > 0:
            out[back:] = own[:-back]
        else:
            out[:back] = own[-back:]
        for k in range(abs(back)):
            edge = bounds[:-1] + k if back > 0 else bounds[1:] - 1 - k
            out[edge[(edge >= bounds[:-1]) & (edge < bounds[1:])]] = self.contexts - 1
        return out

    def vectors(self, codes: np.ndarray, bounds: np.ndarray, contexts: list[np.ndarray] | None = None) -> np.ndarray:
        """The sum of the tables' rows for the contexts of each token, and a column of ones."""
        out, held = np.empty((len(codes), WIDTH + 1), np.float32), np.empty((GATHERED, WIDTH + 1), np.float32)
        contexts = contexts or [self.context(codes, bounds, back) for back, _ in self.tables]
        # the ones come with the first table's rows
        tables = [np.concatenate([t, np.full((len(t), 1), k == 0)], axis=1, dtype=np.float32) for k, (_, t) in enumerate(self.tables)]
        for i in range(0, len(codes), GATHERED):
            own = out[i : i + GATHERED]
            tables[0].take(contexts[0][i : i + GATHERED], axis=0, out=own, mode="clip")
            for table, context in zip(tables[1:], contexts[1:], strict=True):
                own += table.take(context[i : i + GATHERED], axis=0, out=held[: len(own)], mode="clip")
        return out

    # classes

    def look_around(self, seed: int = 6) -> None:
        """Tables of random vectors, for sums that tell what stands beside a word."""
        rng = np.random.default_rng(seed)
        self.tables = []
        for back, columns in ((1, slice(0, WIDTH // 2)), (-1, slice(WIDTH // 2, WIDTH))):
            table = np.zeros((self.contexts, WIDTH), np.float32)
            table[:, columns] = rng.normal(size=(self.contexts, WIDTH // 2))
            self.tables.append((back, table))

    def cluster(self, near: np.ndarray, tails: np.ndarray) -> None:
        """Classes of the head's words by the sums of what stands beside them; tails: tokens of each class of other words."""
        mean = near / np.maximum(self.by_rank, 1)[:, None]
        groups = [np.arange(self.head)] if self.head else []
        for _ in range(max(0, self.head - 1).bit_length() // 2):
            halves = []
            for own in groups:
                x = mean[own] - mean[own].mean(axis=0)
                direction = np.linalg.eigh(x.T @ x)[1][:, -1]
                direction *= np.sign(direction[np.abs(direction).argmax()])
                order = own[np.argsort(x @ direction, kind="stable")]
                halves += [order[: len(order) // 2], order[len(order) // 2 :]]
            groups = halves
        self.members = [np.sort(g) for g in groups]
        self.classes = len(self.members)
        self.class_of, self.place_of = np.zeros(self.head, np.int64), np.zeros(self.head, np.int64)
        for k, own in enumerate(self.members):
            self.class_of[own], self.place_of[own] = k, np.arange(len(own))
        self.tails = tails
        self.outputs = self.classes + TAILS
        self.sizes = np.concatenate([[self.by_rank[g].sum() for g in self.members], tails])

        self.class_of_code = np.concatenate([self.class_of, self.classes + np.arange(SUFFIXES) % TAILS])

    def output(self, codes: np.ndarray) -> np.ndarray:
        """The class of each token."""
        return self.class_of_code.take(codes)

    # the network

    def start(self, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """The network before its training, as rows of E, of R and b, and of each C; the squares of its gradients so far."""
        rng = np.random.default_rng(seed)
        noise = self.sizes / max(self.sizes.sum(), 1)
        rows = np.zeros((self.contexts + self.outputs + POSITIONS * WIDTH, WIDTH + 1), np.float32)
        e, r, c = self.parts(rows)
        e[:] = rng.normal(0, 0.1, e.shape)
        r[:, :WIDTH], r[:, WIDTH] = rng.normal(0, 0.1, (self.outputs, WIDTH)), np.log(np.maximum(noise, 1e-30))
        for k in range(POSITIONS):
            c[k][:] = np.eye(WIDTH) * 0.7**k + rng.normal(0, 0.01, (WIDTH, WIDTH))
        return rows, np.full_like(rows, 1e-2)

    def parts(self, rows: np.ndarray, contexts: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Views of E (all of it, or rows of it for so many contexts), of R with b, and of each C."""
        first = self.contexts if contexts is None else contexts
        last = first + self.outputs
        return rows[:first, :WIDTH], rows[first:last], [rows[last + k * WIDTH : last + (k + 1) * WIDTH, :WIDTH] for k in range(POSITIONS)]

    def use(self, rows: np.ndarray) -> None:
        """Take the trained network."""
        e, r, c = self.parts(rows)
        self.r, self.b = r[:, :WIDTH].copy(), np.where(self.sizes > 0, r[:, WIDTH], -1e30).astype(np.float32)
        self.tables = [(k + 1, e @ m) for k, m in enumerate(c)]

    def fit_words(self, sums: np.ndarray, tails: np.ndarray, square: np.ndarray) -> None:
        """Vectors of the head's words from the sums of their contexts' vectors, those of the other classes, and the sum of the vectors' squares."""
        n = self.by_rank[:, None]
        per_class = _added(self.class_of, sums, self.classes) / self.sizes[: self.classes, None] if self.head else np.zeros((0, WIDTH))
        # the covariance of the contexts' vectors within the classes
        means = np.concatenate([per_class, tails / np.maximum(self.tails, 1)[:, None]])
        self.spread = (square - (means * self.sizes[:, None]).T @ means) / max(self.total, 1)
        own = per_class[self.class_of]
        inverse = np.linalg.pinv(self.spread + 0.01 * max(np.trace(self.spread) / WIDTH, 1e-12) * np.eye(WIDTH))
        d = (sums / np.maximum(n, 1) - own) @ inverse * (n / (n + PRIOR))
        e = np.log(np.maximum(self.by_rank, 1)) - np.einsum("ij,ij->i", own, d) - 0.5 * np.einsum("ij,jk,ik->i", d, self.spread, d)
        self.words = [(d[g].astype(np.float32), e[g].astype(np.float32)) for g in self.members]

    # scores

    def class_log10(self, q: np.ndarray, contexts: list[np.ndarray], output: np.ndarray) -> np.ndarray:
        """log10 P(class | q); a token's sum over all classes is one of products of its contexts' own exponentials."""
        total, own = np.empty(len(q), np.float32), np.empty(len(q), np.float32)
        table = _biased(self.r, self.b)
        rows = np.ascontiguousarray(table.T)
        held = [np.empty((MULTIPLIED, self.outputs), np.float32) for _ in range(2)]
        for i in range(0, len(q), MULTIPLIED):
            at = slice(i, min(i + MULTIPLIED, len(q)))
            product, more = (x[: at.stop - i] for x in held)
            self.powers[0].take(contexts[0][at], axis=0, out=product, mode="clip")
            for power, context in zip(self.powers[1:-1], contexts[1:-1], strict=True):
                product *= power.take(context[at], axis=0, out=more, mode="clip")
            self.powers[-1].take(contexts[-1][at], axis=0, out=more, mode="clip")
            np.vecdot(product, more, out=total[at])
            np.einsum("ij,ij->i", q[at], rows.take(output[at], axis=0), out=own[at])
        fine = (total > SMALL) & (total < 1 / SMALL)
        out = (own - np.log(np.where(fine, total, 1).astype(np.float64))) / np.log(10)
        left = np.flatnonzero(~fine)
        for i in range(0, len(left), BLOCK):
            at = left[i : i + BLOCK]
            out[at] = _log10_share(q[at], table, output[at], np.empty(BLOCK * self.outputs, np.float32))
        return out

    @cached_property
    def powers(self) -> list[np.ndarray]:
        """By position, exp(q . R[class]) of each context alone; the first with exp(b[class]).

        Scores are cut off at +-LARGE / 3: a context that has larger ones is marked, and its tokens' sums are taken plainly.
        """
        out = []
        for k, (_, table) in enumerate(self.tables):
            s = table @ self.r.T
            marked = np.abs(s).max(axis=1) > LARGE / 3
            s = np.exp(np.clip(s, -LARGE / 3, LARGE / 3))
            if k == 0:
                s *= np.exp(self.b)
            s[marked] = np.nan
            out.append(s)
        return out

    @cached_property
    def biased_words(self) -> list[np.ndarray]:
        return [_biased(*x) for x in self.words]

    def word_log10(self, q: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """log10 P(w | class, q) of words of the head, by products of a class's tokens with its words; at: their rows of q."""
        own = self.class_of.take(rank)
        order = np.argsort(own.astype(np.uint16) if self.classes < 1 << 16 else own, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=self.classes))])
        at = at.take(order)
        q, place = q.take(at, axis=0), self.place_of.take(rank.take(order))
        shares, out = np.empty(len(at)), np.empty(len(at))
        held = np.empty(BLOCK * max((len(g) for g in self.members), default=0), np.float32)
        for k in np.flatnonzero(np.diff(cuts)):
            table = self.biased_words[k]
            for i in range(cuts[k], cuts[k + 1], BLOCK):
                part = slice(i, min(i + BLOCK, cuts[k + 1]))
                shares[part] = _log10_share(q[part], table, place[part], held)
        out[order] = shares
        return out

    def log10(self, q: np.ndarray, contexts: list[np.ndarray], rank: np.ndarray, output: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token; of a word outside the head without its own count."""
        out = self.class_log10(q, contexts, output) + np.log1p(-(10.0**self.unseen)) / np.log(10) if self.total else np.zeros(len(q))
        near = rank < self.head
        at = np.flatnonzero(near)
        out[at] += self.word_log10(q, at, rank.take(at))
        out[~near] -= np.log10(np.maximum(self.tails[output[~near] - self.classes], 1)) if self.total else 0
        return out


def _biased(x: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """x with one more column, column by column."""
    return np.ascontiguousarray(np.concatenate([x, bias[:, None]], axis=1).T, np.float32)


def _log10_share(q: np.ndarray, table: np.ndarray, at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """log10 of the softmax of each row of q over the columns of table, at one of them; held: room for the scores.

    Scores are rarely far from 0, so that the largest is taken off only in rows that need it.
    """
    held = held[: len(q) * table.shape[1]]
    s = np.matmul(q, table, out=held.reshape(len(q), -1))
    own = held.take(np.arange(0, len(held), table.shape[1]) + at).astype(np.float64)
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
        total = (s @ np.ones(s.shape[1], np.float32)).astype(np.float64)
    fine = (total > SMALL) & (total < 1 / SMALL)
    out = (own - np.log(np.where(fine, total, 1.0))) / np.log(10)
    if not fine.all():
        left = np.flatnonzero(~fine)
        s = (q[left] @ table).astype(np.float64)
        s -= s.max(axis=1, keepdims=True)
        out[left] = (s[np.arange(len(left)), at[left]] - np.log(np.exp(s).sum(axis=1))) / np.log(10)
    return out


class Shard:
    """A shard's network in a round: steps of noise-contrastive estimation with rates by the squares of all gradients so far."""

    def __init__(self, model: Model, rows: np.ndarray, squares: np.ndarray, seed: tuple[int, ...]):
        self.model, self.rows, self.squares = model, rows.copy(), squares.copy()
        self.rng = np.random.default_rng(seed)
        noise = model.sizes / model.sizes.sum()
        self.noise_total, self.log_noise = np.cumsum(noise), np.log(np.maximum(NOISE * noise, 1e-30)).astype(np.float32)
        self.places, self.used = 0, np.zeros(model.contexts)
        self.local = np.zeros(model.contexts, np.int64)
        self.room = [np.empty((BATCH, n), np.float32) for n in (WIDTH + 1, WIDTH, WIDTH + 1, NOISE, WIDTH + 1)]

    def weights(self) -> np.ndarray:
        """What each row counts for in the mean of all shards."""
        return np.concatenate([self.used, np.full(len(self.rows) - len(self.used), float(self.places))])

    def take(self, context: np.ndarray, target: np.ndarray, progress: tuple[float, float]) -> None:
        """Steps over all these places, in an order of their own; context: by position, each with its own numbers."""
        order = self.rng.permutation(len(target))
        self.places += len(target)
        for k, at in enumerate(context):
            self.used += np.bincount(at - k * self.model.contexts, minlength=self.model.contexts)
        cuts = np.linspace(0, len(target), -(-len(target) // BATCH) + 1).astype(np.int64)
        for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = order[i:j]
            at = progress[0] + (progress[1] - progress[0]) * k / (len(cuts) - 1)
            self._step([c[part] for c in context], target[part], 0.3 * (1 - 0.9 * min(at, 1.0)))

    def _step(self, context: list[np.ndarray], target: np.ndarray, rate: float) -> None:
        n, contexts = len(target), self.model.contexts
        q, x, own, down, g = (a[:n] for a in self.room)
        # the rows of a step: E's for the contexts that it has, and all of R, b and C
        met = np.zeros(contexts, bool)
        context = [at - k * contexts for k, at in enumerate(context)]
        for at in context:
            met[at] = True
        used = np.flatnonzero(met)
        self.local[used] = np.arange(len(used))
        context = [self.local.take(at) for at in context]
        live = np.concatenate([used, np.arange(contexts, len(self.rows))])
        rows, grad = self.rows.take(live, axis=0), np.zeros((len(live), WIDTH + 1), np.float32)
        e, r, c = self.model.parts(rows, len(used))
        e_grad, r_grad, c_grad = self.model.parts(grad, len(used))
        e, mixed = np.ascontiguousarray(e), np.concatenate(c, axis=1)
        table = (e @ mixed).reshape(-1, WIDTH)
        q[:, :WIDTH], q[:, WIDTH] = table.take(context[0] * POSITIONS, axis=0, out=x, mode="clip"), 1
        for k, at in enumerate(context[1:], 1):
            q[:, :WIDTH] += table.take(at * POSITIONS + k, axis=0, out=x, mode="clip")
        # one set of noise classes for all places of a step: its scores are a matrix product
        drawn = np.searchsorted(self.noise_total, self.rng.random(NOISE) * self.noise_total[-1], side="right").clip(0, len(r) - 1)
        bad = r[drawn]
        r.take(target, axis=0, out=own, mode="clip")
        less = bad.copy()
        less[:, WIDTH] -= self.log_noise[drawn]
        with np.errstate(over="ignore"):
            up = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) - self.log_noise[target]))
            np.exp(np.matmul(q, -less.T, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        np.matmul(down, bad, out=g)
        own *= up[:, None]
        g += own
        columns, pulled = np.ascontiguousarray(g.T), (q * up[:, None]).T.astype(np.float64)
        for j in range(WIDTH + 1):
            r_grad[:, j] = np.bincount(target, pulled[j], len(r))
        np.add.at(r_grad, drawn, down.T @ q)
        by_context = np.zeros((POSITIONS * WIDTH, len(used)), np.float32)
        for k, at in enumerate(context):
            for j in range(WIDTH):
                np.add.at(by_context[k * WIDTH + j], at, columns[j])
        e_grad[:] = (mixed @ by_context).T
        for m, own_grad in zip(c_grad, np.split(by_context @ e, POSITIONS), strict=True):
            m[:] = own_grad.T
        grad *= 100 / n
        squares = self.squares.take(live, axis=0)
        squares += grad * grad
        self.squares[live] = squares
        grad *= rate
        for m in c_grad:
            m *= 0.1
        grad /= np.sqrt(squares, out=squares)
        rows += grad
        self.rows[live] = rows


def _added(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by place."""
    order = np.argsort(where, kind="stable")
    at, first = np.unique(where[order], return_index=True)
    out = np.zeros((n, *values.shape[1:]))
    out[at] = np.add.reduceat(values[order], first, axis=0)
    return out


def _unique(words: np.ndarray, n: np.ndarray | None, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words once each, with the sums of n (None: how often they occur) and their suffix classes."""
    order = np.argsort(words)
    words = words[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(words))) if n is None else np.add.reduceat(n[order], first) if len(words) else n
    return words[first], n, suffix[order[first]]


def _summed(counts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words with counts and suffix classes, summed over as many as HELD at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for x in counts:
        held.append(x)
        size += len(x[0])
        if size > HELD:
            held = [_unique(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > HELD // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield _unique(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _count_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (tokens(words) for part in parts for _, words in batches(part.column(0), WORDS_SPACE))
    for hashes, n, suffix in _summed(_unique(hashes, None, suffix) for hashes, suffix, _ in found):
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n), pa.array(suffix.astype(np.int16))], names=["word", "n", "suffix"])


def _placed(model: Model, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes, counts in the head, places in it, codes, documents' bounds) of all tokens."""
    for row, words in batches(texts, WORDS_SPACE):
        hashes, suffix, bounds = tokens(words)
        count, rank = model.look_up(hashes)
        yield row, hashes, count, rank, model.codes(rank, suffix), bounds


def _encode(shared, shards: int, rounds: int):
    """(round, shard, key, low, high): each document's codes, the low two bytes and the others of each, dealt by its key."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            keys = part.column(1).to_numpy(zero_copy_only=False)
            for row, _, _, _, codes, bounds in _placed(model, part.column(0)):
                n = len(bounds) - 1
                own = keys[row : row + n]
                cell = mix(own.view(np.uint64))
                planes = [
                    pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds * x.itemsize), pa.py_buffer(x)]).cast(pa.binary())
                    for x in ((codes & 0xFFFF).astype("<u2"), (codes >> 16).astype(np.uint8))
                ]
                dealt = [pa.array(x.astype(np.int32)) for x in (cell // np.uint64(shards) % np.uint64(rounds), cell % np.uint64(shards))]
                yield pa.RecordBatch.from_arrays([*dealt, pa.array(own), *planes], names=["round", "shard", "key", "low", "high"])

    return run


def _decoded(low: pa.Array, high: pa.Array, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, documents' bounds) of runs of documents with about `step` tokens."""
    if not len(high):
        return
    low, high = low.cast(pa.large_binary()), high.cast(pa.large_binary())
    offsets = np.frombuffer(high.buffers()[1], np.int64)[high.offset : high.offset + len(high) + 1]
    first = np.frombuffer(low.buffers()[1], np.int64)[low.offset]
    size = offsets[-1] - offsets[0]
    codes = np.frombuffer(low.buffers()[2], "<u2", size, first).astype(np.int64)
    codes |= np.frombuffer(high.buffers()[2], np.uint8, size, offsets[0]).astype(np.int64) << 16
    offsets = offsets - offsets[0]
    i = 0
    while i < len(high):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
        yield codes[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _sum_words(shared):
    """(rank, n, s0, s1, ...): a task's sums of the vectors that stand beside each word of the head, and each class of others; sums of their products."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        places = np.concatenate([np.arange(model.head), model.head + np.arange(SUFFIXES) % TAILS])
        near, square = np.zeros((WIDTH + 1, model.head + TAILS)), np.zeros((WIDTH, WIDTH))
        for part in parts:
            for codes, bounds in _decoded(part.column(0), part.column(1), SUMMED):
                at = places.take(codes)
                q, v = model.vectors(codes, bounds), np.empty((WIDTH, len(codes)))
                for i in range(0, len(q), BLOCK):
                    v[:, i : i + BLOCK] = q[i : i + BLOCK, :WIDTH].T
                for j in range(WIDTH):
                    near[j] += np.bincount(at, v[j], near.shape[1])
                near[WIDTH] += np.bincount(at, minlength=near.shape[1])
                square += v @ v.T
        used = np.flatnonzero(near[WIDTH])
        rank, n = np.append(used, near.shape[1] + np.arange(WIDTH)), np.append(near[WIDTH, used], np.zeros(WIDTH)).astype(np.int64)
        sums = np.concatenate([near[:WIDTH, used], square], axis=1).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(n), *(pa.array(x) for x in sums)], names=["rank", "n", *SUMS])

    return run


SUMS = [f"s{j}" for j in range(WIDTH)]


def _word_sums(encoded: DataFrame, model: Model, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums of the head's words, of the other words' classes, counts of those, sums of products); at most as many rows as words in the head and classes."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rows = encoded.select("low", "high").coalesce(tasks).mapInArrow(_sum_words(shared), f"rank long, n long, {', '.join(f'{c} float' for c in SUMS)}")
    table = rows.groupBy("rank").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in SUMS)).toArrow()
    shared.destroy()
    last = model.head + TAILS
    rank, out, n = table["rank"].to_numpy(), np.zeros((last + WIDTH, WIDTH)), np.zeros(last + WIDTH)
    out[rank] = np.stack([table[c].to_numpy() for c in SUMS], axis=1) if len(rank) else 0
    n[rank] = table["n"].to_numpy()
    return out[: model.head], out[model.head : last], n[model.head : last], out[last:]


ROWS = [f"{x}{j}" for x in "pq" for j in range(WIDTH + 1)]


def _train_shards(shared, turn: tuple[float, float], places: float, epochs: int, seed: int):
    """(row, weight, p0, ..., q0, ...): the weighted sums of the networks and squares of a task's shards after a round."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows, squares = shared.value
        sums, weights = np.zeros((len(rows), 2 * (WIDTH + 1))), np.zeros(len(rows))
        now, shard = None, None

        def windows(codes, bounds):
            return [model.context(codes, bounds, k + 1) + k * model.contexts for k in range(POSITIONS)], model.output(codes)

        def add() -> None:
            if shard is not None:
                own = shard.weights()
                sums[:] += own[:, None] * np.concatenate([shard.rows, shard.squares], axis=1)
                weights[:] += own

        def between(share: float) -> float:
            return turn[0] + (turn[1] - turn[0]) * min(share, 1.0)

        held = []
        for part in parts:
            owner = part.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if owner[i] != now:
                    add()
                    now, shard = owner[i], Shard(model, rows, squares, (seed, int(owner[i])))
                for codes, bounds in _decoded(part.column(1)[i:j], part.column(2)[i:j], MIXED):
                    if epochs > 1:
                        held.append((codes, bounds))
                    else:
                        shard.take(*windows(codes, bounds), (between(shard.places / places), between((shard.places + len(codes)) / places)))
        # one shard that is taken again: fewer than STEPS * BATCH places
        if held:
            found = [windows(*x) for x in held]
            context, target = [np.concatenate([c[k] for c, _ in found]) for k in range(POSITIONS)], np.concatenate([t for _, t in found])
            for k in range(epochs):
                shard.take(context, target, (k / epochs, (k + 1) / epochs))
        add()
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used]), *(pa.array(x) for x in sums[used].T.astype(np.float32))], names=["row", "weight", *ROWS])

    return run


def _trained(encoded: DataFrame, model: Model, shards: int, rounds: int) -> np.ndarray:
    """The network after its training on all places."""
    rows, squares = model.start()
    # a single shard is read by one task, and taken as often as STEPS steps need
    epochs = max(1, -(-STEPS * BATCH // max(model.total, 1))) if shards == 1 else 1
    for k in range(rounds if model.total else 0):
        shared = encoded.sparkSession.sparkContext.broadcast((model, rows, squares))
        own = encoded.where(F.col("round") == k).select("shard", "low", "high")
        if shards == 1:
            own = own.coalesce(1)
        run = _train_shards(shared, (k / rounds, (k + 1) / rounds), max(model.total / shards / rounds, 1), epochs, k)
        found = own.mapInArrow(run, f"row long, weight double, {', '.join(f'{c} float' for c in ROWS)}")
        table = found.groupBy("row").agg(F.sum("weight").alias("weight"), *(F.sum(c).alias(c) for c in ROWS)).toArrow()
        shared.destroy()
        if len(table):
            at = table["row"].to_numpy()
            mean = np.stack([table[c].to_numpy() for c in ROWS], axis=1) / table["weight"].to_numpy()[:, None]
            rows[at], squares[at] = mean[:, : WIDTH + 1], mean[:, WIDTH + 1 :]
    return rows


def _once(words: np.ndarray, gain: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each document's words once, with how often they occur in it and the sums of gain, and documents + 1 places in them."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.int64), np.diff(bounds))
    order = np.argsort(words)
    order = order.take(np.argsort(doc.take(order), kind="stable"))
    words, doc = words.take(order), doc.take(order)
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1]))) if len(words) else np.zeros(0, np.int64)
    sums = np.add.reduceat(gain.take(order), first) if len(words) else gain
    return words.take(first), np.diff(np.append(first, len(words))), sums, np.searchsorted(first, bounds)


def _score(shared):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        types = np.log10(model.total + model.types + 1)
        row_of_task = 0
        first_uid = TaskContext.get().partitionId() << 40
        for part in parts:
            for row, hashes, count, rank, codes, bounds in _placed(model, part.column(2)):
                n = len(bounds) - 1
                known = count > 0
                base = np.where(known, np.log10(np.maximum(count, 0) + 1), 0.0) - types
                contexts = [model.context(codes, bounds, back) for back, _ in model.tables]
                score = model.log10(model.vectors(codes, bounds, contexts), contexts, rank, model.output(codes))
                far = np.flatnonzero(~known)
                # a word that turns out to have been seen gets the difference, and its count
                seen, score[far] = score[far], model.unseen
                word, times, gain, far_bounds = _once(hashes[far], seen - model.unseen, np.searchsorted(far, bounds))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first_uid + row_of_task + np.arange(n)),
                        part.column(0)[row : row + n],
                        part.column(1)[row : row + n],
                        pa.array(np.diff(bounds)),
                        pa.array(np.add.reduceat(known, bounds[:-1]).astype(np.int64)),
                        pa.array(np.add.reduceat(base, bounds[:-1])),
                        pa.array(np.add.reduceat(score, bounds[:-1])),
                        pa.ListArray.from_arrays(
                            pa.array(far_bounds.astype(np.int32)),
                            pa.StructArray.from_arrays([pa.array(word.view(np.int64)), pa.array(times.astype(np.int32)), pa.array(gain.astype(np.float32))], names=["word", "times", "gain"]),
                        ),
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
                row_of_task += n

    return run


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, frequent: int = FREQUENT) -> tuple[Model, DataFrame]:
    """The model of all of docs, and the table (word, n, suffix) of all words."""
    text, context = docs.select(F.col(text_col).alias("text")), docs.sparkSession.sparkContext
    keyed = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"))
    words = text.mapInArrow(_count_words, "word long, n long, suffix short").groupBy("word").agg(F.sum("n").alias("n"), F.max("suffix").alias("suffix"))
    words = staged(words, "words")
    row = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = words.orderBy(F.desc("n"), "word").limit(head).toArrow()
    hashes, counts, suffixes = (top.column(c).to_numpy() for c in ("word", "n", "suffix"))
    model = Model(hashes.view(np.uint64), counts, suffixes, row[1], row[0], frequent)
    shards = max(1, model.total // (STEPS * BATCH))
    rounds = ROUNDS if shards > 1 else 1
    shared = context.broadcast(model)
    encoded = keyed.mapInArrow(_encode(shared, shards, rounds), "round int, shard int, key long, low binary, high binary")
    # in an order that depends on the documents alone
    encoded = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("round", "shard", "key", "low", "high")
    encoded = staged(encoded, "codes", "round")
    shared.destroy()
    tasks = max(shards, context.defaultParallelism)
    model.look_around()
    near, _, tails, _ = _word_sums(encoded, model, tasks)
    model.cluster(near, tails)
    model.use(_trained(encoded, model, shards, rounds))
    sums, tail_sums, _, square = _word_sums(encoded, model, tasks)
    model.fit_words(sums, tail_sums, square)
    drop(docs.sparkSession, encoded)
    return model, words


def score_texts(docs: DataFrame, model: Model, words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs; held_out is a column of docs."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(
        _score(context.broadcast(model)),
        f"uid long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:long,times:int,gain:float>>",
    )
    scored = staged(scored, "scored")
    rare = scored.select("uid", F.inline("rare")).join(words.select("word", "n"), "word")
    rare = rare.groupBy("uid").agg(
        F.sum("times").alias("known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"),
        F.sum(F.col("gain") + F.col("times") * F.log10(F.col("n"))).alias("score_more"),
    )
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.drop("rare").join(rare, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )
