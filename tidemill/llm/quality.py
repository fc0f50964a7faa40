"""Quality classifier: a sparse rule ensemble compiled into column expressions.

1. Statistics of the whole text, as built-in column functions (STATISTICS).
2. Boosted regression trees on the statistics of a bounded sample of labelled
   rows (`sample_rows` on average, drawn by a hash of doc_id).
3. Every path from a root to a node is a conjunctive rule; a lasso-penalised
   logistic regression over all rules keeps few of them.
4. The rules left are compiled into one Spark column: the score needs no Python.

Nulls and empties: a null text has the statistics of an empty one (all 0) and
gets a score as any other.  Without labels to learn from, the score is 1.
Labels are only read from rows where `learn` holds; where a doc_id has several
labels or texts, each pair of them is learned from.  Repeated rows are scored row
by row; very long texts are measured whole; other columns are kept, but for one of
the score's name.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 3
LEAST = 30
BINS = 64
PENALTY = 4e-4
MARKS = "|!%#$&*@<{/\\=~^_"


NAMES = ("chars", "words", "word_length", "distinct_words", "upper_words", "lines", "line_length", "distinct_lines", "bars", "shouts", "marks", "stops", "commas", "digits")


def measured(text: Column) -> Column:
    """The statistics NAMES of a text as an array of doubles: one expression that holds each costly part once."""
    text = F.coalesce(text, F.lit(""))
    parts = F.struct(
        text.alias("t"),
        F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("l"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    def values(p: Column) -> Column:
        chars, words, n, lines = F.length(p["t"]), p["w"], F.size(p["w"]), F.size(p["l"])

        def count(mark: str) -> Column:
            return chars - F.length(F.replace(p["t"], F.lit(mark)))

        marks = count(MARKS[0])
        for m in MARKS[1:]:
            marks = marks + count(m)
        return F.array(
            chars.cast("double"),
            n.cast("double"),
            share(chars, n),
            share(F.size(F.array_distinct(words)), n),
            share(F.size(F.filter(words, lambda w: (w == F.upper(w)) & (F.lower(w) != w))), n),
            lines.cast("double"),
            share(chars, lines),
            share(F.size(F.array_distinct(p["l"])), lines),
            share(count("|"), n),
            share(count("!"), n),
            share(marks, n),
            share(count("."), n),
            share(count(","), n),
            share(F.size(F.filter(words, lambda w: w.rlike("[0-9]"))), n),
        )

    return F.transform(F.array(parts), values)[0]


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with the statistics of its texts, in columns whose names are returned."""
    names = [f"__tidemill_{k}" for k in NAMES]
    values = docs.withColumn("__tidemill_values", measured(F.col(text_col)))
    return values.withColumns({n: F.col("__tidemill_values")[k] for k, n in enumerate(names)}).drop("__tidemill_values"), names


@dataclass(frozen=True)
class Rule:
    """low < value <= high of each statistic (by place), all at once."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, low, high in self.bounds:
            out &= (x[:, k] > low) & (x[:, k] <= high)
        return out

    def column(self, values: list[Column]) -> Column:
        out = F.lit(True)
        for k, low, high in self.bounds:
            if low > -np.inf:
                out = out & (values[k] > low)
            if high < np.inf:
                out = out & (values[k] <= high)
        return out


def _split(codes: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """(gain, statistic, bin) of the best split of some rows."""
    best = (1e-6, -1, -1)
    for k in range(codes.shape[1]):
        own = codes[rows, k]
        gs, hs, ns = (np.bincount(own, w, BINS + 1) for w in (g[rows], h[rows], None))
        gl, hl, nl = np.cumsum(gs), np.cumsum(hs), np.cumsum(ns)
        gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - gl[-1] ** 2 / (hl[-1] + 1)
        gain[(nl < LEAST) | (nl[-1] - nl < LEAST)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), k, at)
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted trees as rules."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        level = [(np.arange(len(y)), {})]
        for d in range(depth + 1):
            following = []
            for rows, bounds in level:
                if bounds:
                    found[Rule(tuple((k, *v) for k, v in sorted(bounds.items())))] = None
                gain, k, at = _split(codes, rows, g, h) if d < depth and len(rows) >= 2 * LEAST else (0, -1, -1)
                if k < 0 or at >= len(cuts[k]):
                    margin[rows] += 0.3 * g[rows].sum() / (h[rows].sum() + 1)
                    continue
                cut, low = float(cuts[k][at]), codes[rows, k] <= at
                a, b = bounds.get(k, (-np.inf, np.inf))
                following += [(rows[low], bounds | {k: (a, min(b, cut))}), (rows[~low], bounds | {k: (max(a, cut), b)})]
            level = following
    return list(found)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n, m = r.shape
    r = r.astype(np.float64)
    w, at, b, b_at, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    probe = np.ones(m)
    for _ in range(20):
        probe = r.T @ (r @ probe)
        norm = np.linalg.norm(probe)
        probe /= norm or 1
    rate = 1 / (0.25 * ((norm or 1) / n + 1))
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(r @ at + b_at))) - y
        w_next = at - rate * (r.T @ miss) / n
        w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - rate * penalty, 0)
        b_next = b_at - rate * miss.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, b_at = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return float(b), w


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            margin += weight * rule.holds(x)
        return 1 / (1 + np.exp(-margin))

    def column(self, values: list[Column]) -> Column:
        """The score as one expression over the statistics."""
        parts = [F.lit(self.intercept), *(F.when(rule.column(values), weight).otherwise(0.0) for weight, rule in self.rules)]
        while len(parts) > 1:
            parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return 1 / (1 + F.exp(-parts[0]))


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(40.0 if len(y) == 0 or y[0] else -40.0, ())
    rules = grow_rules(x, y)
    b, w = lasso_logistic(np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0)), y)
    return RuleEnsemble(b, tuple((float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-4))


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """An ensemble from the labelled rows where `learn` (over the label's id column) holds."""
    usable = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
    total = usable.count()
    if not total:
        return fit(np.zeros((0, 1)), np.zeros(0))
    if total > sample_rows:
        usable = usable.where(F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    # at most about sample_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(usable), "_id")
    measured, names = statistics(rows, "_text")
    table = measured.select("_y", *names).toArrow()
    columns = [table[c].to_numpy() for c in ["_y", *names]]
    return fit(np.stack(columns[1:], axis=1), (columns[0] > 0.5).astype(float))


def scored(docs: DataFrame, model: RuleEnsemble, *, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """docs with a column for the score; one of that name is replaced.

    The score is one expression that holds each statistic once: a filter on it, which the optimiser
    moves below the projection, does not compute the statistics again for each use in a rule.
    """

    def score(v: Column) -> Column:
        return model.column([v[k] for k in range(len(NAMES))])

    return docs.withColumn(out_col, F.transform(F.array(measured(F.col(text_col))), score)[0])
