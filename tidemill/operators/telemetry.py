"""Runs, tools, budgets and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tool_paths(runs: DataFrame, calls: DataFrame, group: str = "skill", least_runs: int = 50, least_share: float = 0.9, least_path: int = 2) -> DataFrame:
    """The commonest ordered tool path of each group, where enough runs take it.

    runs: run_id and the group.  calls: run_id, tool_name, executed_at.
    """
    paths = calls.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("executed_at", "tool_name"))), lambda c: c["tool_name"]).alias("path"))
    counted = runs.join(paths, "run_id").groupBy(group, "path").agg(F.count("*").alias("n"))
    each = counted.groupBy(group).agg(F.sum("n").alias("runs"), F.max_by("path", F.struct("n", F.to_json("path"))).alias("path"), F.max("n").alias("of_path"))
    out = each.withColumn("share", F.col("of_path") / F.col("runs"))
    return out.where((F.col("runs") >= least_runs) & (F.col("share") >= least_share) & (F.size("path") >= least_path))


def run_averages(runs: DataFrame, group: str) -> DataFrame:
    return runs.groupBy(group).agg(F.bround(F.avg("total_latency_ms"), 1).alias("avg_latency_ms"), F.bround(F.avg("llm_call_count"), 2).alias("avg_calls"))


#: ranges that a group's values are divided into
RANGES = 64


def indexed_percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50 and p95 as the values at places n // 2 and int(0.95 n) of the sorted list, with least and most; nulls don't count.

    Approximate quantiles divide each group's values into ranges, whose exact counts tell which range
    has a place; only the rows of those ranges are ranked, each range by itself.
    """
    df = df.select(*by, F.col(value).alias("_v")).where("_v is not null")
    cuts = df.groupBy(*by).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"), F.count("*").alias("_n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    ranged = df.join(cuts.select(*by, "_cuts"), by).select(*by, "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_r"))
    counts = ranged.groupBy(*by, "_r").agg(F.count("*").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = cuts.select(*by, F.explode(F.create_map(F.lit("p50"), F.floor(F.col("_n") / 2), F.lit("p95"), F.floor(F.col("_n") * 0.95))).alias("_name", "_place"))
    wanted = counts.withColumn("_before", before).join(places, by).where("_place >= _before and _place < _before + _in").select(*by, "_r", "_name", (F.col("_place") - F.col("_before") + 1).alias("_at"))
    own = ranged.join(wanted.select(*by, "_r").distinct(), [*by, "_r"], "left_semi")
    ranked = own.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_v"))).join(wanted, [*by, "_r"]).where("_i = _at")
    named = ranked.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == p, F.col("_v"))).alias(p) for p in ("p50", "p95")))
    return named.join(cuts.select(*by, "least", "most"), by)


def config_report(items: DataFrame, config: str = "config", metrics: str = "metrics") -> DataFrame:
    """Mean of each metric under each configuration, with how many items measured it."""
    rows = items.select(config, F.explode(metrics).alias("metric", "value"))
    return rows.groupBy(config, "metric").agg(F.bround(F.avg("value"), 4).alias("mean"), F.count("value").alias("measured"))


def simulated_scores(chunks: DataFrame, wanted: Column, keywords: str = "keywords") -> DataFrame:
    """Benchmark scores of chunks without a model: shares of a query's keywords.

    dense: of the keywords; sparse: those that the text itself has; hybrid: their mean.
    """
    n = F.greatest(F.size(wanted), F.lit(1))
    dense = F.size(F.array_intersect(F.col(keywords), wanted)) / n
    sparse = F.size(F.filter(wanted, lambda w: F.contains(F.lower("content_raw"), F.lower(w)))) / n
    return chunks.withColumns({"dense_score": dense, "sparse_score": sparse, "hybrid_score": (dense + sparse) / 2})


def gold_scores(items: DataFrame, split: str) -> DataFrame:
    """Gold items of a split, each with: quotes found in the retrieved texts, all words that must be in the answer are, abstained as asked.

    items: split, gold_quotes, retrieved (array of texts), must_include, answer, should_abstain, abstained.
    """
    own = items.where(F.col("split") == split)
    quote = F.size(F.filter("gold_quotes", lambda q: F.exists("retrieved", lambda t: F.contains(t, q)))) / F.nullif(F.size("gold_quotes"), F.lit(0))
    included = F.forall("must_include", lambda w: F.contains(F.lower("answer"), F.lower(w)))
    return own.withColumns({"quote_hit": quote, "included": included, "abstains": F.col("should_abstain") == F.col("abstained")})


def metric_means(items: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Mean of each metric over the items that measured it, with how many did and did not."""
    rows = items.select(F.explode(metrics).alias("metric", "value"))
    return rows.groupBy("metric").agg(F.bround(F.avg("value"), 4).alias("mean"), F.count("value").alias("measured"), F.count_if(F.col("value").isNull()).alias("skipped"))


def regressions(baseline: DataFrame, current: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Metrics that fell by more than the tolerance."""
    both = baseline.select("metric", F.col("mean").alias("before")).join(current.select("metric", F.col("mean").alias("now")), "metric")
    return both.where(F.col("now") < F.col("before") - tolerance)


def first_breach(usage: DataFrame, by: str, order: str, amount: str, limit: Column) -> DataFrame:
    """The first row of each run whose running total is over the limit."""
    running = F.sum(amount).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    over = usage.withColumn("running", running).where(F.col("running") > limit)
    return over.groupBy(by).agg(F.min_by(F.struct(order, "running"), order).alias("r")).select(by, "r.*")


def project_outbox(rows: DataFrame, kinds: dict[str, str]) -> dict[str, DataFrame]:
    """Rows split by kind, each once by its outbox id; target name for each kind."""
    once = rows.dropDuplicates(["outbox_id"])
    return {target: once.where(F.col("event_kind") == kind) for kind, target in kinds.items()}


def tallies(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("doc_category").agg(F.count("*").alias("n"), F.sum(F.col("needs_review").cast("long")).alias("needs_review"))


MOST_RULES = 10_000


def classify(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Best category by weighted markers; the margin to the second is the confidence.

    docs: document_id, title, filename, body (folded).  rules: category, kind (title, filename or
    marker), pattern, position: configuration that goes to every worker, MOST_RULES at most.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules are no configuration")
    hits = docs.join(F.broadcast(rules), F.contains(F.when(F.col("kind") == "title", F.col("title")).when(F.col("kind") == "filename", F.col("filename")).otherwise(F.col("body")), F.col("pattern")))
    title = F.max(F.when(F.col("kind") == "title", 3 * (1 - 0.02 * F.col("position"))))
    filename = F.max(F.when(F.col("kind") == "filename", 1.5))
    markers = 0.7 * F.least(F.count(F.when(F.col("kind") == "marker", 1)), F.lit(3))
    scored = hits.groupBy("document_id", "category").agg((F.coalesce(title, F.lit(0.0)) + F.coalesce(filename, F.lit(0.0)) + markers).alias("score"))
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "category")
    ranked = scored.withColumns({"n": F.row_number().over(order), "second": F.coalesce(F.lead("score").over(order), F.lit(0.0))}).where("n = 1")
    return ranked.select("document_id", "category", "score", F.bround(F.least(F.lit(1.0), (F.col("score") - F.col("second")) / F.col("score")), 4).alias("confidence"))
