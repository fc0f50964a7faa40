"""Conversations, memories and contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import C, col, fold, fold_value, folded_words
from .sizes import BROADCAST_BYTES, broadcast_if_small

#: queries that are joined at once
QUERY_BLOCK = 1000


def message_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with its number of messages, none being 0."""
    counted = messages.groupBy("conversation_id").agg(F.count("*").alias("n"))
    return conversations.join(counted, "conversation_id", "left").withColumn("n_messages", F.coalesce("n", F.lit(0))).drop("n")


def last_messages(messages: DataFrame, n: int, order: str = "turn") -> DataFrame:
    """The last n messages of each conversation, oldest first by `place`."""
    back = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc(order)))
    kept = messages.withColumn("_back", back).where(F.col("_back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy(order))).drop("_back")


def latest_of_role(messages: DataFrame, role: str, order: str = "turn") -> DataFrame:
    return messages.where(F.col("role") == role).groupBy("conversation_id").agg(F.max_by("content", order).alias("content"), F.max(order).alias(order))


def compaction_cut(messages: DataFrame, window_tokens: int, pressure: float = 0.75, tokens: str = "tokens", order: str = "turn") -> DataFrame:
    """For conversations at or over the pressure: the last message of the first half, a tool's call never parted from its result.

    A cut that would fall before a tool's result moves behind it.
    """
    w = Window.partitionBy("conversation_id")
    by = w.orderBy(order)
    rows = messages.withColumns({"_n": F.row_number().over(by), "_of": F.count("*").over(w), "_total": F.sum(tokens).over(w), "_next": F.lead("role").over(by)})
    late = rows.where((F.col("_total") >= window_tokens * pressure) & (F.col("_n") >= F.floor(F.col("_of") / 2)) & F.coalesce(F.col("_next") != "tool", F.lit(True)))
    return late.groupBy("conversation_id").agg(F.min(order).alias("cut_after"), F.max("_total").alias("total_tokens"))


def pruned_tool_results(messages: DataFrame, keep: int = 3, most: int = 2000, order: str = "turn") -> DataFrame:
    """Tool results before a conversation's last `keep` of them, if longer than `most` characters, as a marker with their size."""
    back = F.row_number().over(Window.partitionBy("conversation_id", "role").orderBy(F.desc(order)))
    size = F.length("content")
    old = (F.col("role") == "tool") & (F.col("_back") > keep) & (size > most)
    marker = F.concat(F.lit("[tool result pruned: "), size.cast("string"), F.lit(" characters]"))
    return messages.withColumn("_back", back).withColumns({"content": F.when(old, marker).otherwise(F.col("content")), "pruned": F.coalesce(old, F.lit(False))}).drop("_back")


def owned(children: DataFrame, parents: DataFrame, key: str, requester: str, owner: str = "user_id") -> DataFrame:
    """Rows whose parent is the requester's own: messages of conversations, evidence of runs."""
    return children.join(parents.where(F.col(owner) == requester).select(key), key, "left_semi")


def last_seen(items: DataFrame, kind: str, n: int, by: str = "conversation_id", at: str = "seen_at", key: str = "item_id") -> DataFrame:
    """The n items of a kind that a conversation saw last, each once, newest first by `place`."""
    once = items.where(F.col("kind") == kind).groupBy(by, key).agg(F.max(at).alias(at))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), key))).where(F.col("place") <= n)


def unread(notifications: DataFrame, by: str = "user_id", read_at: str = "read_at") -> DataFrame:
    """How many notifications each user has not read."""
    return notifications.groupBy(by).agg(F.count_if(F.col(read_at).isNull()).alias("unread"))


def matching_tasks(tasks: DataFrame, question: str, title: str = "title", done: str = "done") -> DataFrame:
    """Open tasks whose folded title has all words of two letters and more of a question."""
    words = [w for w in fold_value(question).split() if len(w) > 1]
    held = [F.contains(fold(title), F.lit(w)) for w in words]
    return tasks.where(~F.col(done) & (reduce(lambda a, b: a & b, held) if held else F.lit(False)))


def due_tasks(tasks: DataFrame, today: Column, due: str = "due", done: str = "done") -> DataFrame:
    """Open tasks that are due or overdue, in order of their due dates."""
    return tasks.where(~F.col(done) & (F.col(due) <= today)).orderBy(due)


def day_events(events: DataFrame, day: Column, most: int = 50, start: str = "start", status: str = "status") -> DataFrame:
    """The day's events that were not cancelled, by their start."""
    inside = (F.col(start) >= day.cast("timestamp")) & (F.col(start) < F.date_add(day, 1).cast("timestamp"))
    return events.where(inside & (F.coalesce(F.col(status), F.lit("")) != "cancelled")).orderBy(start).limit(most)


def busy_overlaps(wanted: DataFrame, busy: DataFrame, start: str = "start", end: str = "end", bucket: str = "1 hour") -> DataFrame:
    """(wanted_id, busy_id) of slots that overlap, by an equi-join on person and the hours that both touch.

    wanted: wanted_id, person, start, end.  busy: busy_id, person, start, end.  Ends are not part of a slot.
    """

    def hours(df: DataFrame, side: str) -> DataFrame:
        last = F.col(end) - F.make_interval(secs=F.lit(0.000001))
        touched = F.sequence(F.date_trunc("hour", F.col(start)), F.date_trunc("hour", last), F.expr(f"interval {bucket}"))
        return df.where(F.col(end) > F.col(start)).select(f"{side}_id", "person", F.col(start).alias(f"{side}_start"), F.col(end).alias(f"{side}_end"), F.explode(touched).alias("hour"))

    both = hours(wanted, "wanted").join(hours(busy, "busy"), ["person", "hour"])
    both = both.where("wanted_start < busy_end and busy_start < wanted_end")
    # in the first hour that both touch, so that a pair comes once
    first = F.greatest(F.date_trunc("hour", "wanted_start"), F.date_trunc("hour", "busy_start"))
    return both.where(F.col("hour") == first).select("wanted_id", "busy_id")


def memory_scores(memories: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """Memories by 0.7 * share of the query's words + 0.3 * importance; those without a word of it are left out.

    Queries are joined in blocks of about QUERY_BLOCK; adaptive execution broadcasts a block's words while
    they are small.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    terms = memories.select("memory_id", "importance", F.explode(F.array_distinct(F.split(fold("content"), r"[^\p{L}\p{N}]+"))).alias("word"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    out = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        words = part.select("query_id", F.explode(F.array_distinct(F.split(fold("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
        of = words.groupBy("query_id").agg(F.count("*").alias("n"))
        hits = terms.join(words, "word").groupBy("query_id", "memory_id", "importance").agg(F.count("*").alias("hits")).join(of, "query_id")
        scored = hits.withColumn("score", 0.7 * F.col("hits") / F.col("n") + 0.3 * F.col("importance"))
        scored = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "memory_id", "score", "rank")
        out = scored if out is None else out.union(scored)
    return out


def resolve_contacts(names: DataFrame, contacts: DataFrame) -> DataFrame:
    """EXACT, AMBIGUOUS or NOT_FOUND for each name by its folded form; contacts are unique by resource."""
    once = contacts.dropDuplicates(["resource"]).select(fold("display").alias("key"), "resource")
    found = names.withColumn("key", fold("name")).join(once, "key", "left")
    n = F.count("resource")
    return found.groupBy("name").agg(F.when(n == 1, "EXACT").when(n > 1, "AMBIGUOUS").otherwise("NOT_FOUND").alias("status"), F.when(n == 1, F.max("resource")).alias("resource"))


def alias_lookup(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities by any of their names or aliases."""
    keys = entities.select("entity_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda a: fold(a)))).alias("key"))
    return names.withColumn("key", fold("mention")).join(keys, "key").select("mention", "entity_id").distinct()


def dictionary_matches(texts: DataFrame, catalog: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Catalog names in texts as whole words, longest first without overlap.

    texts: text_id and the text.  catalog: name (folded).  A word is joined with the names that begin
    with it, and only then are the words behind it compared.  The catalog is the side that is sent out, if
    its counted bytes allow it: only matches are shuffled then, by text.  A larger one is shuffled by first
    words, and with it each word and as many behind it as the longest name has.
    """
    names = catalog.select("name").where(F.trim("name") != "").distinct().withColumn("words", F.split("name", " ")).withColumn("word", F.get("words", F.lit(0)))
    names, small = broadcast_if_small(names, broadcast_bytes)
    placed = texts.select("text_id", folded_words(text).alias("ahead")).select("text_id", "ahead", F.posexplode("ahead").alias("start", "word"))
    at = F.col("start")
    if not small:
        longest = names.select(F.max(F.size("words"))).first()[0]
        placed, at = placed.withColumn("ahead", F.slice("ahead", F.col("start") + 1, longest)), F.lit(0)
    size = F.size("words")
    hit = placed.join(names, "word").where((F.size("ahead") >= at + size) & (F.slice("ahead", at + 1, size) == F.col("words")))
    found = hit.select("text_id", "start", (F.col("start") + size).alias("end"), "name")
    # matches that overlap make a chain; within a chain the longest, then the first, is kept
    order = Window.partitionBy("text_id").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = found.withColumn("_new", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int")).withColumn("_chain", F.sum("_new").over(order))
    listed = chained.groupBy("text_id", "_chain").agg(F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("k"), "start", "end", "name"))).alias("m"))
    none = F.array().cast("array<struct<k:int,start:int,end:int,name:string>>")
    chosen = F.aggregate("m", none, lambda kept, x: F.when(F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), kept).otherwise(F.array_append(kept, x)))
    return listed.select("text_id", F.explode(F.when(F.size("m") == 1, F.col("m")).otherwise(chosen)).alias("m")).select("text_id", "m.start", "m.end", "m.name")


#: Words of the mail buckets, in order of precedence.
MAIL_WORDS = {
    "work": ("linkedin", "job", "career", "recruitment", "tuyen dung", "ung tuyen", "phong van", "interview", "hr", "offer", "hiring", "developer", "engineer"),
    "critical": (
        "canh bao", "bao mat", "security", "otp", "xac minh", "xac thuc", "ma dung mot lan", "mat ma", "ngan hang", "bank",
        "vpbank", "vietcombank", "techcombank", "giao dich", "transfer", "thanh toan", "payment", "invoice", "hoa don",
    ),
    "news": ("medium", "digest", "newsletter", "youtube", "dang ky", "hoi vien", "khuyen mai", "quang cao", "promo", "daily"),
}


def mail_bucket(*fields: C) -> Column:
    """work, critical, news or other: the first bucket of which a word is in the folded fields."""
    t = F.concat_ws(" ", *(fold(F.coalesce(col(f), F.lit(""))) for f in fields))
    out = F
    for bucket in MAIL_WORDS:
        out = out.when(t.rlike("|".join(MAIL_WORDS[bucket])), bucket)
    return out.otherwise("other")


def citations_of(messages: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Cited document ids in order of citation, from the messages' JSON."""
    listed = F.from_json(F.get_json_object(col(metadata), "$.data.citations"), "array<struct<document_id:string>>")
    return messages.select("message_id", F.posexplode(listed).alias("place", "c")).select("message_id", "place", "c.document_id")
