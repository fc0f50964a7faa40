"""Documents, versions and profiles: visibility, metadata queries, relations, upserts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_folded, document_number, fold, fold_value, number_matches, to_number


def visible(requester: str | None, owner: str = "user_id", active: str = "is_active") -> Column:
    """Active rows that are shared or the requester's own; nobody's requester sees shared ones only."""
    shared = F.col(owner).isNull()
    return F.col(active) & (shared if requester is None else shared | (F.col(owner) == requester))


@dataclass(frozen=True)
class MetadataFilter:
    categories: tuple[str, ...] = ()
    subtypes: tuple[str, ...] = ()
    date_from: date | None = None
    date_to: date | None = None
    doc_number: str | None = None
    issuer: str | None = None
    person: str | None = None
    operation: str = "list"
    limit: int = 50

    def conditions(self) -> list[Column]:
        out = []
        if self.categories:
            out.append(F.col("doc_category").isin(*self.categories))
        if self.subtypes:
            out.append(F.col("doc_subtype").isin(*self.subtypes))
        if self.date_from:
            out.append(F.col("doc_date") >= F.lit(self.date_from))
        if self.date_to:
            out.append(F.col("doc_date") <= F.lit(self.date_to))
        if self.doc_number:
            out.append(number_matches("doc_number_norm", "".join(c for c in fold_value(self.doc_number).upper() if c.isascii() and c.isalnum())))
        if self.issuer:
            out.append(F.contains("issuer_norm", F.lit(fold_value(self.issuer))))
        if self.person:
            out.append(F.contains("entity_names_norm", F.lit(fold_value(self.person))))
        return out


def query_metadata(documents: DataFrame, profiles: DataFrame, spec: MetadataFilter, requester: str | None) -> DataFrame:
    """count: one row with n; list: newest first, undated last, then title; latest: the first of those."""
    kept = documents.where(visible(requester)).withColumnRenamed("title", "file_name").join(profiles.drop("logical_document_id"), "document_id")
    kept = reduce(lambda df, c: df.where(c), spec.conditions(), kept)
    if spec.operation == "count":
        return kept.agg(F.count("*").alias("n"))
    rows = kept.select("document_id", F.coalesce("title", "file_name").alias("title"), "doc_category", "doc_subtype", "doc_number", "doc_date", "file_name")
    return rows.orderBy(F.desc_nulls_last("doc_date"), "file_name", "document_id").limit(1 if spec.operation == "latest" else spec.limit)


def profiled(documents: DataFrame, profiles: DataFrame, relations: DataFrame, requester: str | None, key: str = "document_id") -> DataFrame:
    """Visible documents that have a profile, with how many relations each has, none being 0."""
    counted = relations.groupBy(key).agg(F.count("*").alias("n_relations"))
    out = documents.where(visible(requester)).join(profiles, key).join(counted, key, "left")
    return out.withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))


@dataclass(frozen=True)
class Anchor:
    """A relation that a document must have: of one of the types, to the target."""

    types: tuple[str, ...]
    name: str | None = None
    number: str | None = None

    def holds(self) -> Column:
        out = F.col("relation_type").isin(*self.types)
        if self.name:
            out = out & F.contains("target_norm", F.lit(fold_value(self.name)))
        if self.number:
            out = out & number_matches("target_number_norm", self.number)
        return out


def anchored_documents(documents: DataFrame, relations: DataFrame, anchors: list[Anchor], requester: str | None, limit: int = 30) -> DataFrame:
    """Visible documents that have every anchor's relation, newest first."""
    kept = documents.where(visible(requester))
    for anchor in anchors:
        kept = kept.join(relations.where(anchor.holds()).select("document_id"), "document_id", "left_semi")
    return kept.orderBy(F.desc_nulls_last("doc_date"), "title", "document_id").limit(limit)


def relation_facts(documents: DataFrame, relations: DataFrame, anchors: list[Anchor], types: tuple[str, ...], requester: str | None) -> DataFrame:
    """Facts of the anchored documents; an anchored type shows only the facts that matched its anchor."""
    of = anchored_documents(documents, relations, anchors, requester).select("document_id")
    facts = relations.where(F.col("relation_type").isin(*types)).join(F.broadcast(of), "document_id", "left_semi")
    for anchor in anchors:
        facts = facts.where(~F.col("relation_type").isin(*anchor.types) | F.coalesce(anchor.holds(), F.lit(False)))
    return facts.select("document_id", "relation_type", "target_text").distinct()


def known_names(profiles: DataFrame) -> DataFrame:
    """Each folded name of an entity that is no mere party, with its first display form."""
    named = profiles.select("document_id", F.explode("entities").alias("e")).where("e.kind <> 'party' and trim(e.name_norm) <> ''")
    return named.groupBy(F.col("e.name_norm").alias("name_norm")).agg(F.min_by("e.name", "document_id").alias("name"), F.countDistinct("document_id").alias("n_documents"))


# versions


def with_latest(versions: DataFrame, key: str = "logical_document_id", version: str = "version_number") -> DataFrame:
    """The row of the greatest version of each logical document."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c != key]), version).alias("r")).select(key, "r.*")


def decide(previous: DataFrame, current: DataFrame, key: str, hashed: str, failed: Column | None = None) -> DataFrame:
    """NEW, UNCHANGED, MODIFIED, DELETED or RETRY for each source."""
    old = previous.select(key, F.col(hashed).alias("old_hash"), (failed if failed is not None else F.lit(False)).alias("failed"))
    new = current.select(key, F.col(hashed).alias("new_hash"))
    decision = (
        F.when(F.col("old_hash").isNull(), "NEW")
        .when(F.col("new_hash").isNull(), "DELETED")
        .when(F.col("failed"), "RETRY")
        .when(F.col("old_hash") == F.col("new_hash"), "UNCHANGED")
        .otherwise("MODIFIED")
    )
    return old.join(new, key, "full_outer").select(key, decision.alias("decision"))


def next_versions(versions: DataFrame, candidates: DataFrame, key: str = "logical_document_id") -> DataFrame:
    """candidates with the version number after the last of their logical document."""
    last = versions.groupBy(key).agg(F.max("version_number").alias("last"))
    return candidates.join(last, key, "left").withColumn("version_number", F.coalesce("last", F.lit(0)) + 1).drop("last")


def activated(versions: DataFrame, key: str = "logical_document_id", deleted: str | None = None) -> DataFrame:
    """Exactly the last version of each logical document is active, none of a deleted one."""
    last = F.col("version_number") == F.max("version_number").over(Window.partitionBy(key))
    return versions.withColumn("is_active", last if deleted is None else last & ~F.coalesce(F.col(deleted), F.lit(False)))


def merge_overrides(computed: DataFrame, previous: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Manual values of the previous row win over computed ones."""
    old = previous.select(key, *[F.col(f).alias(f"old_{f}") for f in fields])
    return computed.join(old, key, "left").select(*[F.coalesce(f"old_{c}", c).alias(c) if c in fields else F.col(c) for c in computed.columns])


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys the table does not have, one for each key."""
    return rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)


def stale(table: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of the table that are no longer in the current set."""
    return table.join(current.select(key), key, "left_anti")


def replaced_children(table: DataFrame, children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The table with all children of the parents replaced by the given ones: a parent without new children has none.

    Null keys of the table are nobody's children and stay.
    """
    return table.join(parents.select(key).distinct(), key, "left_anti").unionByName(children.join(parents.select(key).distinct(), key, "left_semi").select(*table.columns))


def write_replaced_children(children: DataFrame, path: str, partition: str) -> None:
    """The same at rest, for a table partitioned by its parents' key: only the partitions of the given children are written anew."""
    children.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def transitioned(table: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """The rows where the condition holds with new values, all others as they are; `changed` says which."""
    holds = F.coalesce(when, F.lit(False))
    return table.withColumn("changed", holds).withColumns({c: F.when(holds, v).otherwise(F.col(c)) for c, v in values.items()})


def read_all(notifications: DataFrame, user: str, now: Column) -> DataFrame:
    """A user's unread notifications become read."""
    return transitioned(notifications, (F.col("user_id") == user) & F.col("read_at").isNull(), {"read_at": now})


def expire_pending(requests: DataFrame, now: Column) -> DataFrame:
    """Pending requests whose time is over expire."""
    return transitioned(requests, (F.col("status") == "pending") & (F.col("expires_at") <= now), {"status": F.lit("expired")})


def purged(tables: dict[str, DataFrame], expired: DataFrame, key: str = "run_id") -> dict[str, DataFrame]:
    """Each table without the rows of the expired runs: a run goes with all that belongs to it, or not at all."""
    gone = expired.select(key).distinct()
    return {name: table.join(gone, key, "left_anti") for name, table in tables.items()}


def unresolved(outbox: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with `waiting`: whether anything of theirs is still to be delivered."""
    open_rows = outbox.where("status <> 'delivered'").select("run_id").distinct().withColumn("waiting", F.lit(True))
    return runs.join(open_rows, "run_id", "left").withColumn("waiting", F.coalesce("waiting", F.lit(False)))


def add_watch_rules(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rules with those of the wanted (user_id, kind, target) that no active one has, by the folded target."""
    keyed = wanted.withColumn("_key", fold("target")).dropDuplicates(["user_id", "kind", "_key"])
    held = rules.where("active").select("user_id", "kind", fold("target").alias("_key"))
    return rules.unionByName(keyed.join(held, ["user_id", "kind", "_key"], "left_anti").drop("_key"), allowMissingColumns=True)


def stop_watch_rules(rules: DataFrame, user: str, part: str) -> DataFrame:
    """A user's active rules whose folded target has the part are no longer active."""
    return transitioned(rules, F.col("active") & (F.col("user_id") == user) & contains_folded("target", part), {"active": F.lit(False)})


def names_of(entities: DataFrame, by: str, name: str = "name_norm") -> DataFrame:
    """(by, names): distinct normalised names in order, with bars between them."""
    own = entities.where(F.trim(name) != "").select(by, name).distinct()
    return own.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name)), " | ").alias("names"))


def first_signer(profiles: DataFrame, entities: str = "entities") -> DataFrame:
    """Profiles with the name of the first entity that signed."""
    return profiles.withColumn("signer", F.try_element_at(F.filter(entities, lambda e: e["kind"] == "signer"), F.lit(1))["name"])


def table_order(rows: DataFrame, date_: str = "doc_date", number: str = "doc_number") -> DataFrame:
    """Rows by date, undated ones last, then by number."""
    return rows.orderBy(F.asc_nulls_last(date_), F.asc_nulls_last(number))


def filled_table(documents: DataFrame, cells: DataFrame, columns: dict[str, str], key: str = "document_id") -> DataFrame:
    """One row per document: metadata columns as they are, other columns from extracted cells.

    columns: kind (text or number) of each extracted column.  cells: key, column, value; a number
    column's value that is no number is cleared, and the first of several values by text is taken.
    """
    wide = cells.where(F.col("column").isin(*columns)).groupBy(key).agg(*(F.min(F.when(F.col("column") == c, F.nullif(F.trim("value"), F.lit("")))).alias(c) for c in columns))
    out = documents.join(wide, key, "left")
    return out.withColumns({c: F.when(to_number(c).isNotNull(), F.col(c)) for c, kind in columns.items() if kind == "number"})


def superseded(preferences: DataFrame, by: list[str], at: str) -> DataFrame:
    """All but the newest of each category are marked stale."""
    order = Window.partitionBy(*by).orderBy(F.desc(at))
    return preferences.withColumn("stale", F.row_number().over(order) > 1)


def expired_runs(runs: DataFrame, outbox: DataFrame, cutoff: Column) -> DataFrame:
    """Runs before the cutoff of which nothing is left to deliver."""
    open_rows = outbox.where("status <> 'delivered'").select("run_id")
    return runs.where(F.col("created_at") < cutoff).join(open_rows, "run_id", "left_anti")


def claimable(queue: DataFrame, now: Column, stale_minutes: int = 15, limit: int = 50) -> DataFrame:
    """Pending rows that are due, or claimed too long ago, oldest first."""
    due = F.coalesce(F.col("next_attempt_at") <= now, F.lit(True))
    lost = F.col("claimed_at") < now - F.make_interval(mins=F.lit(stale_minutes))
    return queue.where(((F.col("status") == "pending") & due) | ((F.col("status") == "claimed") & lost)).orderBy("created_at", "id").limit(limit)


def outline(parents: DataFrame, most: int = 90) -> DataFrame:
    """Each document's headings in order, each once."""
    first = parents.groupBy("document_id", "heading").agg(F.min("chunk_index").alias("at"))
    order = Window.partitionBy("document_id").orderBy("at")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def text_of_parents(parents: DataFrame) -> DataFrame:
    """A document's text from its ordered parents."""
    return parents.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content_raw"))), lambda s: s["content_raw"]), "\n\n").alias("text"))


def new_headings(paths: DataFrame) -> DataFrame:
    """Of each row's heading path the part that the row before it did not have."""
    before = F.coalesce(F.lag("heading_path").over(Window.partitionBy("document_id").orderBy("chunk_index")), F.array().cast("array<string>"))
    same = F.zip_with("heading_path", before, lambda a, b: a.eqNullSafe(b))
    shared = F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.least(F.size("heading_path"), F.size(before)))
    return paths.withColumn("entered", F.slice("heading_path", shared.cast("int") + 1, F.size("heading_path")))


def sections(nodes: DataFrame) -> DataFrame:
    """Numbers runs of equal heading paths."""
    order = Window.partitionBy("document_id").orderBy("node_index")
    changed = (~F.col("heading_path").eqNullSafe(F.lag("heading_path").over(order))).cast("int")
    return nodes.withColumn("_changed", changed).withColumn("section", F.sum("_changed").over(order)).drop("_changed")


def profile_of(documents: DataFrame, number: Column, subject: Column) -> DataFrame:
    """A profile row with the completeness of its required fields."""
    fields = documents.withColumns({"doc_number_norm": document_number(number), "subject": subject})
    filled = sum(((F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).cast("int") for c in ("doc_number_norm", "subject", "title")), F.lit(0))
    return fields.withColumn("completeness", filled / 3)


def named_like(profiles: DataFrame, name: str) -> DataFrame:
    return profiles.where(contains_folded("title", name))
