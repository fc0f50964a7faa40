"""Hashes, ids and JSON: expressions over structs and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col


def content_hash(c: C) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def stable_id(prefix: str, *parts: C, length: int = 32) -> Column:
    """prefix and the first digits of the hash of a JSON list of the parts."""
    listed = F.to_json(F.array(*(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit(prefix), F.substring(F.sha2(listed, 256), 1, length))


def fingerprint(**fields: C) -> Column:
    """Hash of a JSON object of the fields in the order of their names, nulls included."""
    listed = F.struct(*(col(fields[k]).cast("string").alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(listed, {"ignoreNullFields": "false"}), 256)


def joined_hash(*parts: C) -> Column:
    """Hash of the parts with NUL between them."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256)


def heading_list(c: C) -> Column:
    """A heading path given as a JSON list; anything else is one heading, nothing none."""
    listed = F.from_json(col(c), "array<string>")
    one = F.when(F.trim(col(c)) != "", F.array(col(c))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.when(col(c).startswith("["), listed), one, F.array().cast("array<string>"))


def without_empty(m: C) -> Column:
    return F.map_filter(col(m), lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def first_full(*candidates: C) -> Column:
    return F.coalesce(*(F.nullif(F.trim(col(c)), F.lit("")) for c in candidates))


#: Keys whose values never leave a context.
SENSITIVE_KEYS = (
    "approval_token",
    "approval_id",
    "approvaltoken",
    "token",
    "access_token",
    "refresh_token",
    "api_key",
    "secret",
    "secret_key",
    "password",
    "passwd",
    "authorization",
    "bearer",
)


def without_secrets(m: C) -> Column:
    """A map without its sensitive keys, whether written in camel case, with dashes or with underscores."""

    def plain(k: Column) -> Column:
        return F.replace(F.lower(F.regexp_replace(F.trim(k), "(?<=[a-z0-9])([A-Z])", "_$1")), F.lit("-"), F.lit("_"))

    return F.map_filter(col(m), lambda k, v: ~plain(k).isin(*SENSITIVE_KEYS))


def first_object(c: C) -> Column:
    """The first flat or once nested JSON object in a text, as a string."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})", 1), F.lit(""))
