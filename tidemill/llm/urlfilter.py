"""Url filter: host/path rules first, then a weighted vocabulary of url terms.

Rules are written `host/path` (`net/`, `example.net/en/`).  A rule fits its host
and all subdomains of it if the url's path starts with the rule's path; of the
rules that fit, the longest wins (then the smaller string).  Where none fits,
terms are counted with an Aho-Corasick automaton over the lower-cased url.  A
hit counts only between boundaries: the bytes before and after are not letters
or digits.  One strict term, or `soft_limit` distinct soft terms, blocks.

A null url, or one without `://`, has an empty host and path and fits no rule;
its text, if any, is still matched with the vocabulary, a null one is allowed.
Repeated rows are judged alike, very long urls whole.  Other columns are kept as
they are, but for those of the result columns' names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES: dict[str, str] = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
STRICT, SOFT = 2, 1
#: A term's weight is STRICT (one hit blocks) or SOFT (several distinct hits block).
TERMS: dict[str, int] = {
    "adult": STRICT,
    "casino": STRICT,
    "hentai": STRICT,
    "porn": STRICT,
    "spam": STRICT,
    "viagra": STRICT,
    "warez": STRICT,
    "xxx": STRICT,
    "ads": SOFT,
    "bet": SOFT,
    "bets": SOFT,
    "bonus": SOFT,
    "cheap": SOFT,
    "coupon": SOFT,
    "escort": SOFT,
    "free": SOFT,
    "hot": SOFT,
    "nude": SOFT,
    "pills": SOFT,
    "poker": SOFT,
    "sex": SOFT,
    "slots": SOFT,
    "track": SOFT,
    "tracker": SOFT,
    "win": SOFT,
}
SOFT_LIMIT = 2

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: bytes of terms that a vocabulary may have: it is configuration, and goes to every worker
VOCABULARY_BYTES = 16 << 20


def vocabulary(terms: DataFrame, *, term_col: str = "term", weight_col: str = "weight") -> dict[str, int]:
    """The terms of a table with their weights, lower-cased; of a repeated term the largest weight counts.

    Null and empty terms are left out; a null weight is SOFT.  A table of more than VOCABULARY_BYTES is refused.
    """
    own = terms.where(F.length(term_col) > 0).groupBy(lower_az(F.col(term_col)).alias("term")).agg(F.max(F.coalesce(F.col(weight_col).cast("int"), F.lit(SOFT))).alias("weight"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    if size > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is no configuration")
    return {r.term: r.weight for r in own.orderBy("term").toLocalIterator()}


def lower_az(column: Column) -> Column:
    return F.translate(column, *_AZ)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: up to `/`, `?`, `#` or end, lower-cased; then up to `?`, `#` or end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_az(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Mapping[str, str] = RULES) -> Column:
    """The longest rule that fits, else null; rules are configuration, tested one by one."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        at, slash, rest = rule.partition("/")
        at = at.lower()
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    """Built once by each worker."""
    out = ahocorasick.Automaton()
    for term, weight in terms:
        out.add_word(term.lower(), (term.lower(), weight))
    out.make_automaton()
    return out


def _is_part(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum())


def url_hits(url: str | None, automaton: ahocorasick.Automaton) -> tuple[int, int]:
    """(strict hits, distinct soft terms) in a lower-cased url."""
    strict, soft = 0, set()
    for end, (term, weight) in automaton.iter(url or ""):
        if not _is_part(url, end - len(term)) and not _is_part(url, end + 1):
            if weight >= STRICT:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def term_hits(url: Column, terms: Mapping[str, int] = TERMS) -> Column:
    """struct<strict: int, soft: int> of each url."""
    listed = tuple(terms.items())

    @F.arrow_udf("struct<strict: int, soft: int>")
    def hits(urls: pa.Array) -> pa.Array:
        automaton = _automaton(listed)
        found = [url_hits(u, automaton) for u in urls.to_pylist()] if len(automaton) else [(0, 0)] * len(urls)
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)], names=["strict", "soft"])

    return hits(lower_az(url))


def judge_urls(pages: DataFrame, *, url_col: str = "url", rules: Mapping[str, str] = RULES, terms: Mapping[str, int] = TERMS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """pages with host, path, rule, strict_hits, soft_hits and verdict (allow or block); columns of those names are replaced."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    out = pages.withColumns({"host": host, "path": path}).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    out = out.withColumn("__tidemill_hits", term_hits(url, terms)).withColumns({"strict_hits": F.col("__tidemill_hits.strict"), "soft_hits": F.col("__tidemill_hits.soft")}).drop("__tidemill_hits")
    of_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        of_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(of_rule)
    of_terms = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce(of_rule, of_terms))
