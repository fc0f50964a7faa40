"""Questions on their way to a query: cleaning, full-text terms, routing.  On the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.text import fold_value

#: Words without meaning for a search, folded.
STOP_WORDS = ("la", "va", "cua", "cho", "cac", "nhung", "mot", "co", "the", "a", "an", "of", "and", "is", "to", "in")
FILLERS = ("cho toi biet", "cho minh hoi", "lam on", "vui long", "please", "can you", "could you", "tell me")


def cleaned(question: str, typos: dict[str, str] | None = None) -> str:
    """Without polite openings, fillers and closing punctuation; typos are replaced as whole words."""
    out = " ".join(re.sub(r"\w+", lambda m: (typos or {}).get(m[0].lower(), m[0]), question).split())
    folded = fold_value(out)
    for filler in FILLERS:
        if folded.startswith(filler):
            out = " ".join(out.split()[len(filler.split()) :])
            folded = fold_value(out)
    return re.sub(r"[\s?!.,;:]+$", "", out).strip()


@dataclass
class TextQuery:
    """Terms for the inverted index: all, phrases, any and none, folded."""

    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)


def parse_search(text: str) -> TextQuery:
    """Web-style search: "phrases", -negation, OR between two words, else all words."""
    out = TextQuery()
    tokens = [(m[1] or "", fold_value(m[2] if m[2] is not None else m[3])) for m in re.finditer(r'(-)?(?:"([^"]*)"|(\S+))', text)]
    quoted = [m[2] is not None for m in re.finditer(r'(-)?(?:"([^"]*)"|(\S+))', text)]
    either: set[int] = set()
    for i, (_, t) in enumerate(tokens):
        if t == "or" and not quoted[i] and 0 < i < len(tokens) - 1:
            either |= {i - 1, i + 1}
    for i, (minus, t) in enumerate(tokens):
        words = [w for w in re.split(r"[\W_]+", t) if w]
        if not words or (t == "or" and not quoted[i] and {i - 1, i + 1} <= either):
            continue
        if minus:
            out.none_of += words
        elif i in either:
            out.any_of += words
        elif quoted[i] and len(words) > 1:
            out.phrases.append(words)
        else:
            out.terms += words
    return out


def bigrams(text: str) -> list[list[str]]:
    """Pairs of neighbouring syllables of which not both are stop words."""
    words = fold_value(text).split()
    return [[a, b] for a, b in zip(words, words[1:], strict=False) if not (a in STOP_WORDS and b in STOP_WORDS)]


_COUNT = re.compile(r"\b(bao nhieu|how many|dem|count)\b")
_LATEST = re.compile(r"\b(moi nhat|gan nhat|latest|newest)\b")
_LIST = re.compile(r"\b(liet ke|danh sach|list|tat ca|nhung|cac)\b")
_RELATION = re.compile(r"\b(ai ky|nguoi ky|thay the|can cu|sua doi|signed by|replaces)\b")


def route(question: str, scoped: bool = False) -> str:
    """Where a question goes: SCOPED follow-up, RELATION, COUNT, LATEST, LIST, else CONTENT."""
    if scoped:
        return "SCOPED"
    t = fold_value(question)
    for name, pattern in (("RELATION", _RELATION), ("COUNT", _COUNT), ("LATEST", _LATEST), ("LIST", _LIST)):
        if pattern.search(t):
            return name
    return "CONTENT"


def expansion(question: str, explicit: str | None = None) -> str:
    """Explicit policy, NONE for listings, else PARENT."""
    return explicit or ("NONE" if _LIST.search(fold_value(question)) else "PARENT")


#: documents whose texts are read together at most
MOST_SCOPED = 8


@dataclass(frozen=True)
class Answer:
    """Rows that answer a question (or None), or the search that has to."""

    route: str
    rows: DataFrame | None = None
    mode: str = "CORPUS"
    scope: DataFrame | None = None


def dispatch(question: str, *, followup: DataFrame | None = None, relation: DataFrame | None = None, metadata: DataFrame | None = None, with_content: bool = False) -> Answer:
    """The first of these that holds: documents of a follow-up, facts of a relation, a metadata query, documents of one to read, the corpus.

    followup, relation and metadata are what the planners made of the question (document_id among the
    columns), None where they made nothing.  Facts of up to MOST_SCOPED documents and metadata queries
    that ask for content go on to a search: in those documents, or in all if there are none; of more
    documents the rows are the answer.  At most MOST_SCOPED + 1 ids are counted.
    """
    if followup is not None:
        return Answer("SCOPED", mode="DOCUMENT_SEARCH", scope=followup.select("document_id").distinct())
    if relation is not None:
        n = relation.select("document_id").distinct().limit(MOST_SCOPED + 1).count()
        return Answer("RELATION", rows=relation, mode="CORPUS" if 0 < n <= MOST_SCOPED else "NONE")
    if metadata is None:
        return Answer("CONTENT")
    if not with_content:
        return Answer(route(question), rows=metadata, mode="NONE")
    found = metadata.select("document_id").distinct()
    n = found.limit(MOST_SCOPED + 1).count()
    if n == 0:
        return Answer("CONTENT")
    return Answer("METADATA", rows=metadata, mode="NONE") if n > MOST_SCOPED else Answer("METADATA", mode="DOCUMENT_SEARCH", scope=found)
