"""Text expressions: folding, number coercion, token estimates, redaction.

All of them are Column to Column and stay in the JVM.  A null text is treated
as an empty one where the text says so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters whose folded form is one character, with those forms, and compatibility letters whose form has several."""
    import unicodedata

    source, target, wide = ["đ", "Đ"], ["d", "d"], {}
    for code in (*range(0x80, 0xAC00), *range(0xF900, 0x10000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).casefold()
        if len(plain) == 1 and plain != chr(code) and plain != chr(code).lower():
            source.append(chr(code))
            target.append(plain)
        elif len(plain) > 1 and plain.isascii() and unicodedata.category(chr(code)).startswith("L"):
            wide[chr(code)] = plain
    return "".join(source), "".join(target), wide


def _ranges(chars: list[str], gap: int) -> list[tuple[str, str]]:
    """First and last characters of runs of sorted characters, over gaps of so many others."""
    out: list[tuple[str, str]] = []
    for c in chars:
        out[-1:] = [(out[-1][0], c)] if out and ord(c) - ord(out[-1][1]) <= gap + 1 else [*out[-1:], (c, c)]
    return out


_FROM, _TO, _WIDE = _fold_table()
del _WIDE["ß"]
#: a class of single characters is tried one by one: the ranges that they lie in, with up to 32 others between two of them
_IS_WIDE = "[" + "".join(f"{a}-{b}" for a, b in _ranges(sorted(_WIDE), 32)) + "]"
#: white space that is not one plain space between words; the second for texts of ASCII only
_SPACES, _ASCII_SPACES = r"(?U)[\s&&[^ ]]\s*| \s+", r"[\t-\r]\s*| \s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _letters(c: C, tidy: Callable[[Column, str], Column]) -> Column:
    def is_ascii(t: Column) -> Column:
        return F.octet_length(t) == F.length(t)

    def letters(narrow: Column) -> Column:
        # ligatures and their like: few texts have one
        spelled = reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(_WIDE[w])), _WIDE, narrow)
        other = F.lower(F.regexp_replace(F.when(narrow.rlike(_IS_WIDE), spelled).otherwise(narrow), r"\p{M}+", ""))
        # most texts have no other letters left by then, and no marks to look for
        return F.when(is_ascii(narrow), tidy(F.lower(narrow), _ASCII_SPACES)).otherwise(tidy(other, _SPACES))

    def text(t: Column) -> Column:
        return let(F.when(is_ascii(t), t).otherwise(F.replace(F.translate(t, _FROM, _TO), F.lit("ß"), F.lit("ss"))), letters)

    return let(col(c), text)


def fold(c: C) -> Column:
    """Case- and accent-insensitive form with single spaces; null stays null."""
    return F.trim(_letters(c, lambda t, spaces: F.regexp_replace(t, spaces, " ")))


#: parts lines that are folded together, and what stands for it where a line has it: no pattern knows either
_SEAM, _OWN_SEAM = "\x01", "\x02"


def folded_lines(lines: C) -> Column:
    """The folded form of each line that is not null, in order: all lines are folded as one text."""
    joined = F.array_join(F.transform(col(lines), lambda x: F.replace(x, F.lit(_SEAM), F.lit(_OWN_SEAM))), _SEAM)
    folded = F.split(_letters(joined, lambda t, spaces: F.regexp_replace(t, spaces, " ")), _SEAM)
    return F.when(F.size(col(lines)) > 0, F.transform(folded, lambda t: F.trim(t))).when(F.size(col(lines)) == 0, F.array().cast("array<string>"))


def folded_words(c: C) -> Column:
    """The folded words of a text, in order, repeats included: runs of letters and digits."""
    return F.filter(F.split(_letters(c, lambda t, _: t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fold_or_empty(c: C) -> Column:
    return F.coalesce(fold(c), F.lit(""))


def fold_value(text: str) -> str:
    """The same folding for a literal, on the driver."""
    import unicodedata

    plain = "".join(_WIDE.get(c, c) for c in text.translate(str.maketrans(_FROM, _TO)).replace("ß", "ss"))
    return " ".join("".join(c for c in plain if not unicodedata.category(c).startswith("M")).lower().split())


def to_number(c: C, dtype: str = "string") -> Column:
    """A cell as a double, null where it is none.

    Numeric cells are themselves and booleans are none.  In texts everything but
    digits, comma, point and minus is dropped; several points, or a point before
    a comma, are thousands; several commas are thousands; a single separator
    with exactly three digits behind it is a thousands separator, else a decimal one.
    """
    c = col(c)
    if dtype == "boolean":
        return F.lit(None).cast("double")
    if dtype != "string":
        return c.cast("double")
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\d,.\-]", "")
    points, commas = F.regexp_count(t, F.lit(r"\.")), F.regexp_count(t, F.lit(","))
    last_point, last_comma = (F.length(F.regexp_extract(t, rf"^(.*){s}", 1)) for s in (r"\.", ","))
    swapped = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    three_comma, three_point = t.rlike(r"^[^,]*,.{3}$"), t.rlike(r"^[^.]*\..{3}$")
    text = (
        F.when((points > 1) | ((points > 0) & (commas > 0) & (last_point < last_comma)), swapped)
        .when(commas > 1, F.replace(t, F.lit(","), F.lit("")))
        .when((commas == 1) & (points == 0), F.when(three_comma, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit("."))))
        .when((points == 1) & (commas == 0), F.when(three_point, F.replace(t, F.lit("."), F.lit(""))).otherwise(t))
        .otherwise(t)
    )
    return F.when(text.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))


def normalise_lines(c: C) -> Column:
    """Without zero-width characters and trailing blanks; at most one empty line in a row."""
    t = F.regexp_replace(col(c), "[​‌‍﻿]", "")
    t = F.regexp_replace(t, r"(?Um)[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


#: blanks that are taken off a sentence's ends: Unicode's space separators
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def sentences(c: C) -> Column:
    """Cut after . ! ? … at white space (blank, tab, \\n, \\f, \\r); a text of one sentence is cut at its lines."""

    def cut(pattern: str) -> Column:
        # a function with two parameters would get the place as its second: F.trim itself would cut that number's digits off
        return F.filter(F.transform(F.split(col(c), pattern), lambda s: F.btrim(s, F.lit(_BLANKS))), lambda s: s != "")

    return let(cut(r"(?<=[.!?…])[ \t\n\f\r]+"), lambda parts: F.when(F.size(parts) > 1, parts).otherwise(cut("\n")))


def estimate_tokens(c: C) -> Column:
    """ceil(1.08 * prose / 4 + 2 * bars + other marks), at least 1; 0 for an empty text."""
    c = F.coalesce(col(c), F.lit(""))
    bars, marks = F.regexp_count(c, F.lit(r"\|")), F.regexp_count(c, F.lit(r"[`>\-*#]"))
    prose = F.greatest(F.length(c) - bars - marks, F.lit(0))
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(prose / F.lit(4.0) * F.lit(1.08) + bars * 2 + marks))).cast("int")


def truncate_tokens(c: C, tokens: int) -> Column:
    """The first 4 * tokens characters, without trailing blanks if anything was cut."""
    return F.when(F.length(col(c)) <= 4 * tokens, col(c)).otherwise(F.rtrim(F.substring(col(c), 1, 4 * tokens)))


def copy_key(c: C) -> Column:
    """What makes two bodies repeats: blanks collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")))


def document_number(c: C) -> Column:
    """Folded, upper-cased letters and digits of a document number; null if none are left."""
    return F.nullif(F.regexp_replace(F.upper(fold(c)), "[^0-9A-Z]", ""), F.lit(""))


def number_matches(number: C, wanted: str) -> Column:
    """Equal; digits alone also match a number that goes on with no further digit."""
    n = col(number)
    if not wanted.isdigit():
        return n == wanted
    return (n == wanted) | (n.startswith(wanted) & ~F.substring(n, len(wanted) + 1, 1).rlike("[0-9]"))


def contains_folded(c: C, part: str) -> Column:
    return F.contains(fold_or_empty(c), F.lit(fold_value(part)))


def all_words(c: C, words: str) -> Column:
    """Every word is in the folded text."""
    folded = fold_or_empty(c)
    return reduce(lambda a, w: a & F.contains(folded, F.lit(w)), fold_value(words).split(), F.lit(True))


#: Credentials as they appear in texts.
SECRET_PATTERNS = (
    r"(?i)\bbearer\s+[a-z0-9._~+/=-]+",
    r"\b(?:sk|rk)-[a-zA-Z0-9_-]+\b",
    r"\b(?:ghp|gho|ghs|ghu|github_pat)_[a-zA-Z0-9_]{8,}\b",
    r"\bxox[baprs]-[a-zA-Z0-9-]{8,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{20,}\b",
    r"\bya29\.[0-9A-Za-z_-]{20,}\b",
    r"\bappr_[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    r"(?is)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
)
#: Fixed value: a mail address, its first character in a group.
EMAIL_PATTERN = r"\b([a-zA-Z0-9_.+-])[a-zA-Z0-9_.+-]*@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b"


#: Texts without any of these hold no credential: a cheap test before the patterns.
_SECRET_SIGNS = r"(?i)bearer|sk-|rk-|gh[posu]_|github_pat_|xox|AKIA|AIza|ya29|appr_|PRIVATE KEY"


def redact(c: C, limit: int | None = 500, emails: bool = True) -> Column:
    """Credentials and mail addresses masked; longer texts cut with a marker."""
    t = col(c)
    out = F.when(t.rlike(_SECRET_SIGNS), reduce(lambda x, p: F.regexp_replace(x, p, "[REDACTED_SECRET]"), SECRET_PATTERNS, t)).otherwise(t)
    if emails:
        out = F.transform(F.array(out), lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, EMAIL_PATTERN, "$1***@[REDACTED]")).otherwise(x))[0]
    return out if limit is None else shortened(out, limit)


def shortened(c: C, limit: int = 500) -> Column:
    """A text of more than `limit` characters, cut with a marker; the text is computed once."""
    return F.transform(F.array(col(c)), lambda x: F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("... [TRUNCATED]"))).otherwise(x))[0]


def vietnamese_or_english(c: C) -> Column:
    """vi where at least 2 % of the letters are Vietnamese ones, else en."""
    letters = F.regexp_count(col(c), F.lit(r"\p{L}"))
    own = F.regexp_count(col(c), F.lit("(?iu)[ăâđêôơưàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ]"))
    return F.when((letters > 0) & (own / F.nullif(letters, F.lit(0)) >= 0.02), "vi").otherwise("en")


def garbage_ratio(c: C) -> Column:
    """Share of control, unassigned and replacement characters, line breaks and tabs aside."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\n\r\t]", "")
    return F.when(F.length(t) > 0, F.regexp_count(t, F.lit(r"[\p{Cc}\p{Cn}�]")) / F.length(t)).otherwise(0.0)


def parse_verdict(nodes: C, source_bytes: C, ocr_capable: Column, ratio: float = 0.25, large: int = 200_000, least: int = 64) -> Column:
    """struct<status, reason>: CORRUPT over the garbage ratio, or for an empty tree or a large source with next to no text.

    The last two are NEEDS_OCR where OCR could help; anything else is PARSED.  nodes: the texts of a
    document's nodes.  Null nodes count as no node.
    """
    texts = F.coalesce(col(nodes), F.array().cast("array<string>"))
    whole = F.array_join(texts, "")
    kinds = F.regexp_count(whole, F.lit(r"[\p{Cc}\p{Cn}�]"))
    empty, scanned = F.size(texts) == 0, (col(source_bytes) >= large) & (F.length(whole) < least)
    unread = F.when(ocr_capable, "NEEDS_OCR").otherwise("CORRUPT")
    garbage = (F.length(whole) > 0) & (kinds > ratio * F.length(whole))
    status = F.when(garbage, "CORRUPT").when(empty | scanned, unread).otherwise("PARSED")
    reason = F.when(garbage, "garbage").when(empty, "empty document tree").when(scanned, "large source without text")
    return F.struct(status.alias("status"), reason.alias("reason"))


def html_to_text(c: C) -> Column:
    """Text of an HTML body: scripts and styles dropped, blocks on lines of their own, entities resolved."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/tr|/li|/h[1-6]|p|div|tr|li|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def escape_boundary(c: C) -> Column:
    """Untrusted text that cannot close or open a tag."""
    t = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def local_number(c: C) -> Column:
    """1234567.5 as 1.234.567,5: two decimals at most, none that are zero."""
    t = F.regexp_replace(F.regexp_replace(F.format_number(col(c).cast("double"), 2), r"0+$", ""), r"\.$", "")
    return F.translate(t, ",.", ".,")


def table_cell(c: C) -> Column:
    """A text inside a pipe table."""
    return F.replace(escape_boundary(F.coalesce(col(c), F.lit(""))), F.lit("|"), F.lit("\\|"))


def short_title(c: C, n: int = 42) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def head_tail(c: C, head: int, tail: int) -> Column:
    """The first and last UTF-8 bytes of a long text, whole characters only, with what was left out between."""
    raw = col(c).cast("binary")
    left = F.octet_length(raw) - head - tail
    # a character that a cut goes through is no character: its bytes become U+FFFD, which goes
    first = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, head).cast("string")), "�+$", "")
    last = F.regexp_replace(F.make_valid_utf8(F.substring(raw, -tail, tail).cast("string")), "^�+", "") if tail else F.lit("")
    return F.when(left <= 0, col(c)).otherwise(F.concat(first, F.lit("\n... ["), left.cast("string"), F.lit(" bytes omitted] ...\n"), last))


def sliced(c: C, offset: int, limit: int) -> Column:
    """`limit` characters of a stored text from `offset` (from 0) on."""
    return F.substring(col(c), offset + 1, limit)


def glob(c: C, pattern: str) -> Column:
    """Shell-style match of a whole name."""
    import fnmatch

    return col(c).rlike("^" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "") + "$")


def trigger_matches(c: C, trigger: str, token_subset: bool = False) -> Column:
    """`/regex/` searches (one that is no pattern matches nothing); else the folded phrase stands in the text between blanks, or before a mark.

    With token_subset all of its words of two letters and more, in any order, are enough.
    """
    import re

    trigger = trigger.strip()
    if len(trigger) >= 2 and trigger[0] == trigger[-1] == "/":
        try:
            re.compile(trigger[1:-1])
        except re.error:
            return F.lit(False)
        return F.coalesce(col(c), F.lit("")).rlike("(?i)" + trigger[1:-1])
    phrase = fold_value(trigger)
    if not phrase:
        return F.lit(False)
    folded = fold_or_empty(c)
    # fixed values: what may stand around a phrase
    out = F.contains(folded, F.lit(phrase)) & folded.rlike(rf"(?:^|\s)\Q{phrase}\E(?:$|[\s.,!?;:])")
    wanted = sorted({w for w in re.findall(r"\w+", phrase) if len(w) > 1})
    if token_subset and wanted:
        words = F.split(folded, r"[^\p{L}\p{N}_]+")
        out = out | (F.size(F.array_except(F.array(*map(F.lit, wanted)), words)) == 0)
    return out


def any_word(c: C, words: str) -> Column:
    """At least one of the words is in the folded text."""
    folded = fold_or_empty(c)
    return reduce(lambda a, w: a | F.contains(folded, F.lit(w)), fold_value(words).split(), F.lit(False))
