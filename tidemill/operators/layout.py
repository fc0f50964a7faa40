"""The heading tree of documents with a text layer, from a table of their blocks; reading the files themselves is another's work.

blocks: document_id, page, place (in the page), lines (array of texts), size, bold.  outline: document_id, page,
place (in the outline), level, title.

A document with an outline of three entries and more has its headings from there: an entry is the first block of its
page that begins with its title, or whose text begins the title; what stands behind the title in that block is a
paragraph, and an entry without a block stands at its page's top.  Other documents have them from their fonts: the size
that most characters have is the body's, sizes larger by 15 % are levels, the largest first, four at most; a short
block of such a size is a heading, as is a bold one of the body's size, one level below.

Blocks without text are left out; a null size is no level.  Of sizes with as many characters the smaller is the body's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import C, col, fold

LARGER, NEAR, MOST_LEVELS, DEEPEST = 1.15, 0.3, 4, 6
LONGEST, LONGEST_BOLD, MOST_LINES = 150, 90, 3
#: entries that make an outline worth using, characters of a title that a block has to begin with, and least of a block's
OUTLINE_LEAST, TITLE_PART, BLOCK_PART = 3, 60, 6
#: Fixed value: numbers before a title.
LEADING_NUMBER = r"^(?:(?i:chapter|ch[uư][oơ]ng|part|ph[aầ]n|m[uụ]c|section)\s+)?(?:[IVXLC]+(?=[.:)\s]|$)|\d+(?:\.\d+)*)[.:)]?(?:\s+|$)"


def _letters(c: C) -> Column:
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "")


def _title_letters(c: C) -> Column:
    return _letters(F.regexp_replace(F.trim(col(c)), LEADING_NUMBER, ""))


def font_levels(blocks: DataFrame) -> DataFrame:
    """(document_id, body, levels array<struct<size, level>>) of each document that has sizes."""
    mass = blocks.where("size is not null").groupBy("document_id", "size").agg(F.sum(F.length("text")).alias("mass"))
    by = Window.partitionBy("document_id")
    body = F.first("size").over(by.orderBy(F.desc("mass"), "size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    large = mass.withColumn("body", body).withColumn("large", F.col("size") >= F.col("body") * LARGER)
    rank = F.least(F.row_number().over(Window.partitionBy("document_id", "large").orderBy(F.desc("size"))), F.lit(MOST_LEVELS))
    own = large.withColumn("level", F.when(F.col("large"), rank))
    return own.groupBy("document_id").agg(F.first("body").alias("body"), F.sort_array(F.collect_list(F.when(F.col("large"), F.struct("size", "level")))).alias("levels"))


def font_heading(text: C, lines: Column, size: C, bold: C, body: C, levels: C) -> Column:
    """The level of a block that is a heading by its font, else null."""
    text, size, levels = col(text), col(size), col(levels)
    near = F.array_min(F.transform(F.filter(levels, lambda x: F.abs(x["size"] - size) <= NEAR), lambda x: x["level"]))
    below = F.when(F.size(levels) > 0, F.array_max(F.transform(levels, lambda x: x["level"])) + 1).otherwise(2)
    emphasised = F.coalesce(col(bold), F.lit(False)) & (col(body) > 0) & (size >= col(body) - NEAR) & (F.length(text) <= LONGEST_BOLD)
    short = (F.length(text) <= LONGEST) & (lines <= MOST_LINES) & ~text.rlike(r"[.,;]$")
    return F.when(short, F.coalesce(near, F.when(emphasised, below)))


def _from_outline(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """Blocks and headings (document_id, page, place, part, level, text) of documents with a usable outline."""
    entries = outline.select("document_id", "page", F.col("place").alias("entry"), "level", "title", _title_letters("title").alias("wanted"))
    own = blocks.select("document_id", "page", "place", "lines", "text", _title_letters("text").alias("held"))
    whole, wanted = F.col("held"), F.col("wanted")
    title_first = whole.startswith(F.substring(wanted, 1, TITLE_PART))
    begins = (F.length(whole) >= BLOCK_PART) & wanted.startswith(whole)
    pairs = own.join(entries, ["document_id", "page"]).where((wanted != "") & (whole != "") & (title_first | begins)).withColumn("begins", begins)
    pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("document_id", "page", "entry").orderBy("place"))).where("_n = 1")
    pairs = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("document_id", "page", "place").orderBy("entry"))).where("_n = 1").drop("_n")
    # the lines that the title takes: until their letters are as many as its own
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"))
    taken = F.aggregate("lines", start, lambda s, x: F.when(s["size"] >= F.length("wanted"), s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["size"] + F.length(F.when(s["n"] == 0, _title_letters(x)).otherwise(_letters(x)))).alias("size"))))
    rest = F.when(F.col("begins"), F.lit("")).otherwise(F.array_join(F.slice("lines", taken["n"] + 1, F.size("lines")), " "))
    number = F.trim(F.regexp_extract(F.trim("text"), LEADING_NUMBER, 0))
    bare = F.regexp_replace(number, r"[.:)]$", "")
    heading = F.when((bare == "") | F.contains(F.lower("title"), F.lower(bare)), F.col("title")).otherwise(F.concat(number, F.lit(" "), F.col("title")))
    found = pairs.select("document_id", "page", "place", "entry", "level", heading.alias("heading"), rest.alias("rest"))
    none = F.lit(None).cast("int")
    left = own.join(found.select("document_id", "page", "place"), ["document_id", "page", "place"], "left_anti").select("document_id", "page", "place", F.lit(1).alias("part"), none.alias("level"), "text")
    headings = found.select("document_id", "page", "place", F.lit(0).alias("part"), F.col("level").cast("int"), F.col("heading").alias("text"))
    bodies = found.where("rest <> ''").select("document_id", "page", "place", F.lit(1).alias("part"), none.alias("level"), F.col("rest").alias("text"))
    lost = entries.join(found.select("document_id", "page", "entry"), ["document_id", "page", "entry"], "left_anti")
    tops = lost.select("document_id", "page", F.lit(-1).cast(dict(blocks.dtypes)["place"]).alias("place"), F.col("entry").cast("int").alias("part"), F.col("level").cast("int"), F.col("title").alias("text"))
    return left.union(headings).union(bodies).union(tops)


def with_paths(rows: DataFrame) -> DataFrame:
    """rows (document_id, page, place, part, level, text) with `heading_path`: the open headings above each, outermost first.

    A heading closes those of its level and deeper ones; its own path is what was open before it.
    """
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "place", "part"))
    numbered = rows.withColumns({"_at": at, "level": F.when(F.col("level").isNotNull(), F.least(F.greatest("level", F.lit(1)), F.lit(DEEPEST)))})
    above = Window.partitionBy("document_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.last(F.when(F.col("level") == n, F.struct("_at", "text")), ignorenulls=True).over(above) for n in range(1, DEEPEST + 1)}
    held = numbered.withColumns({f"_h{n}": c for n, c in last.items()})
    open_ = []
    for n in range(1, DEEPEST + 1):
        closed = [F.coalesce(F.col(f"_h{m}._at"), F.lit(0)) for m in range(1, n)]
        newest = F.greatest(F.lit(0), F.lit(0), *closed)
        open_.append(F.when(F.col(f"_h{n}._at") > newest, F.col(f"_h{n}.text")))
    path = F.filter(F.array(*open_), lambda t: t.isNotNull())
    return held.withColumn("heading_path", path).drop("_at", *(f"_h{n}" for n in last))


def heading_tree(blocks: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """(document_id, page, place, part, kind, level, text, heading_path) of all blocks and headings; part orders what one block became."""
    text = F.trim(F.regexp_replace(F.array_join("lines", " "), r"(?U)\s+", " "))
    blocks = blocks.select("document_id", "page", "place", "lines", "size", "bold", text.alias("text")).where("text <> ''")
    columns = ("document_id", "page", "place", "part", "level", "text")
    if outline is None:
        plain, rows = blocks, None
    else:
        named = outline.where(F.trim("title") != "")
        usable = named.groupBy("document_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= OUTLINE_LEAST).select("document_id")
        rows = _from_outline(blocks.join(usable, "document_id", "left_semi"), named.join(usable, "document_id", "left_semi")).select(*columns)
        plain = blocks.join(usable, "document_id", "left_anti")
    by_font = plain.join(font_levels(plain), "document_id", "left")
    level = font_heading("text", F.size("lines"), "size", "bold", "body", F.coalesce("levels", F.array().cast("array<struct<size:double,level:int>>")))
    fonts = by_font.select("document_id", "page", "place", F.lit(1).alias("part"), level.cast("int").alias("level"), "text")
    out = with_paths(fonts if rows is None else rows.union(fonts))
    return out.select("document_id", "page", "place", "part", F.when(F.col("level").isNull(), "PARAGRAPH").otherwise("HEADING").alias("kind"), "level", "text", "heading_path")
