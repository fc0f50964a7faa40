"""Tables and documents from files, and documents back to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import C, col, fold

MOST_COLUMNS, MOST_ROWS = 60, 5000
CELLS = "cells"


def header_names(cells: list[str | None]) -> list[str]:
    """Names of a header row: blank ones by place, repeated ones with their place."""
    names: list[str] = []
    for i, cell in enumerate(cells, 1):
        name = (cell or "").strip() or f"Cột {i}"
        names.append(f"{name} ({i})" if name in names else name)
    return names


def table_of_cells(matrix: DataFrame, order: str = "row", most_rows: int | None = MOST_ROWS, most_columns: int | None = MOST_COLUMNS) -> DataFrame:
    """A table from rows of cells: the first row that is not blank is the header, blank rows go, missing cells are null.

    matrix: the order column and `cells` (array of strings).  Only the header is read on the driver.
    Rows and columns beyond the limits are left out; None is no limit.
    """
    cells = F.col(CELLS) if most_columns is None else F.slice(CELLS, 1, most_columns)
    full = matrix.withColumn(CELLS, cells).where(F.exists(CELLS, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    head = full.orderBy(order).limit(1).collect()
    if not head:
        return matrix.sparkSession.createDataFrame([], "row long")
    names = header_names(head[0][CELLS])
    body = full.where(F.col(order) > head[0][order])
    if most_rows is not None:
        body = body.orderBy(order).limit(most_rows)
    return body.select(F.col(order).alias("row"), *(F.try_element_at(CELLS, F.lit(i)).alias(n) for i, n in enumerate(names, 1)))


def read_csv_table(spark: SparkSession, path: str, most_rows: int | None = MOST_ROWS, most_columns: int | None = MOST_COLUMNS, multi_line: bool = True) -> DataFrame:
    """A CSV file as a table of strings in file order; quoted line breaks are part of a cell.

    A file with such cells is read by one task; without multi_line a large file is split.
    """
    raw = spark.read.option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE").csv(path, header=False, inferSchema=False)
    cells = raw.select(F.monotonically_increasing_id().alias("row"), F.array(*raw.columns).alias(CELLS))
    return table_of_cells(cells, most_rows=most_rows, most_columns=most_columns)


def read_xlsx_table(spark: SparkSession, path: str, most_rows: int | None = MOST_ROWS, most_columns: int | None = MOST_COLUMNS) -> DataFrame:
    """The first sheet's values, in the workbook's order of sheets, from its XML; each file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.mapInArrow(_sheet_rows, SHEET_SCHEMA).where("sheet_index = 0").select("row", CELLS)
    return table_of_cells(first, most_rows=most_rows, most_columns=most_columns)


def xlsx_nodes(spark: SparkSession, path: str, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """(path, sheet_index, sheet, block, kind, text): headings, paragraphs and tables of workbooks, in order of sheet and block.

    A sheet that has values is a heading (block 0).  Runs of rows between blank ones are blocks: columns
    without values go, rows of one value on top are a paragraph, and rows under a header of two values
    and more are a Markdown table, others a paragraph.
    """
    files = spark.read.format("binaryFile").load(path).select("content", "path")
    rows = files.mapInArrow(_sheet_rows, SHEET_SCHEMA).where(F.col("row") < most_rows)
    cells = F.transform(F.slice(CELLS, 1, most_columns), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    own = ["path", "sheet_index", "sheet"]
    order = Window.partitionBy(*own).orderBy("row")
    full = rows.select(*own, "row", cells.alias(CELLS)).where(F.exists(CELLS, lambda c: c != ""))
    opened = full.withColumn("_new", F.coalesce(F.col("row") - F.lag("row").over(order) > 1, F.lit(True)).cast("int")).withColumn("block", F.sum("_new").over(order))
    blocks = opened.groupBy(*own, "block").agg(F.array_sort(F.collect_list(F.struct("row", CELLS))).alias("r")).select(*own, "block", F.col("r.cells").alias("r"))
    width = F.array_max(F.transform("r", lambda x: F.size(x)))
    used = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists("r", lambda x: F.coalesce(F.get(x, i), F.lit("")) != ""))
    blocks = blocks.withColumn("u", used).withColumn("r", F.transform("r", lambda x: F.transform("u", lambda i: F.coalesce(F.get(x, i), F.lit("")))))
    filled = F.transform("r", lambda x: F.size(F.filter(x, lambda c: c != "")))
    # labels: rows of one value from the top on, while more than two rows are left
    header = F.coalesce(F.array_position(F.transform(filled, lambda n: n > 1), True), F.lit(0)) - 1
    most = F.greatest(F.size("r") - 2, F.lit(0))
    labels = F.least(F.when(header < 0, most).otherwise(header), most).cast("int")
    blocks = blocks.withColumn("n", labels).withColumns({"top": F.slice("r", 1, F.col("n")), "body": F.slice("r", F.col("n") + 1, F.size("r"))})
    joined = lambda name: F.array_join(F.filter(F.transform(name, lambda x: F.array_join(F.filter(x, lambda c: c != ""), " — ")), lambda t: t != ""), "\n")
    line = lambda x: F.concat(F.lit("| "), F.array_join(x, " | "), F.lit(" |"))
    names = F.transform(F.col("body")[0], lambda c, i: F.when(c == "", F.concat(F.lit("Cột "), (i + 1).cast("string"))).otherwise(c))
    is_table = (F.size("body") >= 2) & (F.size(F.filter(F.col("body")[0], lambda c: c != "")) >= 2)
    table = F.array_join(F.concat(F.array(line(names), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(names)))), F.transform(F.slice("body", 2, F.size("body")), line)), "\n")
    parts = F.array(F.struct(F.lit("PARAGRAPH").alias("kind"), joined("top").alias("text")), F.struct(F.when(is_table, "TABLE").otherwise("PARAGRAPH").alias("kind"), F.when(is_table, table).otherwise(joined("body")).alias("text")))
    nodes = blocks.select(*own, "block", F.posexplode(parts).alias("part", "p")).where("p.text <> ''").select(*own, "block", "part", "p.kind", "p.text")
    heads = opened.groupBy(*own).agg(F.lit(0).cast("long").alias("block"), F.lit(0).alias("part")).select(*own, "block", "part", F.lit("HEADING").alias("kind"), F.col("sheet").alias("text"))
    return nodes.union(heads)


SHEET_SCHEMA = "path string, sheet_index int, sheet string, row long, cells array<string>"


def _sheet_rows(parts):
    """Rows of cells of all sheets; content, and path if it is given."""
    import pyarrow as pa

    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string())]
    for part in parts:
        paths = part.column(1).to_pylist() if part.num_columns > 1 else [None] * part.num_rows
        for content, path in zip(part.column(0), paths, strict=True):
            for i, (name, rows) in enumerate(_sheets(content.as_py())):
                for at in range(0, len(rows), 1000):
                    own = rows[at : at + 1000]
                    columns = ([path] * len(own), [i] * len(own), [name] * len(own), [r for r, _ in own], [c for _, c in own])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "sheet_index", "sheet", "row", "cells"])


def _sheets(content: bytes):
    """(name, rows of (number from 0, cells)) of a workbook's sheets, in its order."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    book = zipfile.ZipFile(io.BytesIO(content))
    held = set(book.namelist())
    main, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    shared = []
    if "xl/sharedStrings.xml" in held:
        shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    sheets = []
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= held:
        files = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name", "").strip(), f"xl/{files.get(s.get(f'{rel}id'))}") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{main}sheet")]
    else:
        numbered = sorted((int(m[1]), n) for n in held if (m := re.match(r"xl/worksheets/sheet(\d+)\.xml$", n)))
        sheets = [("", n) for _, n in numbered]
    for i, (name, file) in enumerate(sheets, 1):
        if file not in held:
            continue
        rows = []
        for row in ElementTree.fromstring(book.read(file)).iter(f"{main}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{main}c"):
                place = 0
                for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    place = place * 26 + ord(letter) - 64
                cells += [None] * (place - 1 - len(cells))
                v = c.find(f"{main}v")
                value = v.text if v is not None else "".join(t.text or "" for t in c.iter(f"{main}t")) or None
                cells.append(shared[int(value)] if c.get("t") == "s" and value is not None else value)
            rows.append((int(row.get("r", len(rows) + 1)) - 1, cells))
        yield name or f"Sheet {i}", rows


#: Extensions and MIME types of the kinds of document.
KINDS = {
    "PDF": ((".pdf",), ("application/pdf", "application/x-pdf")),
    "DOCX": ((".docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",)),
    "MARKDOWN": ((".md", ".markdown"), ("text/markdown", "text/x-markdown", "text/plain")),
    "XLSX": ((".xlsx", ".xlsm"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel.sheet.macroenabled.12")),
}


def document_kind(name: C, mime: C, content: C | None = None) -> Column:
    """PDF, DOCX, MARKDOWN or XLSX by content, then name, then MIME type; null if unsupported.

    A ZIP or a plain text counts by content only where name or MIME type agree; if they do not, nothing does.
    """
    lower, plain_mime = F.lower(col(name)), F.lower(F.trim(F.split_part(F.coalesce(col(mime), F.lit("")), F.lit(";"), F.lit(1))))
    by_name, by_mime = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (ends, mimes) in KINDS.items():
        by_name = F.when(F.regexp_extract(lower, r"(\.[^./]+)$", 1).isin(*ends), kind).otherwise(by_name)
        by_mime = F.when(plain_mime.isin(*mimes), kind).otherwise(by_mime)
    if content is None:
        return F.coalesce(by_name, by_mime)
    start = F.substring(col(content), 1, 4096)
    zipped = F.substring(start, 1, 4) == F.lit(b"PK\x03\x04")
    is_xlsx = (F.coalesce(by_name, F.lit("")) == "XLSX") | (F.coalesce(by_mime, F.lit("")) == "XLSX")
    plain = (F.position(F.lit(b"\x00"), start) == 0) & F.try_validate_utf8(start).isNotNull() & (F.length(start) > 0)
    sniffed = F.when(F.substring(start, 1, 4) == F.lit(b"%PDF"), "PDF").when(zipped, F.when(is_xlsx, "XLSX").otherwise("DOCX")).when(plain, "MARKDOWN")
    agrees = sniffed.eqNullSafe(by_name) | sniffed.eqNullSafe(by_mime)
    return F.when(sniffed.isin("DOCX", "MARKDOWN") & ~agrees, F.lit(None)).otherwise(F.coalesce(sniffed, by_name, by_mime))


def read_corpus(spark: SparkSession, path: str, suffixes: str = "{md,pdf,docx,xlsx}") -> DataFrame:
    """(path, kind, content, content_hash, length) of the documents under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffixes}").load(path)
    return files.select("path", document_kind("path", F.lit(""), "content").alias("kind"), "content", F.sha2("content", 256).alias("content_hash"), "length")


def changed_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that were not processed yet in their present state."""
    return files.join(done.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def export_markdown(docs: DataFrame, path: str, fields: list[str], text: str = "text", key: str = "document_id") -> DataFrame:
    """A Markdown file with front matter for each row; (key, file) of them is returned, and written as the folder's `_index`.

    path: a folder that all executors share.  A file is named by its key's hash, so that a task that
    runs again writes the same files.
    """
    front = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{f}: "), F.to_json(F.array(F.col(f).cast("string")))) for f in fields), F.lit("---"))
    body = F.concat(front, F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).cast("string").alias("key"), F.concat(F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, 32), F.lit(".md")).alias("file"), body.alias("body"))

    def write(parts):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for part in parts:
            for file, content in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                with store.open_output_stream(f"{folder}/{file}") as out:
                    out.write(content.encode())
            yield part.select(["key", "file"])

    rows.mapInArrow(write, "key string, file string").write.mode("overwrite").parquet(f"{path}/_index")
    return docs.sparkSession.read.parquet(f"{path}/_index")


def split_tables(rows: DataFrame) -> DataFrame:
    """Table rows with `heading` and `piece`: a row of one value over others is a heading and begins a piece; a total ends one.

    rows: table_id, row_no, cells.  Tables of fewer than four rows stay whole.
    """
    order = Window.partitionBy("table_id").orderBy("row_no")
    filled = F.size(F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    large = F.count("*").over(Window.partitionBy("table_id")) >= 4
    follows = F.lead(filled).over(order) > 1
    heading = large & (F.size("cells") > 1) & (filled == 1) & F.coalesce(follows, F.lit(False)) & (F.col("row_no") > F.min("row_no").over(Window.partitionBy("table_id")))
    total = large & F.exists("cells", lambda c: fold(F.coalesce(c, F.lit(""))).rlike("^(tong cong|tong|cong|total)$"))
    marked = rows.withColumns({"heading": heading, "_total": total})
    begins = F.col("heading") | F.coalesce(F.lag("_total").over(order), F.lit(False))
    return marked.withColumn("_begin", begins.cast("int")).withColumn("piece", F.sum("_begin").over(order)).drop("_begin", "_total")


def without_running_lines(lines: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """Drops lines at page margins that repeat, digits masked, on enough of a document's pages (of four pages at least).

    lines: document_id, page, line_no, text, margin (boolean).
    """
    masked = F.regexp_replace(F.trim("text"), r"\d+", "#")
    pages = lines.groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    seen = lines.where("margin").withColumn("masked", masked).groupBy("document_id", "masked").agg(F.countDistinct("page").alias("on"))
    running = seen.join(pages, "document_id").where((F.col("pages") >= 4) & (F.col("on") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))))
    marked = lines.withColumn("masked", F.when(F.col("margin"), masked))
    return marked.join(running.select("document_id", "masked"), ["document_id", "masked"], "left_anti").select(*lines.columns)


def joined_page_tables(tables: DataFrame) -> DataFrame:
    """Numbers tables so that one that goes on over a page break, with as many columns, has one number.

    tables: document_id, page, place, first_on_page, last_on_page, columns.
    """
    order = Window.partitionBy("document_id").orderBy("page", "place")
    goes_on = F.col("first_on_page") & F.lag("last_on_page").over(order) & (F.lag("columns").over(order) == F.col("columns")) & (F.lag("page").over(order) == F.col("page") - 1)
    return tables.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("table_no", F.sum("_new").over(order)).drop("_new")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it comes in fewer parts than there are; a table of many files stays as it is.

    For expressions that cost more than moving their rows, on tables of one row group.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


__all__ = ["changed_files", "document_kind", "export_markdown", "header_names", "joined_page_tables", "read_corpus", "read_csv_table", "read_xlsx_table", "split_tables", "spread", "table_of_cells", "without_running_lines", "xlsx_nodes"]
