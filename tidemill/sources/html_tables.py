"""HTML tables as rows of a grid: spans are filled in, so that every row has a cell in every column.

A cell that spans columns or rows stands in each place that it covers; a row that is shorter than the table is
filled with nulls.  Tables are found in the page's text by Spark; one table is laid out at a time, in Arrow
batches.  A row span ends with its table at the latest, a column span has 1,000 columns at most (both as in the
HTML standard); a span of 0 rows reaches to the table's end.  A table without cells gives no rows, as does a null page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MOST_COLUMNS = 1000
_TABLE = r"(?is)<table\b[^>]*>(.*?)</table\s*>"
_ROW = r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|$)"
_CELL = re.compile(r"<t([dh])\b([^>]*)>(.*?)(?=<t[dhr]\b|</t[dhr]\s*>|$)", re.DOTALL | re.IGNORECASE)
_SPAN = {kind: re.compile(rf"\b{kind}span\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE) for kind in ("row", "col")}


def _span(attributes: str, kind: str) -> int:
    found = _SPAN[kind].search(attributes)
    return int(found[1]) if found else 1


def _text(cell: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", cell)).split())


def laid_out(rows: list[str]) -> list[list[tuple[str, bool] | None]]:
    """The grid of a table's rows: (text, header) in each place, None where no cell is."""
    grid: dict[tuple[int, int], tuple[str, bool]] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in _CELL.finditer(row):
            while (r, c) in grid:
                c += 1
            down, across = _span(cell[2], "row") or len(rows), min(MOST_COLUMNS, max(1, _span(cell[2], "col")))
            value = (_text(cell[3]), cell[1].lower() == "h")
            for y in range(r, min(len(rows), r + down)):
                for x in range(c, c + across):
                    grid.setdefault((y, x), value)
            c += across
    width = 1 + max((x for _, x in grid), default=-1)
    return [[grid.get((y, x)) for x in range(width)] for y in range(len(rows))] if width else []


def table_rows(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, table_no, row_no, cells, header): the rows of all tables of pages, numbered from 0; header: all cells are header cells."""
    tables = pages.select(F.col(id_col).alias("page"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(_TABLE), F.lit(1))).alias("table_no", "body"))
    rows = tables.select("page", "table_no", F.regexp_extract_all("body", F.lit(_ROW), F.lit(1)).alias("rows"))
    schema = T.StructType(
        [T.StructField("page", rows.schema["page"].dataType), *T._parse_datatype_string("table_no int, row_no int, cells array<string>, header boolean").fields]
    )
    arrow = to_arrow_schema(schema)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, row_no, cells, header = [], [], [], [], []
            for i, own in enumerate(batch.column("rows").to_pylist()):
                for r, row in enumerate(laid_out(own)):
                    at.append(i)
                    row_no.append(r)
                    cells.append([c and c[0] for c in row])
                    header.append(all(c is not None and c[1] for c in row))
            places = pa.array(at, pa.int64())
            columns = [batch.column("page").take(places), batch.column("table_no").take(places), row_no, cells, header]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c, f.type)).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(lay, schema).withColumnRenamed("page", id_col)
