import pytest
from pyspark.sql import functions as F

from tidemill.functions.text import to_number
from tidemill.plans.table_plan import PlanError, TablePlan, compile_plan, to_markdown
from tidemill.sources.files import header_names, read_csv_table, read_xlsx_table, table_of_cells

CELLS = [
    ["Kho", "Mặt hàng", "Tồn", "Giá"],
    ["K1", "Đèn bàn", "12", "350.000 đ"],
    ["K2", "Ghế gỗ", "4", "1.050.000 đ"],
    [None, "  ", "", None],
    ["K1", "Ghế gỗ", "7", "990.500 đ"],
    ["K3", "Đèn bàn", "", "410.000 đ"],
    ["K2", "Tủ", "1", "liên hệ"],
]


@pytest.fixture
def stock(spark):
    return table_of_cells(spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "row long, cells array<string>"))


@pytest.mark.parametrize(
    "cell,value",
    [
        ("42", 42.0), ("0,75", 0.75), ("9.81", 9.81), ("6.400 kg", 6400.0), ("6,400", 6400.0), ("10.250,5", 10250.5), ("7.000.000", 7e6), ("8,000,000", 8e6),
        ("5,000,000.25", 5000000.25), ("-3", -3.0), ("0.500", 500.0), ("35 %", 35.0), ("T8 2025", 82025.0), ("n/a", None), ("", None), (None, None), ("--", None), ("3,456.78", None), ("4-5", None),
    ],
)
def test_numbers(spark, cell, value):
    assert spark.createDataFrame([(cell,)], "c string").select(to_number("c")).first()[0] == value


def test_boolean_is_no_number(spark):
    assert spark.range(1).select(to_number(F.lit(False), "boolean")).first()[0] is None


def test_headers():
    assert header_names(["Size", None, "Size", " Size "]) == ["Size", "Cột 2", "Size (3)", "Size (4)"]


def test_sum_by_item_in_order_of_the_sum(stock):
    plan = {"group_by": ["mat hang"], "aggregates": [{"fn": "sum", "column": "gia"}, {"fn": "max", "column": "ton"}, {"fn": "count", "column": "*"}], "sort_by": "sum(Giá)"}
    out = compile_plan(plan, stock, order="row")
    assert out.columns == ["Mặt hàng", "sum(Giá)", "max(Tồn)", "count(*)"]
    assert [tuple(r) for r in out.collect()] == [("Tủ", None, 1.0, 1), ("Ghế gỗ", 2040500.0, 7.0, 2), ("Đèn bàn", 760000.0, 12.0, 2)]


def test_filters_compare_folded_texts_and_numbers(stock):
    plan = {"filters": [{"column": "Mặt hàng", "op": "=", "value": "den BAN"}, {"column": "Giá", "op": "<", "value": "400.000"}], "select": ["Kho"]}
    assert [r[0] for r in compile_plan(plan, stock, order="row").collect()] == ["K1"]
    assert compile_plan({"aggregates": [{"fn": "avg", "column": "Tồn"}, {"fn": "count", "column": "Tồn"}]}, stock).first()[:] == (6.0, 4)


def test_null_is_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "C")], "n int, s string")
    rows = lambda op, v: [r[0] for r in compile_plan({"filters": [{"column": "s", "op": op, "value": v}], "select": ["n"]}, df, order="n").collect()]
    assert rows("!=", "b") == [1, 3]
    assert rows("<", "b") == [1]
    assert rows("contains", "c") == [3]
    assert rows("=", "") == [1]


def test_sort_puts_texts_first_when_descending(spark):
    df = spark.createDataFrame([(0, "10"), (1, "x"), (2, "9"), (3, "a"), (4, "9")], "i int, v string")
    down = compile_plan({"select": ["v"], "sort_by": "v"}, df, order="i").collect()
    assert [r[0] for r in down] == ["x", "a", "10", "9", "9"]
    up = compile_plan({"select": ["v"], "sort_by": "v", "descending": False}, df, order="i").collect()
    assert [r[0] for r in up] == ["9", "9", "10", "a", "x"]


@pytest.mark.parametrize("limit,rows", [(0, 1), (500, 50), ("x", 20), (None, 20), ("7", 7)])
def test_limit_is_clamped(limit, rows):
    assert TablePlan(limit=limit).rows == rows


@pytest.mark.parametrize(
    "plan",
    [{"select": ["nothing"]}, {}, {"aggregates": [{"fn": "sum", "column": "*"}]}, {"aggregates": [{"fn": "median", "column": "Tồn"}]}, {"select": ["Kho"], "filters": [{"column": "Kho", "op": "~", "value": "1"}]}, {"code": "1"}],
)
def test_bad_plans(stock, plan):
    with pytest.raises(PlanError):
        compile_plan(plan, stock)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("a"), F.col("id").alias("b"), F.lit(1).alias("c")).write.parquet(f"{tmp_path}/t")
    out = compile_plan({"filters": [{"column": "a", "op": ">=", "value": 3}], "group_by": ["b"], "aggregates": [{"fn": "count"}]}, spark.read.parquet(f"{tmp_path}/t"))
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a,3.0)" in plan and "c#" not in plan.split("ReadSchema")[-1]


def test_csv_and_markdown(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Name,Amount\n"a ""q"" | b",1234.5\n\n,2\n', encoding="utf-8")
    table = read_csv_table(spark, str(tmp_path / "t.csv"))
    assert [tuple(r)[1:] for r in table.orderBy("row").collect()] == [('a "q" | b', "1234.5"), (None, "2")]
    assert to_markdown(table.orderBy("row").select("Name"), "T").splitlines() == ["T", "", "| Name |", "|---|", '| a "q" \\| b |', "|  |"]
    assert to_markdown(spark.createDataFrame([(1234.5,)], "v double")).splitlines()[-1] == "| 1.234,5 |"


def test_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>A</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>C</t></is></c></row><row><c r="B2"><v>4.5</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    table = read_xlsx_table(spark, str(tmp_path / "t.xlsx"))
    assert table.columns == ["row", "A", "Cột 2", "C"]
    assert tuple(table.first())[1:] == (None, "4.5", "x")
