import random

from pyspark.sql import functions as F

from tidemill.operators import layout

BLOCKS = "document_id string, page int, place int, lines array<string>, size double, bold boolean"


def test_paths_are_a_stack(spark):
    rng = random.Random(5)
    rows, want = [], []
    for d in range(5):
        stack = []
        for i in range(60):
            level = rng.choice([None, None, 1, 2, 3, 4, 5, 6])
            text = f"t{i}"
            rows.append((f"d{d}", i // 7, i % 7, 0, level, text))
            want.append((f"d{d}", i, [t for _, t in stack]))
            if level:
                stack = [s for s in stack if s[0] < level] + [(level, text)]
    df = spark.createDataFrame(rows, "document_id string, page int, place int, part int, level int, text string").repartition(4)
    got = {(r["document_id"], int(r["text"][1:])): r["heading_path"] for r in layout.with_paths(df).collect()}
    assert got == {(d, i): p for d, i, p in want}


def test_fonts(spark):
    body = "x" * 80
    rows = [("a", 1, 0, ["Big"], 20.0, False), ("a", 1, 1, ["Mid", "dle"], 14.1, False), ("a", 1, 2, [body], 10.0, False), ("a", 1, 3, ["Near mid"], 13.9, False), ("a", 1, 4, ["Bold"], 10.0, True),
            ("a", 1, 5, ["Ends with a stop."], 20.0, False), ("a", 1, 6, [" "], 20.0, False), ("a", 2, 0, ["a", "b", "c", "d"], 20.0, False), ("a", 2, 1, ["No size"], None, None), ("b", 1, 0, ["Only"], 9.0, True)]
    got = {(r["document_id"], r["page"], r["place"]): r["level"] for r in layout.heading_tree(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == {("a", 1, 0): 1, ("a", 1, 1): 2, ("a", 1, 2): None, ("a", 1, 3): 2, ("a", 1, 4): 4, ("a", 1, 5): None, ("a", 2, 0): None, ("a", 2, 1): None, ("b", 1, 0): 2}
    assert layout.heading_tree(spark.createDataFrame([], BLOCKS)).count() == 0


def test_outline(spark):
    rows = [("a", 1, 0, ["1. Mở đầu", "Lời nói."], 10.0, False), ("a", 1, 1, ["Khác"], 10.0, False), ("a", 2, 0, ["Phần thứ hai"], 10.0, False), ("a", 2, 1, ["Thân"], 10.0, False), ("b", 1, 0, ["Mở đầu"], 10.0, False)]
    outline = [("a", 1, 0, 1, "Mở đầu"), ("a", 2, 1, 2, "Phần thứ hai của sách"), ("a", 2, 2, 1, "Không thấy"), ("b", 1, 0, 1, "Mở đầu")]
    df = layout.heading_tree(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(outline, "document_id string, page int, place int, level int, title string"))
    got = [(r["document_id"], r["page"], r["kind"], r["level"], r["text"], r["heading_path"]) for r in df.orderBy("document_id", "page", "place", "part").collect()]
    assert got == [
        ("a", 1, "HEADING", 1, "1. Mở đầu", []),
        ("a", 1, "PARAGRAPH", None, "Lời nói.", ["1. Mở đầu"]),
        ("a", 1, "PARAGRAPH", None, "Khác", ["1. Mở đầu"]),
        ("a", 2, "HEADING", 1, "Không thấy", ["1. Mở đầu"]),
        ("a", 2, "HEADING", 2, "Phần thứ hai của sách", ["Không thấy"]),
        ("a", 2, "PARAGRAPH", None, "Thân", ["Không thấy", "Phần thứ hai của sách"]),
        ("b", 1, "PARAGRAPH", None, "Mở đầu", []),
    ]
    assert df.where(F.col("level") > 6).count() == 0
