import pytest
from pyspark.sql import functions as F

from tidemill.functions import extract
from tidemill.plans import dag, questions


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_numbers_and_citations(spark):
    assert one(spark, extract.extracted_number(F.lit("12/3 see Số: 50/QĐ-TNVN ngày"))) == "50/QĐ-TNVN"
    assert one(spark, extract.extracted_number(F.lit("nothing"))) is None
    known = F.array(F.lit("E1"), F.lit("E3"))
    assert one(spark, extract.renumbered_citations(F.lit("a [E3] b [E9] c [E1][E3]"), known)) == "a [1] b c [2][1]"
    assert one(spark, extract.unsupported_numbers(F.lit("1.500.000 and 7 and 42"), F.lit("42"))) == [1500000]
    assert one(spark, extract.identifiers_missing(F.lit("what of 50/QĐ-TNVN and 7/NQ-X"), F.lit("the 50 QĐ TNVN"))) == ["7NQX"]
    assert one(spark, extract.glued_ratio(F.lit("ok " + "x" * 40))) == 0.5
    assert one(spark, extract.nfc(F.lit(" e\u0301 "))) == "\u00e9"


def test_labels_relations_figures(spark):
    text = "Họ tên: Nguyễn A\nKính gửi:\nÔng B\n\nCăn cứ Quyết định số 50/QĐ-TNVN;\nThay thế Nghị quyết 7/NQ-HĐ.\n![a](x.png) ![b](y.png) ![c](x.png)"
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    got = {r.field: r.value for r in extract.labelled_values(df, {"ho ten": "name", "kinh gui": "to"}).collect()}
    assert got == {"name": "Nguyễn A", "to": "Ông B"}
    facts = {(r.relation_type, r.target_number_norm) for r in extract.relations(df).collect()}
    assert ("BASED_ON", "50QDTNVN") in facts and any(k == "REPLACES" and n.startswith("7NQH") for k, n in facts)
    assert sorted((r.number, r.target) for r in extract.figures(df).collect()) == [(1, "x.png"), (2, "y.png")]
    assert df.select(F.size(extract.header_lines("text", 2, 1))).first()[0] == 3


def test_images_keep_their_order(spark):
    df = spark.createDataFrame([("d", ["alpha one", "beta two", "gamma three", "delta four"], ["the beta", "the delta"])], "document_id string, lines array<string>, images array<string>")
    assert [tuple(r)[1:] for r in extract.aligned_images(df).orderBy("image").collect()] == [(0, 1), (1, 3)]


def test_variants():
    assert "ký" in extract.spelling_variants("kí") and "kí" in extract.spelling_variants("ký")
    assert set(extract.spelling_variants("hòa")) == {"hòa", "hoà"}
    assert len(extract.phrase_variants("hòa hòa hòa hòa")) == 6


def test_graphs(spark):
    needs = {"d": ["b", "c"], "b": ["a"], "c": ["a"], "a": []}
    assert dag.depths(needs) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert dag.order(needs) == ["a", "b", "c", "d"] and dag.ready(needs, {"a", "b"}) == ["c"]
    with pytest.raises(dag.CycleError):
        dag.depths({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        dag.depths({"a": ["x"]})
    v = spark.createDataFrame([("1.10.0",), ("v1.9.3",), ("x",)], "v string")
    assert v.orderBy(dag.version_key("v").desc_nulls_last()).first()[0] == "1.10.0"


def test_questions():
    assert questions.cleaned("Please list cntracts??", {"cntracts": "contracts"}) == "list contracts"
    q = questions.parse_search('quick "brown fox" -dog cat OR "bird"')
    assert (q.terms, q.phrases, q.any_of, q.none_of) == (["quick"], [["brown", "fox"]], ["cat", "bird"], ["dog"])
    assert questions.bigrams("the cat of the") == [["the", "cat"], ["cat", "of"]]
    assert [questions.route(t) for t in ("Có bao nhiêu văn bản", "văn bản mới nhất", "liệt kê hợp đồng", "ai ký quyết định", "nội dung")] == ["COUNT", "LATEST", "LIST", "RELATION", "CONTENT"]
    assert questions.expansion("liệt kê") == "NONE" and questions.expansion("x") == "PARENT" and questions.expansion("liệt kê", "NEIGHBORS") == "NEIGHBORS"


def test_names_figures_json(spark):
    assert one(spark, extract.renumbered(F.lit("Figure 9, figure 2 and Figure 9."), "Figure")) == "Figure 1, Figure 2 and Figure 3."
    names = ["Ông Nguyễn Văn A - 123", "nguyễn văn a", "Mr. John Smith", "X"]
    assert [one(spark, extract.person_name(F.lit(n))) for n in names] == ["Nguyễn Văn A", None, "John Smith", None]
    raw = '{"apiKey": "x", "a": {"b": {"c": 1}}, "t": "sk-abc", "l": [1, 2, 3]}'
    assert one(spark, extract.bounded_json(F.lit(raw), depth=2, items=4)) == '{"apiKey":"x","a":{"b":"[MAX_DEPTH]"},"t":"[REDACTED_SECRET]","l":[1,2,3]}'.replace('"apiKey":"x"', '"apiKey":"[REDACTED]"')
    assert one(spark, extract.bounded_json(F.lit("no json"))) is None


def test_sources_are_filled_up(spark):
    n = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, doc_date int")
    r = spark.createDataFrame([("b", 0.9)], "document_id string, score double")
    more = spark.createDataFrame([("c", 3), ("a", 1), ("d", 4)], "document_id string, doc_date int")
    assert [x[0] for x in extract.chosen_sources(n, r, more, 3).collect()] == ["b", "a", "d"]


def test_uncited_data(spark):
    answer = "# 2024 report\nRevenue was 1.200.000. It grew 5% [1]. Nothing here.\n- On 5/3/2024 it closed; 7 left\n_(in 2023)\n⚠ 12 %"
    assert one(spark, extract.uncited_data(F.lit(answer))) == ["Revenue was 1.200.000.", "- On 5/3/2024 it closed;"]
    assert one(spark, extract.uncited_data(F.lit("of 2024 " + "x" * 300))) == ["of 2024 " + "x" * 152]


def test_uncited_data_keeps_the_digits_at_a_lines_ends(spark):
    assert one(spark, extract.uncited_data(F.lit("0123\n 1 of 2024 in 111 "))) == ["0123", "1 of 2024 in 111"]


def test_relations(spark):
    text = """QUYẾT ĐỊNH
- Căn cứ Luật Báo chí ngày 05/4/2016, Nghị định số 15/2020/NĐ-CP ngày 3 tháng 2 năm 2020; Quyết định số 50/QĐ-TNVN của Tổng giám đốc;
Căn cứ Quy chế này và Thông tư 7/TT-BTC
Xét đề nghị của Ban Tổ chức tại Tờ trình số 12/TTr-TC
Điều 1. Quyết định này thay thế Quyết định số 9/QĐ-X. Phụ lục kèm theo
Sửa đổi, bổ sung một số điều của Quy định 3/QĐ-Y; thay thế văn bản cũ
Kinh phí theo Quyết định số 44/QĐ-Z ngày 01/02/2023
Nơi nhận: Căn cứ Luật 1/QH
"""
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string")
    got = {(r.relation_type, r.target_number_norm, str(r.target_date) if r.target_date else None) for r in extract.relations(df).collect()}
    assert got == {
        ("BASED_ON", None, "2016-04-05"),
        ("BASED_ON", "152020NDCP", "2020-02-03"),
        ("BASED_ON", "50QDTNVN", None),
        ("BASED_ON", "7TTBTC", None),
        ("PROPOSED_BY", "12TTRTC", None),
        ("REPLACES", "9QDX", None),
        ("AMENDS", "3QDY", None),
        ("FUNDED_BY", "44QDZ", "2023-02-01"),
    }


def test_formulas_and_abstention(spark):
    df = spark.createDataFrame([("d", 2, "$$ a  = b $$ (1) and $$c$$ (2.1)"), ("d", 1, "see $$ x $$ (1), $$ $$ (3), $$y$$ none")], "document_id string, part int, text string")
    assert sorted((r.number, r.body) for r in extract.formulas(df, order="part").collect()) == [("1", "x"), ("2.1", "c")]
    asked = F.lit("what do 50/QĐ-TNVN and 7/NQ-X say")
    held = [F.lit("the 50 QĐ TNVN"), F.lit("nothing of it"), F.lit(""), F.lit(None).cast("string")]
    assert [one(spark, extract.abstains(asked, e)) for e in held] == [False, True, False, False]
    assert not one(spark, extract.abstains(F.lit("what is new"), F.lit("x")))


def test_dispatch(spark):
    ids = lambda n: spark.range(n).select(F.col("id").cast("string").alias("document_id"))
    assert questions.dispatch("x", followup=ids(2), relation=ids(1)).mode == "DOCUMENT_SEARCH"
    assert [questions.dispatch("x", relation=ids(n)).mode for n in (0, 8, 9)] == ["NONE", "CORPUS", "NONE"]
    assert questions.dispatch("Có bao nhiêu văn bản", metadata=ids(3)).route == "COUNT"
    got = [questions.dispatch("x", metadata=ids(n), with_content=True) for n in (0, 8, 9)]
    assert [(a.route, a.mode, a.rows is None, a.scope is None) for a in got] == [("CONTENT", "CORPUS", True, True), ("METADATA", "DOCUMENT_SEARCH", True, False), ("METADATA", "NONE", False, True)]
    assert questions.dispatch("x") == questions.Answer("CONTENT")


def test_administrative_fields(spark):
    from tidemill.functions import administrative as adm

    lines = lambda *x: F.array(*map(F.lit, x))
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(adm.issuer(lines("  ", "CỘNG HÒA", "## ĐÀI TIẾNG NÓI VIỆT NAM - VOV", "BỘ Y TẾ"))) == "Đài Tiếng nói Việt Nam"
    assert get(adm.issuer(lines("Số 5", "*UBND  TỈNH Hà Giang*"))) == "Ubnd Tỉnh Hà Giang"
    assert get(adm.issuer(lines("Quyết định của Bộ Y tế", "không có"))) is None
    assert get(adm.subject(lines("CHỈ THỊ", "về  tiết kiệm điện;", "ở các đơn vị", "và kho", "nữa", "Căn cứ"))) == "Về việc tiết kiệm điện; ở các đơn vị và kho"
    assert get(adm.subject(lines("QUYẾT ĐỊNH Về việc phí.", "Điều 1"))) == "Về việc phí"
    assert get(adm.subject(lines("Ban nói Về việc A", "xét đề nghị của B", "Về việc C"))) is None
    assert get(adm.subject(lines("VỀ việc A", "Nơi nhận: b"))) == "Về việc A"
    assert tuple(get(adm.signatory(lines("TỔNG GIÁM ĐỐC", "KT. TỔNG GIÁM ĐỐC", "PHÓ TỔNG GIÁM ĐỐC", "(đã ký)", "Nơi nhận", "Trần Hoà", "Lê Văn")))) == ("Trần Hoà", "Phó Tổng Giám đốc")
    assert tuple(get(adm.signatory(lines("Hiệu trưởng", "Lưu: VT", "A.")))) == (None, "Hiệu trưởng")
    assert get(adm.signatory(lines("không ai", "Lê Văn A"))) is None and get(adm.subject(F.lit(None).cast("array<string>"))) is None
