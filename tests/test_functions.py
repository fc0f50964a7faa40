from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemill.functions import dates, ids, text, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("raw,want", [("  Đỗ  Văn A ", "do van a"), ("STRASSE straße ẞ"[:14], "strasse strasse"), ("Café é", "cafe e"), (None, None), ("a b", "a b")])
def test_fold(spark, raw, want):
    assert one(spark, text.fold(F.lit(raw).cast("string"))) == want
    if raw is not None:
        assert text.fold_value(raw) == want


def test_tokens_and_truncation(spark):
    assert [one(spark, text.estimate_tokens(F.lit(t))) for t in ("", "a", "a" * 400, "| a | b |", "# - x")] == [0, 1, 108, 8, 3]
    assert one(spark, text.truncate_tokens(F.lit("abcd   efgh"), 1)) == "abcd"
    assert one(spark, text.truncate_tokens(F.lit("ab "), 1)) == "ab "
    assert one(spark, text.normalise_lines(F.lit("a  \n\n\n\nb​ \n"))) == "a\n\nb"


def test_sentences(spark):
    assert one(spark, text.sentences(F.lit("One. Two! Three"))) == ["One.", "Two!", "Three"]
    assert one(spark, text.sentences(F.lit("a\n\nb"))) == ["a", "b"]


def test_sentences_keep_their_figures_and_lose_their_blanks(spark):
    # a sentence's place in the text was taken off its ends as digits, and blanks were left
    assert one(spark, text.sentences(F.lit("0 a 0. 1.5 of 11. 2 \u00a0c\u3000"))) == ["0 a 0.", "1.5 of 11.", "2 \u00a0c"]
    assert one(spark, text.sentences(F.lit("  0 a 0\n 1 b 1 \n\u00a0\n"))) == ["0 a 0", "1 b 1"]
    assert one(spark, text.sentences(F.lit("a.\x0bb.\t\r\nc"))) == ["a.\x0bb.", "c"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("key sk-abc123 end", "key [REDACTED_SECRET] end"),
        ("Authorization: Bearer abc.def", "Authorization: [REDACTED_SECRET]"),
        ("mail john.doe@example.com", "mail j***@[REDACTED]"),
        ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", "[REDACTED_SECRET]"),
        ("x" * 501, "x" * 500 + "... [TRUNCATED]"),
        ("clean", "clean"),
    ],
)
def test_redaction(spark, raw, want):
    assert one(spark, text.redact(F.lit(raw))) == want


def test_number_rule(spark):
    of = lambda n, w: one(spark, text.number_matches(F.lit(n), w))
    assert of("1119QDTNVN", "1119") and not of("11190QD", "1119") and of("1119", "1119") and not of("1119QD", "119QD")
    assert one(spark, text.document_number(F.lit("50/QĐ-TNVN"))) == "50QDTNVN"


def test_html_and_cells(spark):
    raw = "<html><head><title>t</title></head><body><script>x()</script><p>A &amp; B</p><div>C<br>D</div></body>"
    assert one(spark, text.html_to_text(F.lit(raw))).split("\n") == ["A & B", "", "C", "D"] or one(spark, text.html_to_text(F.lit(raw))).split() == ["A", "&", "B", "C", "D"]
    assert one(spark, text.local_number(F.lit(1234.5))) == "1.234,5"
    assert one(spark, text.table_cell(F.lit("a|<b>"))) == "a\\|&lt;b&gt;"
    assert one(spark, text.head_tail(F.lit("abcdefghij"), 2, 2)).startswith("ab\n... [6 ")


def test_triggers(spark):
    asked = F.lit("Làm ơn GỬI thư, nhanh")
    assert one(spark, text.trigger_matches(asked, "gui thu")) and one(spark, text.trigger_matches(asked, "ơn gửi"))
    assert not one(spark, text.trigger_matches(asked, "thu gui")) and one(spark, text.trigger_matches(asked, "thu gui", token_subset=True))
    assert not one(spark, text.trigger_matches(asked, "gu")) and not one(spark, text.trigger_matches(asked, " "))
    assert not one(spark, text.trigger_matches(F.lit("(send) it"), "send")) and one(spark, text.trigger_matches(F.lit("send; it"), "send"))
    assert one(spark, text.trigger_matches(F.lit("abc 123"), r"/\d+/"))
    assert one(spark, text.glob(F.lit("mail.read"), "mail.*")) and not one(spark, text.glob(F.lit("email.read"), "mail.*"))


@pytest.mark.parametrize(
    "raw,want",
    [("Hà Nội, ngày 23 tháng 4 năm 2026", date(2026, 4, 23)), ("on 2024-02-30 or", None), ("5/3/2024", date(2024, 3, 5)), ("March 5th, 2024", date(2024, 3, 5)), ("5 Mar 2024", date(2024, 3, 5)), ("tháng 7/2023", date(2023, 7, 1)), ("1/1/1800", None), ("none", None),
     ("31/02/2024", None), ("2024-13-45 ... 07/2024", None), ("ngày 31 tháng 2 năm 2024 và 5/2024", None), ("ngày 2.3 tháng 4. năm 2026", date(2026, 4, 23)),
     ("May 2026", date(2026, 5, 1)), ("ký 3-2024", date(2024, 3, 1)), ("3 / 2024", date(2024, 3, 1)), ("ngày 5 tháng 6 năm 2026 thay 1/1/2020", date(2026, 6, 5)), ("1/1/2020 và 2021-02-03", date(2021, 2, 3)),
     ("February 30, 2024", None), ("Mayor 2026", None)],
)
def test_dates(spark, raw, want):
    assert one(spark, dates.any_date(F.lit(raw))) == want


@pytest.mark.parametrize(
    "question,want",
    [
        ("từ 01/02/2024 đến 15/02/2024", (date(2024, 2, 1), date(2024, 2, 15))),
        ("quý III năm 2023", (date(2023, 7, 1), date(2023, 9, 30))),
        ("tháng 2 năm 2024", (date(2024, 2, 1), date(2024, 2, 29))),
        ("tháng này", (date(2026, 5, 1), date(2026, 5, 31))),
        ("tháng trước", (date(2026, 4, 1), date(2026, 4, 30))),
        ("năm ngoái", (date(2025, 1, 1), date(2025, 12, 31))),
        ("trước 05/06/2020", (None, date(2020, 6, 5))),
        ("năm 2022", (date(2022, 1, 1), date(2022, 12, 31))),
        ("tháng 2", (None, None)),
        ("q1 plan", (None, None)),
        ("quý 5 năm 2021", (date(2021, 1, 1), date(2021, 12, 31))),
        ("năm ngoái, sau 01/02/2024", (date(2025, 1, 1), date(2025, 12, 31))),
        ("kể từ ngày 01/02/2024", (date(2024, 2, 1), None)),
        ("hello", (None, None)),
    ],
)
def test_question_ranges(question, want):
    assert dates.question_range(question, date(2026, 5, 14)) == want


def test_ids(spark):
    assert one(spark, ids.heading_list(F.lit('["a","b"]'))) == ["a", "b"]
    assert one(spark, ids.heading_list(F.lit("x"))) == ["x"]
    assert one(spark, ids.heading_list(F.lit(None).cast("string"))) == []
    assert one(spark, ids.first_object(F.lit('so {"a": {"b": 1}} {"c": 2}'))) == '{"a": {"b": 1}}'
    assert one(spark, ids.first_full(F.lit(" "), F.lit(None), F.lit(" x "))) == "x"
    assert one(spark, ids.stable_id("par-", F.lit("a"))).startswith("par-") and len(one(spark, ids.stable_id("par-", F.lit("a")))) == 36


@pytest.mark.parametrize(
    "found,expected,want",
    [
        (["a", "b"], ["b"], (1.0, 0.5, 0.6309)),
        (["a"], ["b"], (0.0, 0.0, 0.0)),
        ([], [], (1.0, 1.0, 1.0)),
        (["a"], [], (0.0, 0.0, 0.0)),
        (["b", "a", "c"], ["b", "c"], (1.0, 1.0, 0.9197)),
        (["x", "y"], ["a", "y", "b"], (0.3333, 0.5, 0.2961)),
    ],
)
def test_ranking_metrics(spark, found, expected, want):
    df = spark.createDataFrame([(found, expected)], "f array<string>, e array<string>")
    got = df.select(vectors.recall_at("f", "e"), vectors.reciprocal_rank("f", "e"), vectors.ndcg_at("f", "e")).first()
    assert tuple(got) == pytest.approx(want, abs=1e-4)


def test_graded_ndcg(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"], {"a": 1.0, "b": 2.0})], "f array<string>, e array<string>, g map<string,double>")
    assert df.select(vectors.ndcg_at("f", "e", 10, "g")).first()[0] == pytest.approx((1 + 3 / 1.58496) / (3 + 1 / 1.58496), abs=1e-4)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    assert tuple(df.select(vectors.cosine("a", "b"), vectors.cosine("a", "z"), vectors.norm("a")).first()) == (pytest.approx(0.96), None, 5.0)
    assert df.select(vectors.unit("a"), vectors.unit("z")).first()[1] is None
    bad = spark.createDataFrame([([1.0, float("nan")],), ([1.0],), (None,), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in bad.select(vectors.valid_vector("v", 2)).collect()] == [False, False, False, True]


NOW = datetime(2026, 5, 14, 3, 30, tzinfo=UTC)  # a Thursday, 10:30 in Hanoi
HANOI = "Asia/Ho_Chi_Minh"


@pytest.mark.parametrize(
    "question,begin,hours",
    [("lịch ngày mai", (15, 0, 0), 24), ("sáng mai", (15, 0, 0), 24), ("hôm nay có gì", (14, 0, 0), 24), ("tuần này", (11, 0, 0), 168), ("lịch họp", (14, 10, 30), 168), ("tối nay gặp Mai", (14, 0, 0), 24)],
)
def test_calendar_windows(question, begin, hours):
    start, end = dates.calendar_window(question, NOW, HANOI)
    assert (start.day, start.hour, start.minute) == begin and end - start == timedelta(hours=hours)


def test_past_windows():
    day = datetime(2026, 5, 14, tzinfo=ZoneInfo(HANOI))
    assert dates.past_window("hôm qua", NOW, HANOI) == (day - timedelta(days=1), day)
    assert dates.past_window("hôm nay", NOW, HANOI) == (day, NOW)
    assert dates.past_window("gần đây", NOW.replace(tzinfo=None), HANOI) == (NOW - timedelta(days=14), NOW)


@pytest.mark.parametrize(
    "phrase,want",
    [
        ("họp 10h sáng mai", (15, 10, 0)),
        ("14:30 họp", (14, 14, 30)),
        ("họp lúc 9h", (15, 9, 0)),
        ("chiều nay 3 giờ", (14, 15, 0)),
        ("tối mai lúc 8h15", (15, 20, 15)),
        ("thứ năm 9h", (21, 9, 0)),
        ("thứ năm 11h", (14, 11, 0)),
        ("cn 7h", (17, 7, 0)),
        ("tôi họp 8h mai", (15, 8, 0)),
        ("12h trưa thứ 2", (18, 12, 0)),
        ("họp mai", None),
        ("25h mai", None),
    ],
)
def test_event_times(phrase, want):
    got = dates.event_times(phrase, NOW, HANOI)
    assert (got and (got[0].day, got[0].hour, got[0].minute)) == want
    assert got is None or got[1] - got[0] == timedelta(hours=1)


@pytest.mark.parametrize(
    "task,want",
    [
        ("nộp báo cáo hạn thứ 6", date(2026, 5, 15)),
        ("gọi lại thứ năm", date(2026, 5, 21)),
        ("họp với mai", None),
        ("họp với Mai ngày mai", date(2026, 5, 15)),
        ("xong trước 20/5", date(2026, 5, 20)),
        ("xong trước 1/2", date(2027, 2, 1)),
        ("xong trước 1/2/2026", date(2026, 2, 1)),
        ("ngày 31/2", None),
        ("hôm nay hoặc ngày kia", date(2026, 5, 16)),
        ("việc gì đó", None),
    ],
)
def test_due_dates(task, want):
    assert dates.due_date(task, date(2026, 5, 14)) == want


def test_times_of_zones_and_briefings(spark):
    at = F.lit("2026-05-14 03:30:00").cast("timestamp_ntz")
    assert str(one(spark, dates.in_zone(at.cast("timestamp"), HANOI).cast("string"))) == "2026-05-14 10:30:00"
    due = lambda start, last: one(spark, dates.briefing_due(F.lit(start), F.lit(last).cast("timestamp_ntz"), at, 2))
    assert due(180, None) and due(100, "2026-05-13") and not due(180, "2026-05-14") and not due(60, None) and not due(240, None)


@pytest.mark.parametrize("raw", ["Ｆｕｌｌ ＷＩＤＴＨ", "ﬁn ﬂoor", "Straße ẞ", "Đường é", "Ĳssel", "ά Й 5²", "한글 e\u0301"])
def test_a_literal_folds_as_a_column(spark, raw):
    assert one(spark, text.fold(F.lit(raw))) == text.fold_value(raw)


def test_folded_values():
    assert [text.fold_value(t) for t in ("Ｆｕｌｌ", "ﬁn", "Straße", "ĐƯỜNG")] == ["full", "fin", "strasse", "duong"]


def test_head_and_tail_are_bytes(spark):
    assert one(spark, text.head_tail(F.lit("short"), 5, 5)) == "short"
    assert one(spark, text.head_tail(F.lit("aéééééééz"), 4, 2)) == "aé\n... [10 bytes omitted] ...\nz"
    assert one(spark, text.head_tail(F.lit("🙂" * 9), 6, 9)) == "🙂\n... [21 bytes omitted] ...\n🙂🙂"
    assert one(spark, text.sliced(F.lit("abcdef"), 2, 3)) == "cde"


def test_lines_folded_together_are_those_folded_alone(spark):
    lines = ["Đỗ  Văn A", "", " ﬁ ĲSSEL¨ ", "e\u0301\u00a0\t x", "a\x01b", "ASCII  \x0b only", "ß"]
    got = one(spark, text.folded_lines(F.array(*map(F.lit, lines))))
    assert got == [one(spark, text.fold(F.lit(x.replace("\x01", "\x02")))) for x in lines]
    assert one(spark, text.folded_lines(F.array().cast("array<string>"))) == []
    assert one(spark, text.folded_lines(F.lit(None).cast("array<string>"))) is None


def test_administrative_fields_of_one_file_are_dealt_to_all_cores(spark):
    from tidemill import function_queries

    out = function_queries.administrative_fields(spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
