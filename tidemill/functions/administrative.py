"""Issuer, subject and signatory of Vietnamese administrative documents, from their first and last lines.

All three are expressions over arrays of lines: a scan for the line that decides, and what stands around it.  Lines
count without the marks of headings, lists and emphasis around them; blank ones do not count.  A null array
gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, col, fold_value, folded_lines, let

#: Issuers that are known by name, folded, with the form that is shown.
ISSUERS = {
    "dai tieng noi viet nam": "Đài Tiếng nói Việt Nam",
    "dai truyen hinh viet nam": "Đài Truyền hình Việt Nam",
    "chinh phu": "Chính phủ",
    "thu tuong chinh phu": "Thủ tướng Chính phủ",
    "bo thong tin va truyen thong": "Bộ Thông tin và Truyền thông",
    "bo noi vu": "Bộ Nội vụ",
    "bo tai chinh": "Bộ Tài chính",
    "bo giao duc va dao tao": "Bộ Giáo dục và Đào tạo",
    "bo y te": "Bộ Y tế",
    "bo cong thuong": "Bộ Công Thương",
}
#: What the names of other issuers begin with, and what lines that name none begin with, folded.
ORGANISATIONS = (
    "bo", "tong cuc", "cuc", "uy ban nhan dan", "ubnd", "hoi dong nhan dan", "hdnd", "hoc vien", "truong dai hoc",
    "vien", "tap doan", "tong cong ty", "cong ty", "so", "ban",
)
NO_ISSUER = ("cong hoa", "doc lap", "quyet dinh", "chi thi", "quy che", "thong bao")
#: Where the search for a subject ends, folded.
SUBJECT_ENDS = ("can cu", "theo de nghi", "xet de nghi", "xet tinh hinh", "dieu 1", "quyet dinh :", "quyet dinh:", "noi nhan")
#: Offices with those of their deputies, in the order in which they are looked for.
OFFICES = (
    ("Tổng Giám đốc", "Phó Tổng Giám đốc"),
    ("Giám đốc", "Phó Giám đốc"),
    ("Chủ tịch", "Phó Chủ tịch"),
    ("Bộ trưởng", "Thứ trưởng"),
    ("Hiệu trưởng", "Phó Hiệu trưởng"),
    ("Trưởng ban", "Phó Trưởng ban"),
    ("Trưởng phòng", "Phó Trưởng phòng"),
    ("Chánh Văn phòng", "Phó Chánh Văn phòng"),
    ("Viện trưởng", "Phó Viện trưởng"),
)
#: Words that no person's name has, in small letters, and lines between an office and a name, folded.
NO_NAME = ("nơi", "nhận", "lưu", "vt", "r&d", "khtc", "tccb", "tổ", "chức", "cộng", "hòa", "xã", "hội", "chủ", "nghĩa")
SIGNED = r"^\(?(?:da ky|da ki|ky ten|chu ky|ky, dong dau|ky, ghi ro ho ten)\)?$"
#: lines that are looked at for an issuer
ISSUER_LINES = 15
#: characters of type names before a subject
LONGEST_TYPE = 40
CONTINUED = 2


def bare_lines(lines: C) -> Column:
    """Lines without marks around them, none of them blank."""
    return F.filter(F.transform(col(lines), lambda x: F.regexp_replace(x, r"(?U)^[\s#*_+•()<>-]+|[\s#*_+•()<>/-]+$", "")), lambda x: x != "")


def _place(lines: Column, holds) -> Column:
    """The place (from 1) of the first line for which holds(line, place from 0), else null."""
    return F.nullif(F.array_position(F.transform(lines, lambda x, i: F.coalesce(holds(x, i), F.lit(False))), True), F.lit(0))


def _is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def _capitalised(c: Column) -> Column:
    return F.initcap(F.lower(F.regexp_replace(c, r"(?U)\s+", " ")))


def _begins(words: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(words) + r")\b"


def issuer(lines: C) -> Column:
    """The known name, or the organisation, of the first of the first lines that has one."""
    known = "|".join(sorted(ISSUERS, key=len, reverse=True))
    shown = F.create_map(*(F.lit(x) for pair in ISSUERS.items() for x in pair))
    after_name = "(?:" + "|".join(sorted(ORGANISATIONS, key=len, reverse=True)) + r")\s+[a-z][a-z0-9 –-]{2,59}"
    organisation = rf"\b{after_name}"

    def of(line: Column, t: Column) -> Column:
        name, start = F.regexp_extract(t, rf"\b({known})\b", 1), F.regexp_extract(t, rf"^(.*?){organisation}", 1)
        # folding keeps letters one by one in these lines, so that the place in the folded line is that in the line
        tidy = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
        own = F.substring(tidy, F.length(start) + 1, F.length(F.regexp_extract(t, organisation, 0)))
        return F.when(name != "", F.try_element_at(shown, name)).otherwise(_capitalised(F.trim(own)))

    def decided(x: Column) -> Column:
        def with_folded(folded: Column) -> Column:
            at = _place(folded, lambda t, _: t.rlike(rf"\b(?:(?:{known})\b|{after_name})") & ~t.rlike(_begins(NO_ISSUER))).cast("int")
            return let(at, lambda a: F.when(a > 0, of(F.get(x, a - 1), F.get(folded, a - 1))))

        return let(folded_lines(x), with_folded)

    return let(F.slice(bare_lines(lines), 1, ISSUER_LINES), decided)


def subject(lines: C) -> Column:
    """`Về việc ...`: the line that begins so, or goes on so behind a type's name in capitals, above the legal basis.

    The words themselves may be in small letters right under a line in capitals.  Up to two lines that begin with a small
    letter go on with it.
    """
    ends = _begins(SUBJECT_ENDS).removesuffix(r"\b")
    named, small = r"(?U)^(.*?)(?<!\w)(?:V/v|Về|VỀ)[\s.:]+(.+)$", r"(?U)^(?:v/v|về)[\s.:]+(.+)$"

    def decided(x: Column) -> Column:
        def opens(line: Column, i: Column) -> Column:
            before = F.btrim(F.regexp_extract(line, named, 1), F.lit(" :"))
            # few lines have the words at all, which is cheaper to see than the pattern
            behind_type = (F.contains(line, F.lit("V/v")) | F.contains(line, F.lit("Về")) | F.contains(line, F.lit("VỀ"))) & line.rlike(named)
            behind_type = behind_type & let(before, lambda b: (b == "") | ((F.length(b) <= LONGEST_TYPE) & _is_upper(b)))
            under_type = (line.startswith("v/v") | line.startswith("về")) & line.rlike(small) & (i > 0) & _is_upper(F.get(x, i - 1))
            return behind_type | under_type

        def with_folded(folded: Column) -> Column:
            def with_place(at: Column) -> Column:
                line = F.get(x, at - 1)
                rest = F.when(line.rlike(small), F.regexp_extract(line, small, 1)).otherwise(F.regexp_extract(line, named, 2))
                more = F.transform(F.sequence(at, at + (CONTINUED - 1)), lambda n: F.struct(F.get(x, n).alias("n"), (F.substring(F.get(x, n), 1, 1).rlike(r"(?U)^\p{Ll}") & ~F.get(folded, n).rlike(ends)).alias("on")))

                def joined(m: Column) -> Column:
                    first, second = F.get(m, F.lit(0)), F.get(m, F.lit(1))
                    parts = F.concat(rest, F.when(first["on"], F.concat(F.lit(" "), first["n"], F.when(second["on"], F.concat(F.lit(" "), second["n"])).otherwise(""))).otherwise(""))
                    return F.btrim(F.regexp_replace(parts, r"(?U)\s+", " "), F.lit(" ,.;"))

                clean = let(more, joined)
                return F.when(at > 0, let(clean, lambda c: F.when(c != "", F.concat(F.when(F.lower(c).startswith("việc"), "Về ").otherwise("Về việc "), c))))

            end = F.coalesce(_place(folded, lambda t, _: t.rlike(ends)), F.size(x) + 1)
            return let(_place(F.slice(x, F.lit(1), (end - 1).cast("int")), opens).cast("int"), with_place)

        return let(folded_lines(x), with_folded)

    return let(bare_lines(lines), decided)


def _role(folded: Column) -> Column:
    """The office that a folded line names: by proxy (KT.) or as a deputy it is the deputy's."""
    out = F
    for head, deputy in OFFICES:
        out = out.when(folded.rlike(rf"\b(?:kt[./]|k/t|ky thay)\s*(?:{fold_value(deputy)}|{fold_value(head)})\b"), deputy)
    for _, deputy in OFFICES:
        out = out.when(folded.rlike(rf"\b{fold_value(deputy)}\b"), deputy)
    for head, _ in OFFICES:
        out = out.when(folded.rlike(rf"\b{fold_value(head)}\b"), head)
    return out


def signatory(lines: C) -> Column:
    """struct(name, role): the office of the last line that names one, and the first name of two to five words behind it."""
    offices = "|".join(fold_value(o) for o in sorted((o for pair in OFFICES for o in pair), key=len, reverse=True))
    any_office = rf"\b(?:(?:kt[./]|k/t|ky thay)\s*)?(?:{offices})\b"

    def decided(x: Column) -> Column:
        def with_folded(folded: Column) -> Column:
            back = F.array_position(F.transform(F.reverse(folded), lambda t: t.rlike(any_office)), True).cast("int")

            def with_place(at: Column) -> Column:
                behind = (F.slice(lines, at + 1, F.greatest(F.size(x), F.lit(1))) for lines in (x, folded))
                behind = F.zip_with(*behind, lambda line, t: F.struct(line.alias("line"), t.alias("folded")))

                def is_name(y: Column) -> Column:
                    letters = y["line"].rlike(r"(?U)^[\p{L}\s]+$")
                    fine = let(F.split(F.lower(y["line"]), r"\s+"), lambda w: F.size(w).between(2, 5) & ~F.arrays_overlap(w, F.array(*map(F.lit, NO_NAME))))
                    return letters & fine & ~y["folded"].rlike(SIGNED)

                name = F.get(F.filter(behind, is_name), F.lit(0))["line"]
                return F.when(at <= F.size(x), F.struct(_capitalised(name).alias("name"), _role(F.get(folded, at - 1)).alias("role")))

            return let(F.size(x) - back + 1, with_place)

        return let(folded_lines(x), with_folded)

    return let(bare_lines(lines), decided)
