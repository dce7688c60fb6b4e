"""Text rules of exam papers as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------
#: Unicode White_Space, as a Java character class body.
SPACE = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Control marks that never belong to a text: tab and line ends are among them.
CONTROL = r"[\x02-\x0d\x10-\x18]"
CHOICES = "①②③④⑤"
KOREAN_MARKERS = ("국어 영역", "다음 글을 읽고", "다음 글을 읽고 물음에 답하시오", "윗글", "보기의 ⓐ")
KOREAN_COMPACT = ("국어영역", "다음글을읽고")
SOCIAL_MARKERS = ("사회문제", "개인과사회", "문화", "가치함축", "사회현상", "당위법칙")
REVIEW_MARKERS = ("주세요", "연구진", "출제진", "수정 사항")
FOUR_POINTS = "[4점]"
TILDES = "~～∼∽"
WRAPS = {"Square": "square", "Tight": "tight", "Through": "through", "TopAndBottom": "top_and_bottom", "BehindText": "behind_text", "InFrontOfText": "in_front_of_text"}
FIELD_TYPES = {
    "Unknown": "unknown", "Date": "date", "DocDate": "docdate", "Path": "path", "Bookmark": "bookmark", "MailMerge": "mailmerge", "CrossRef": "crossref", "Formula": "formula",
    "ClickHere": "clickhere", "Summary": "summary", "UserInfo": "userinfo", "Hyperlink": "hyperlink", "Memo": "memo", "PrivateInfoSecurity": "privateinfo", "TableOfContents": "toc",
}
HANGUL_DIGITS = "가나다라마바사아자차카타파하"
JAMO_DIGITS = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
IMAGE_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "bmp": "image/bmp", "gif": "image/gif"}
# --------------------------------------------------------------------------------------------

U32 = 4294967295


def lookup(value: Column, table: dict[str, str], other: Column | None = None) -> Column:
    """The table's value for ``value``; a literal map, so no join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    got = F.element_at(F.create_map(*pairs), value)
    return got if other is None else F.coalesce(got, other)


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def trim_space(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]", "")


def is_blank(text: Column) -> Column:
    return trim_space(text) == ""


def _u32(digits: Column) -> Column:
    n = F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")
    return F.when(n <= U32, n.cast("long"))


def question_number(text: Column) -> Column:
    """N of a leading ``N.`` that no digit follows; null if there is none or it passes 32 bits."""
    return _u32(F.regexp_extract(text, f"^[{SPACE}]*([0-9]+)[{SPACE}]*\\.(?![0-9])", 1))


SET_HEADER = (
    f"\\[[{SPACE}]*([0-9]+)[{SPACE}]*[{TILDES}][{SPACE}]*([0-9]+)[{SPACE}]*\\]"
)


def set_from(text: Column) -> Column:
    return _u32(F.regexp_extract(text, SET_HEADER, 1))


def set_to(text: Column) -> Column:
    return _u32(F.regexp_extract(text, SET_HEADER, 2))


def is_set_header(text: Column) -> Column:
    return set_from(text).isNotNull() & set_to(text).isNotNull()


def is_choice(text: Column) -> Column:
    return trim_space(text).rlike(f"^[{CHOICES}]")


def classify(text: Column, korean: Column) -> Column:
    """empty, set_header (Korean papers only), balmun, seonji or other."""
    return (
        F.when(is_blank(text), "empty").when(korean & is_set_header(text), "set_header").when(question_number(text).isNotNull(), "balmun").when(is_choice(text), "seonji").otherwise("other")
    )


def line_marker(text: Column) -> Column:
    """Set header first, else question number, as text; null for neither."""
    pair = F.format_string("set:%d-%d", set_from(text), set_to(text))
    return F.when(is_set_header(text), pair).when(question_number(text).isNotNull(), F.format_string("question:%d", question_number(text)))


def is_review_request(text: Column) -> Column:
    got = F.lit(False)
    for m in REVIEW_MARKERS:
        got = got | text.contains(m)
    return got


def contains_hangul_or_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z가-힣]")


def subject(text: Column) -> Column:
    """korean, science, math, social or null, in this order of precedence."""
    c = compact(text)

    def any_of(t: Column, marks) -> Column:
        got = F.lit(False)
        for m in marks:
            got = got | t.contains(m)
        return got

    social = sum((c.contains(m).cast("int") for m in SOCIAL_MARKERS), F.lit(0))
    return (
        F.when(any_of(text, KOREAN_MARKERS) | any_of(c, KOREAN_COMPACT), "korean")
        .when(any_of(c, ("과학탐구", "통합과학")), "science")
        .when(c.contains("수학영역") | (c.contains("5지선다형") & c.contains("단답형")), "math")
        .when(c.contains("사회탐구") | (social >= 2), "social")
    )


def number_prefix_length(text: Column) -> Column:
    """Characters of a leading ``N.`` with the blanks around it; null without one."""
    got = F.regexp_extract(text, f"^[{SPACE}]*[0-9]+[{SPACE}]*\\.[{SPACE}]*", 0)
    return F.when(got != "", F.length(got))


def utf16_width(char: Column) -> Column:
    """Units a character takes among offsets: tab 8, beyond the basic plane 2, else 1."""
    return F.when(char == "\t", 8).when(F.octet_length(char) == 4, 2).otherwise(1)


def utf16_length(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda n, c: n + utf16_width(c))


def script_of(char: Column) -> Column:
    """Script of a character by code point: hangul, hanja, japanese, latin or symbol."""
    return (
        F.when(char.rlike("^[\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F]"), "hangul")
        .when(char.rlike("^[\\u4E00-\\u9FFF\\u3400-\\u4DBF\\x{20000}-\\x{2A6DF}]"), "hanja")
        .when(char.rlike("^[\\u3040-\\u30FF\\u31F0-\\u31FF]"), "japanese")
        .when(char.rlike("^[\\u0020-\\u024F]"), "latin")
        .otherwise("symbol")
    )


def bin_name(bin_id: Column, ext: Column) -> Column:
    return F.format_string("BIN%04X.%s", bin_id, ext)


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def roman_small(n: Column) -> Column:
    """Lower-case Roman numeral, digit by decimal digit."""
    ones = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]

    def place(power: int, one: str, five: str, ten: str) -> Column:
        digits = [d.replace("x", "T").replace("v", "F").replace("i", "O").replace("T", ten).replace("F", five).replace("O", one) for d in ones]
        return F.element_at(F.array(*map(F.lit, digits)), (F.floor(n / power) % 10 + 1).cast("int"))

    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place(100, "c", "d", "m"), place(10, "x", "l", "c"), place(1, "i", "v", "x"))


def format_number(n: Column, code: Column) -> Column:
    """A list number: 1 circled (to 20), 3 Roman, 8 Hangul, 9 circled Hangul (to 14), 10 jamo; decimal otherwise."""
    turn = (F.greatest(n, F.lit(1)) - 1) % 14
    hangul = F.substring(F.lit(HANGUL_DIGITS), (turn + 1).cast("int"), F.lit(1))
    jamo = F.substring(F.lit(JAMO_DIGITS), (turn + 1).cast("int"), F.lit(1))
    circled = F.substring(F.lit("".join(chr(0x2460 + i) for i in range(20))), n.cast("int"), F.lit(1))
    circled_hangul = F.substring(F.lit("".join(chr(0x326E + i) for i in range(14))), n.cast("int"), F.lit(1))
    return (
        F.when((code == 1) & n.between(1, 20), circled)
        .when(code == 3, roman_small(n))
        .when(code == 8, hangul)
        .when((code == 9) & n.between(1, 14), circled_hangul)
        .when(code == 10, jamo)
        .otherwise(n.cast("string"))
    )


def mm_to_units(mm: Column) -> Column:
    """Millimetres to 1/7200 inch."""
    return F.round(mm * 7200 / 25.4).cast("int")


def rescaled_equation_width(width: Column) -> Column:
    return F.floor((width * 89932 + 50000) / 100000).cast("long")


def file_type(path: Column) -> Column:
    """hwp or hwpx by extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("hwp", "hwpx"), ext)


def file_format(content: Column) -> Column:
    """hwp (compound file), hwpx (ZIP), hwp3 or unknown by leading bytes."""
    head = F.hex(F.substring(content, 1, 17))
    size = F.octet_length(content)
    return (
        F.when((size >= 8) & head.startswith("D0CF11E0"), "hwp").when((size >= 8) & head.startswith("504B0304"), "hwpx").when((size >= 17) & head.startswith("48575020446F63756D656E742046696C65"), "hwp3").otherwise("unknown")
    )


def wide_value(command: Column, key: str) -> Column:
    """Value of ``key`` in a field command: after ``wstring:n:`` up to the next key, trimmed; null if empty."""
    rest = F.substring(command, F.instr(command, key) + len(key), F.lit(1 << 30))
    value = F.regexp_extract(rest, r"(?s)^.*?wstring:[^:]*:(.*)$", 1)
    cut = value
    for stop in (" Name:", " Direction:", " HelpState:"):  # the first that occurs in this order ends it
        cut = F.when(value.contains(stop), F.substring_index(value, stop, 1)).otherwise(cut)
    return F.when(command.contains(key), F.nullif(trim_space(cut), F.lit("")))


def guide_text(kind: Column, command: Column) -> Column:
    return F.when(kind == "ClickHere", wide_value(command, "Direction:"))


def memo_text(kind: Column, command: Column) -> Column:
    return F.when(kind == "ClickHere", wide_value(command, "HelpState:"))


def field_name(kind: Column, command: Column, data_name: Column) -> Column:
    return F.when(kind == "ClickHere", F.coalesce(F.nullif(data_name, F.lit("")), wide_value(command, "Name:"), wide_value(command, "Direction:")))


def clickhere_command(guide: Column, memo: Column, name: Column) -> Column:
    inner = F.concat(
        F.format_string("Direction:wstring:%d:%s HelpState:wstring:%d:%s ", F.length(guide), guide, F.length(memo), memo),
        F.when(name != "", F.format_string("Name:wstring:%d:%s ", F.length(name), name)).otherwise(""),
    )
    return F.concat(F.format_string("Clickhere:set:%d:", F.length(inner)), inner)


def memo_number(command: Column) -> Column:
    """The third part of a command cut at slashes, as a 32-bit number."""
    return _u32(F.regexp_extract(command, r"^[^/]*/[^/]*/([0-9]+)(?:/|$)", 1))


def data_uri(data: Column, ext: Column) -> Column:
    return F.concat(F.lit("data:"), lookup(F.lower(ext), IMAGE_MIME, F.lit("application/octet-stream")), F.lit(";base64,"), F.base64(data))
