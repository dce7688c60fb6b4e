"""The entry points, paper splitting, and edits."""

import pytest
from examloom import api
from examloom.operators import edit, layout, ordered
from examloom.plans import preview
from examloom.sources import papers, sink
from pyspark.sql import functions as F

from ..sources import make


def test_arguments():
    assert api.parse_file_type(" HWPX ") == "hwpx" and api.infer_file_type_from_path("/a/b.HWP") == "hwp"
    assert api.parse_preview_type("Question") == "question" and api.parse_media_type("SVG") == "svg"
    for f, bad in ((api.parse_file_type, "doc"), (api.infer_file_type_from_path, "x"), (api.parse_preview_type, ""), (api.parse_media_type, "gif")):
        with pytest.raises(ValueError):
            f(bad)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("checkpoints")))
    folder = tmp_path_factory.mktemp("in")
    (folder / "exam.hwpx").write_bytes(sink.package(make.paper()))
    api.import_files(spark, f"file://{folder}").write.parquet(f"file://{folder}/parsed")
    return spark.read.parquet(f"file://{folder}/parsed")


def test_questions_as_papers(spark, loaded, tmp_path):
    rows = api.split_set_to_question(loaded).orderBy("path").collect()
    assert [r.path.rpartition("/")[2] for r in rows] == ["exam_q01", "exam_q02"] and [r.label for r in rows] == ["Q01", "Q02"]
    assert [len(r.bin_data) for r in rows] == [0, 1]
    done = api.save_files(api.split_set_to_question(loaded).drop("label"), f"file://{tmp_path}/out").collect()
    assert all(d.error is None for d in done)
    back = papers.read_papers(spark, f"file://{tmp_path}/out").collect()
    texts = sorted("".join(p.text for p in r.paragraphs) for r in back)
    assert texts == ["1. 값은  인가?\t[2점]① 하나 ② 둘", "2. 표를 보라.칸 A칸 B끝 <&> 𝄞 쪽각주"]
    with pytest.raises(NotImplementedError):
        api.save_files(loaded, "file:///x", "hwp")


def test_previews_and_fonts(spark, loaded, tmp_path):
    done = api.export_preview(loaded, f"file://{tmp_path}/p").collect()
    assert len(done) == 1 and done[0].path.endswith("_p01.svg")
    with open(done[0].path) as f:
        assert f.read().startswith("<svg") and not api.is_corrupt(loaded).first()["is_corrupt"]
    things = {(r.page, r.text): (r.x, r.y) for r in preview.question_things(loaded).collect()}
    first = next(y for (page, text), (_, y) in things.items() if page == 0 and text.startswith("1."))
    assert {p for p, _ in things} == {0, 1} and first == preview.MARGIN and not any("고쳐" in t for _, t in things)
    done = api.export_preview(loaded, f"file://{tmp_path}/q", "question").collect()
    assert sorted(d.path[-8:] for d in done) == ["_q01.svg", "_q02.svg"]
    manifest = spark.createDataFrame([("Arial", "a.ttf")], "face string, file string")
    missing = api.prepare_fonts(loaded, manifest, manifest.select("file").limit(0)).collect()
    assert sorted(tuple(r) for r in missing) == [("Arial", "a.ttf"), ("함초롬바탕", "(미등록)")]
    with pytest.raises(NotImplementedError):
        api.export_preview(loaded, "x", media="png")


def test_lines_have_their_share_of_the_text(spark, loaded):
    segs = [make.LINE | {"text_start": s, "vertical_pos": y} for s, y in ((0, 0), (3, 10), (12, 20))]
    text = "가나다\t라마바"  # the tab takes eight units, so the third line starts behind the first letter after it
    row = make.paper()
    row["paragraphs"][2] |= {"line_segs": segs, "text": text, "char_offsets": [0, 1, 2, 3, 11, 12, 13], "items": [{"kind": "text", "text": text, "ctrl_node": None}]}
    df = spark.createDataFrame([{k: row.get(k) for k in loaded.columns}], loaded.schema)
    got = preview.body_lines(df).filter(f"node_id = {row['paragraphs'][2]['node_id']}").orderBy("place").collect()
    assert [(r.text, r.seg.vertical_pos) for r in got] == [("가나다", 0), ("\t라", 10), ("마바", 20)]


def test_crops_stack_columns_and_keep_sets_by_page(spark):
    rows = [
        ("d", 1, "Q01", 0, 0, 0, "text", 100, 5000, 50, 10, "a"), ("d", 1, "Q01", 0, 0, 1, "text", 110, 5030, 50, 20, "b"), ("d", 1, "Q01", 0, 1, 2, "text", 900, 7, 50, 10, "c"),
        ("d", 2, "S02-03", 0, 1, 3, "text", 900, 30, 50, 10, "e"), ("d", 2, "S02-03", 1, 0, 4, "text", 100, 0, 50, 10, "f"), ("d", 2, "S02-03", 1, 1, 5, "text", 900, 4, 50, 10, "g"),
    ]
    ops = spark.createDataFrame(rows, "doc_id string, unit_no long, label string, page long, column long, seq long, kind string, x long, y long, w long, h long, text string")
    m = preview.MARGIN
    got = {r.text: (r.page, r.x - m, r.y - m) for r in preview.crops(ops).collect()}
    assert got == {"a": (0, 0, 0), "b": (0, 10, 30), "c": (0, 0, 50), "e": (1, 0, 0), "f": (2, 0, 0), "g": (2, 800, 4)}


RUNS = "array<struct<start_pos:bigint,char_shape_id:bigint>>"


def one(df):
    r = df.collect()
    return [(x.text, x.char_offsets, [(c.start_pos, c.char_shape_id) for c in x.char_shapes]) for x in r]


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([("a\tb𝄞c", [0, 1, 9, 10, 12], [(0, 1), (9, 2), (12, 3)])], f"text string, char_offsets array<bigint>, char_shapes {RUNS}")


def test_paragraph_edits(line):
    assert one(edit.insert_text(line, F.lit(2), F.lit("x\t"))) == [("a\tx\tb𝄞c", [0, 1, 9, 10, 18, 19, 21], [(0, 1), (18, 2), (21, 3)])]
    assert one(edit.delete_text(line, F.lit(1), F.lit(2))) == [("a𝄞c", [0, 1, 3], [(0, 1), (1, 2), (3, 3)])]
    assert one(edit.split_at(line, F.lit(3)).orderBy("half")) == [("a\tb", [0, 1, 9], [(0, 1), (9, 2)]), ("𝄞c", [0, 2], [(0, 2), (2, 3)])]
    assert one(edit.style_range(line, F.lit(1), F.lit(3), F.lit(7))) == [("a\tb𝄞c", [0, 1, 9, 10, 12], [(0, 1), (1, 7), (10, 2), (12, 3)])]
    assert one(edit.style_range(line, F.lit(0), F.lit(5), F.lit(7))) == [("a\tb𝄞c", [0, 1, 9, 10, 12], [(0, 7)])]


def test_merged_paragraphs(line):
    other = F.lit("d𝄞"), F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    runs = F.array(*(F.struct(F.lit(a).cast("long").alias("start_pos"), F.lit(b).cast("long").alias("char_shape_id")) for a, b in ((0, 4), (0, 4), (1, 3))))
    assert one(edit.merge(line, *other, runs)) == [("a\tb𝄞cd𝄞", [0, 1, 9, 10, 12, 13, 14], [(0, 1), (9, 2), (12, 3), (13, 4), (14, 3)])]
    assert one(edit.merge(line, F.lit(""), F.expr("cast(array() as array<bigint>)"), runs)) == one(line)


def test_sections_set_auto_numbers(spark):
    rows = [(1, 1, "auto_number", "table", None), (1, 3, "auto_number", "table", None), (1, 4, "auto_number", "page", None), (1, 5, "new_number", "table", 9), (1, 6, "auto_number", "table", None)]
    controls = spark.createDataFrame(rows, "doc_id int, node_id int, kind string, number_type string, new_number int")
    starts = spark.createDataFrame([(1, 2, "table", 5), (1, 2, "page", 0)], "doc_id int, node_id int, number_type string, new_number int")
    assert [r.assigned for r in ordered.auto_numbers(controls, starts).orderBy("node_id").collect()] == [1, 5, 1, 9]
    assert [r.assigned for r in ordered.auto_numbers(controls).orderBy("node_id").collect()] == [1, 2, 1, 9]


def test_table_edits(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 2, "A"), (1, 0, 2, 1, 1, "B")], "table_id int, cell_row long, cell_col long, row_span long, col_span long, text string")
    got = sorted(tuple(r)[1:] for r in edit.split_cell(cells, 0, 0, 2, 2).collect())
    assert got == [(0, 0, 1, 1, "A"), (0, 1, 1, 1, ""), (0, 2, 1, 1, "B"), (1, 0, 1, 1, ""), (1, 1, 1, 1, "")]
    assert edit.transposed(edit.transposed(cells)).collect() == cells.collect()


def test_lines_boxes_and_columns(spark):
    lines = spark.createDataFrame([(1, "justify", 100.0, 80.0, 4, 9, False), (2, "justify", 100.0, 80.0, 4, 9, True), (3, "center", 100.0, 80.0, 4, 9, True), (4, "distribute", 100.0, 80.0, 4, 11, True), (5, "right", 50.0, 80.0, 4, 9, True)], "line_id int, align string, width double, used double, blanks int, cells int, is_last boolean")
    assert [tuple(r) for r in layout.line_fill(lines).orderBy("line_id").collect()] == [(1, 0.0, 5.0), (2, 0.0, 0.0), (3, 10.0, 0.0), (4, 0.0, 2.0), (5, 0.0, 0.0)]
    cols = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 10)], "section_id int, column long, x long, width long")
    ops = spark.createDataFrame([(1, 1, 5), (2, 1, 18), (3, 1, 99), (4, 1, 11)], "op_id int, section_id int, x long")
    assert [r["column"] for r in layout.column_of(ops, cols).orderBy("op_id").collect()] == [0, 1, 1, 0]
