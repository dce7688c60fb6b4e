"""Control places and images by bytes, which no star schema holds."""

from examloom.operators import compose
from pyspark.sql import functions as F


def test_control_places(spark):
    df = spark.createDataFrame([(1, "ab", [8, 17]), (2, "a\tb", [0, 1, 25]), (3, "", []), (4, "𝄞a", [0, 10])], "para_id int, text string, char_offsets array<bigint>")
    got = sorted(tuple(r) for r in compose.control_places(df).collect())
    assert got == [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 1, 2), (4, 0, 1)]


def test_native_images(spark):
    rows = [(b"\x89PNG\r\n\x1a\nxx", "png"), (b"BMxx", "bmp"), (b"\xff\xd8\xff\xe0", "jpg"), (b"GIF89a", "gif"), (b"\x28\0\0\0xxxx", "dib"), (b"zz", None), (None, None)]
    df = spark.createDataFrame(rows, "d binary, k string")
    assert df.filter(~compose.native_image(F.col("d")).eqNullSafe(F.col("k"))).count() == 0
