from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import objects as O
from tracewell.operators import routing as P


def test_figures(spark):
    blocks = spark.createDataFrame([(1, 0, 5, "Figure 3-1. A map of it", 50.0), (1, 0, 6, "Figure 3-2. Another", 90.0), (1, 0, 7, "text", 20.0)], "doc_id bigint, page int, pos int, text string, y double")
    blocks = blocks.withColumn("box", F.struct(F.lit(0.0).alias("x0"), F.col("y").alias("y0"), F.lit(9.0).alias("x1"), (F.col("y") + 5).alias("y1")))
    images = spark.createDataFrame([(1, 0, 100, 10.0), (1, 0, 101, 95.0), (2, 0, 102, 0.0)], "doc_id bigint, page int, pos int, y double")
    images = images.withColumn("box", F.struct(F.lit(0.0).alias("x0"), F.col("y").alias("y0"), F.lit(9.0).alias("x1"), (F.col("y") + 30).alias("y1")))
    got = {r.pos: (r.number, r.title, r.caption_pos) for r in O.figures(blocks, images).collect()}
    assert got == {100: ("3-1", "A map of it", 5), 101: (None, None, None), 102: (None, None, None)}


def test_ownership_and_rollup(spark):
    members = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 2), (1, 6, "c", 1), (1, 6, "d", 1)], "doc_id bigint, block int, section string, level int")
    objects = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (1, "z", 7)], "doc_id bigint, object_id string, pos int")
    assert {r.object_id: (r.target_id, r.status) for r in O.ownership(objects, members).collect()} == {"x": ("b", "resolved"), "y": (None, "unresolved"), "z": (None, "unresolved")}
    rows = [(1, p, 5.0, 8.0, 100.0, f"Report page {p}") for p in range(5)] + [(1, 2, 95.0, 99.0, 100.0, "once")]
    got = O.region_rollup(spark.createDataFrame(rows, "doc_id bigint, page int, y0 double, y1 double, height double, text string")).collect()
    assert [(r.region, r.margin, r.pages, r.region_no) for r in got] == [("page_header", "Report <page-label>", "0,1,2,3,4", 1)]


def test_page_fallback(spark):
    pages = spark.createDataFrame([(1, 0, "has"), (1, 1, "none"), (1, 2, " \n")], "doc_id bigint, page int, text string")
    blocks = spark.createDataFrame([(1, 0)], "doc_id bigint, page int")
    assert [(r.page, r.text) for r in O.page_fallback(pages, blocks).collect()] == [(1, "none")]


def test_small_strings(spark):
    row = spark.createDataFrame([("A b. C d.", "Table 1. X — y — z", "see: http://x.org", "http://x.org", "2024-02-30", "2024-02-29")], "a string, b string, c string, d string, e string, f string")
    got = row.select(T.first_sentence(F.col("a")), T.first_sentence(F.lit("no end")), T.caption_head(F.col("b")), T.visible_link(F.col("c"), F.col("d")), T.visible_link(F.lit("more: here"), F.col("d")), T.is_date(F.col("e")), T.is_date(F.col("f"))).first()
    assert tuple(got) == ("A b.", "no end", "Table 1. X", "http://x.org", "here", False, True)
    order = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), (["a", "b", "c"], ["c", "a"]), (["a"], ["z"])], "w array<string>, c array<string>").select(P.keeps_order(F.col("c"), F.col("w")).alias("k")).collect()
    assert [r.k for r in order] == [True, False, False]
