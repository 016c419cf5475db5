from pyspark.sql import functions as F

from tracewell.operators import documents as D
from tracewell.operators import segments as G
from tracewell.plans.lineage import written
from tracewell.queries import checking
from tracewell.sources import parsers as P

BLOCKS = "doc_id bigint, page int, pos int, block_type string, text string, y0 double, y1 double"


def _blocks(spark, rows):
    frame = spark.createDataFrame(rows, BLOCKS)
    return frame.withColumn("box", F.struct(F.lit(0.0).alias("x0"), "y0", F.lit(9.0).alias("x1"), "y1"))


def _row(n, beside=False):
    return f"{n}\nname {n}\nkind\nmore\ntext" + ("" if beside else f"\nAB-{n}")


def test_logical_tables(spark):
    head, columns = "Group — one", "No\nName\nKind\nText\nCode"
    rows = [(1, 0, 0, "page_header", "h"), (1, 0, 1, "caption", "Table 9-1. Rules"), (1, 0, 2, "table", head), (1, 0, 3, "table", columns), (1, 0, 4, "table", _row(1)), (1, 0, 5, "table", _row(2, True)), (1, 0, 6, "text", "AB-2"), (1, 0, 7, "table", _row(3))]
    rows += [(1, 1, 8, "page_header", "h"), (1, 1, 9, "table", "group -  ONE"), (1, 1, 10, "table", columns), (1, 1, 11, "table", _row(4)), (1, 1, 12, "text", "prose")]
    rows += [(2, 0, 0, "caption", "Table 2. Alone"), (2, 0, 1, "table", head), (2, 0, 2, "table", columns), (2, 0, 3, "table", _row(1))]
    rows += [(3, 0, 0, "caption", "Table 3. Gap"), (3, 0, 1, "table", head), (3, 0, 2, "table", columns), (3, 0, 3, "table", _row(1)), (3, 1, 4, "table", head), (3, 1, 5, "table", columns), (3, 1, 6, "table", _row(5))]
    heights = {(1, 6): 5}
    frame = _blocks(spark, [(*r, 10.0 * heights.get((r[0], r[2]), r[2]), 10.0 * heights.get((r[0], r[2]), r[2]) + 8) for r in rows])
    cells = D.logical_tables(frame).orderBy("row_no", "col_no").collect()
    assert {c.doc_id for c in cells} == {1} and len(cells) == 20
    assert [(c.row_no, c.part, c.cell_text) for c in cells if c.column_name == "Code"] == [(1, 1, "AB-1"), (2, 1, "AB-2"), (3, 1, "AB-3"), (4, 2, "AB-4")]
    assert [c.cell_text for c in cells[:5]] == ["1", "name 1", "kind", "more text", "AB-1"]


def test_logical_tables_read_their_blocks_once(spark):
    group, columns = "Group", "1\nName\nKind\nText\nAB-1"  # the line of columns is a row too
    rows = [(1, 0, 0, "caption", "Table 1. One"), (1, 0, 1, "table", group), (1, 0, 2, "table", columns), (1, 0, 3, "table", _row(2)), (1, 0, 4, "text", "prose"), (1, 0, 5, "table", _row(9)), (1, 1, 6, "table", group), (1, 1, 7, "table", columns), (1, 1, 8, "table", _row(3))]
    made = D.logical_tables(_blocks(spark, [(*r, 10.0 * r[2], 10.0 * r[2] + 8) for r in rows]))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.row_no, r.part, r.page, r.number) for r in made.where("col_no = 0").orderBy("row_no").collect()] == [(2, 1, 0, "1"), (3, 2, 1, "1")]


def test_rows_of_tables_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(checking, "_RULED_ROWS", 300)
    made = checking.table_rows(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= 20


def test_parser_links(spark):
    blocks = _blocks(spark, [(1, 0, 0, "paragraph", "see Rules and http://x.org", 0.0, 9.0), (1, 0, 1, "paragraph", "other", 20.0, 29.0)])
    links = spark.createDataFrame([(1, 0, "a", "http://x.org", None, 1.0), (1, 0, "b", None, 3, 1.0), (1, 0, "c", None, 3, 21.0), (1, 0, "d", "http://y.org", None, 90.0)], "doc_id bigint, page int, link_id string, target_text string, target_page int, y double")
    links = links.withColumn("box", F.struct(F.lit(0.0).alias("x0"), F.col("y").alias("y0"), F.lit(5.0).alias("x1"), (F.col("y") + 2).alias("y1")))
    sections = spark.createDataFrame([(1, "s3", 3, "Rules")], "doc_id bigint, section_id string, page int, title string")
    got = {r.link_id: (r.target_id, r.status) for r in D.parser_links(links, blocks, sections).collect()}
    assert got == {"a": ("http://x.org", "observed"), "b": ("s3", "observed"), "c": (None, "unresolved"), "d": (None, "unresolved")}


def test_build(spark):
    lines = ["Preface text.", "1. First", "Body, see Section 1.1.", "1.1. Inner", "Deep text.", "", "2. Second", "End."]
    blocks = spark.createDataFrame([(7, k, k // 4, t, "text") for k, t in enumerate(lines)], "doc_id bigint, pos int, page int, text string, observed_type string")
    made = D.build(blocks)
    assert {r.section_id: (r.parent_id, r.end_pos) for r in made["sections"].collect()} == {"7:s1": (None, 5), "7:s3": ("7:s1", 5), "7:s6": (None, 7)}
    owners = {r.pos: r.division_id for r in made["nodes"].collect()}
    assert owners == {0: "7:document", 1: "7:s1", 2: "7:s1", 3: "7:s3", 4: "7:s3", 6: "7:s6", 7: "7:s6"}
    (relation,) = made["relations"].collect()
    assert (relation.source_pos, relation.target_id, relation.gold_eligible) == (2, "7:s3", True)
    assert {r.pos: r.status for r in made["continuation"].collect()} == {1: "deterministic_true", 3: "deterministic_true", 6: None}
    nodes = made["nodes"].withColumn("node_kind", F.when(F.col("node_kind") == "heading", "heading").otherwise("paragraph"))
    views = G.parent_child(nodes, made["divisions"])
    first = G.reconstruct(views.where("role = 'return'"), nodes).orderBy("segment_id").first().text
    assert first == "\n".join(t for t in lines if t)
    assert G.violations(views.where("role = 'retrieval'"), nodes).count() == 0


def test_tables_are_made_when_asked_for_and_nodes_need_no_join(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(D, "written", lambda df, label: labels.append(label) or written(df, label))
    rows = [(7, k, 0, t, "text") for k, t in enumerate(["\u2003See  Travel Policy, Version 2.1 \x1c", "1. First\u3000", "Body"])]
    made = D.build(spark.createDataFrame(rows, "doc_id bigint, pos int, page int, text string, observed_type string"))
    assert [r.literal for r in made["unresolved"].collect()] == ["See Travel Policy, Version 2.1"]
    assert made["descriptors"].first().blocks == 3 and labels == ["blocks"]
    nodes = made["graph_nodes"]
    assert {(r.sequence_number, r.division_id) for r in nodes.collect()} == {(0, "7:document"), (1, "7:s1"), (2, "7:s1")} and labels == ["blocks"]
    assert "Join" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert made["sections"].first().title == "First" and labels == ["blocks", "sections"]


def test_parsers(spark):
    files = spark.createDataFrame([("a", bytearray("one\ftwo".encode())), ("b", bytearray(b"\xff\xfe\xfa"))], "path string, content binary")
    got = P.route(files, "fixed", ("text",)).orderBy("path", "page").collect()
    assert [(r.path, r.page, r.text) for r in got] == [("a", 0, "one"), ("a", 1, "two"), ("b", None, None)] and "UnicodeDecodeError" in got[2].error
    own = {**P.PARSERS, "latin": lambda b: [(None, b.decode("latin-1"))]}
    fallback = P.route(files, "fallback", ("text", "latin"), own).collect()
    assert sorted((r.path, r.parser_id) for r in fallback) == [("a", "text"), ("a", "text"), ("b", "latin")]
    assert P.route(files, "compare", ("text", "latin"), own).count() == 4


def test_build_with_images_links_and_bare_pages(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    at = lambda y: (0.0, float(y), 90.0, float(y) + 8.0)
    rows = [(1, 0, 0, "1. Start", "text", at(0), 100.0), (1, 0, 1, "See printed page iv and http://x.org/a.", "text", at(10), 100.0), (1, 0, 2, "Figure 1. A map", "text", at(40), 100.0), (1, 0, 3, "\u2022\none\n\u2022\ntwo", "list", at(60), 100.0), (1, 1, 4, "Ends here. Early.", "text", at(5), 100.0), (1, 2, 5, "2. Next", "text", at(0), 100.0)]
    blocks = spark.createDataFrame(rows, f"doc_id bigint, page int, pos int, text string, observed_type string, box {box}, height double")
    pages = spark.createDataFrame([(1, 0, "x"), (1, 3, "Scanned page."), (1, 4, "  ")], "doc_id bigint, page int, text string")
    images = spark.createDataFrame([(1, 0, 0, at(25))], f"doc_id bigint, page int, pos int, box {box}")
    labels = spark.createDataFrame([(1, "iv", "p4")], "doc_id bigint, label string, page_id string")
    links = spark.createDataFrame([(1, 0, "a", at(11), "http://x.org/a", None), (1, 0, "b", at(41), "http://y.org", None), (1, 0, "c", at(61), None, 9)], f"doc_id bigint, page int, link_id string, box {box}, target_text string, target_page int")
    made = D.build(blocks, pages, images, links, labels)
    order = [(r.page, r.block_type, r.text) for r in made["blocks"].orderBy("pos").collect()]
    assert order == [(0, "heading", "1. Start"), (0, "url", rows[1][3]), (0, "figure", ""), (0, "caption", "Figure 1. A map"), (0, "list_item", "one"), (0, "list_item", "two"), (1, "paragraph", "Ends here."), (1, "paragraph", "Early."), (2, "heading", "2. Next"), (3, "paragraph", "Scanned page.")]
    assert [(r.number, r.title, r.caption_pos) for r in made["figures"].collect()] == [("1", "A map", 3)]
    got = {(r.source_pos, r.relation_type, r.target_id, r.method) for r in made["relations"].collect()}
    assert got == {(1, "references", "p4", "printed_page_label"), (1, "links_to", "http://x.org/a", "deterministic_url"), (3, "links_to", "http://y.org", "parser_link"), (2, "owned_by", "1:s0", "deterministic_exact")}
    assert {(r.pos, r.kind) for r in made["unresolved"].collect()} == {(4, "parser_link")}
    assert {(r.section_id, r.first_page, r.last_page) for r in made["section_pages"].collect()} == {("1:s0", 0, 1), ("1:s8", 2, 3)}
    assert "text" not in made["graph_nodes"].columns + made["graph_edges"].columns


def test_a_parser_runs_once_on_a_file(spark):
    files = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    own = {f"p{k}": P.plain_text for k in range(4)}
    for n in (1, 2, 4):
        plan = P.route(files, "fallback", tuple(own)[:n], own)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 0 and plan.count("Relation") == n + 1
