import random
import re

from tracewell.functions import text as T
from tracewell.operators import references as R
from tracewell.operators import segments as G
from tracewell.operators import structure as S
from pyspark.sql import functions as F

BLOCKS = "doc_id bigint, pos int, text string, observed_type string, split_last boolean"


def test_headings_and_types(spark):
    cases = [("1. Title", "1", 1, "heading"), ("2.3.4. Deep title", "2.3.4", 3, "heading"), (" Appendix C.  Notes ", "C", 1, "heading"), ("\u0663. Title", "\u0663", 1, "heading"), ("A. The end", "A", 1, "heading"), ("1.Title", None, None, "paragraph"), ("Figure 3-1. A map", None, None, "caption"), ("Footnote 2 \u2014 see there", None, None, "footnote"), ("at http://x.org now", None, None, "url"), ("\u2022 item", None, None, "list"), ("NOTE-A1 be careful", None, None, "callout"), ("", None, None, "paragraph"), ("\u00a0\u2022 item", None, None, "list")]
    rows = spark.createDataFrame([(1, k, c[0], "text", False) for k, c in enumerate(cases)], BLOCKS)
    got = {r.pos: (r.number, r.level) for r in S.headings(rows).collect()}
    assert got == {k: (c[1], c[2]) for k, c in enumerate(cases) if c[1]}
    assert [r.block_type for r in S.typed(rows).orderBy("pos").collect()] == [c[3] for c in cases]
    assert S.typed(rows.withColumn("observed_type", F.lit("page_header"))).select("block_type").distinct().count() == 1


def test_fragments(spark):
    table = "\n".join(["Name", "Value", "Unit", "a", "1", "kg", "b", "2", "m", "All values are nominal."])
    cases = ["\u2022\none\n\u2022\ntwo", "\u2022\nonly", "First here. Second there. Third", table, "plain"]
    rows = spark.createDataFrame([(1, k, t, "text", k == 2) for k, t in enumerate(cases)], BLOCKS)
    got = {}
    for r in S.fragments(rows).orderBy("pos", "fragment").collect():
        got.setdefault(r.pos, []).append((r.text, r.block_type))
    assert got[0] == [("one", "list_item"), ("two", "list_item")]
    assert got[1] == [("\u2022\nonly", "list")]
    assert got[2] == [("First here. Second there.", "paragraph"), ("Third", "paragraph")]
    assert got[3] == [("\n".join(table.split("\n")[:9]), "table"), ("All values are nominal.", "paragraph")]
    assert got[4] == [("plain", "paragraph")]


def test_sentence_spans_equal_a_plain_version(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", " ", "  ", ". ", "! ", "?", "\u00e9.\u00a0", "\n"]) for _ in range(25)) for _ in range(60)]
    rows = spark.createDataFrame([(1, k, t, "text", False) for k, t in enumerate(texts)], BLOCKS)
    got = {}
    for r in S.sentence_spans(rows).orderBy("pos", "sentence").collect():
        got.setdefault(r.pos, []).append((r.char_start, r.char_end))
    for k, t in enumerate(texts):
        want, at = [], 0
        for gap in [*re.finditer(r"(?<=[?!.])\s+", t), None]:
            end = gap.start() if gap else len(t)
            bare = t[at:end].lstrip()
            if bare:
                want.append((end - len(bare), end))
            at = gap.end() if gap else at
        assert got.get(k, []) == want


def test_parents_and_spans_equal_a_stack(spark):
    rng = random.Random(2)
    heads = [(d, p, rng.randrange(1, 6 if d % 2 else 15)) for d in range(30) for p in sorted(rng.sample(range(60), 20))]
    rows = spark.createDataFrame(heads, "doc_id bigint, pos int, level int")
    ends = spark.createDataFrame([(d, 60) for d in range(30)], "doc_id bigint, last_pos int")
    parents = {(r.doc_id, r.pos): r.parent_pos for r in S.section_parents(rows).collect()}
    spans = {(r.doc_id, r.pos): r.end_pos for r in S.section_spans(rows, ends).collect()}
    for d in range(30):
        stack, own = [], [h for h in heads if h[0] == d]
        for _, p, level in own:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert parents[d, p] == (stack[-1][0] if stack else None)
            stack.append((p, level))
            assert spans[d, p] == min((q - 1 for _, q, other in own if q > p and other <= level), default=60)


def test_continuation(spark):
    blocks = [(1, 0, 0, 1), (1, 1, 0, None), (1, 2, 0, 2), (1, 3, 1, None), (1, 4, 1, 2), (1, 5, 1, None), (1, 6, 2, 1), (1, 7, 2, None)]
    frame = spark.createDataFrame(blocks, "doc_id bigint, pos int, page int, level int")
    spans = spark.createDataFrame([(1, 0, 1, 5), (1, 2, 2, 3), (1, 4, 2, 5), (1, 6, 1, 7)], "doc_id bigint, pos int, level int, end_pos int")
    got = {r.pos: (r.status, r.continues_from, r.continues_to) for r in S.section_continuation(spans, frame).collect()}
    assert got == {0: ("deterministic_true", 2, 3), 2: ("deterministic_true", 2, 3), 4: ("deterministic_false", None, None), 6: (None, None, None)}


def test_packing_equals_a_plain_version(spark):
    rng = random.Random(3)
    docs = [[rng.randrange(1, 20) for _ in range(rng.randrange(1, 25))] for _ in range(80)]
    rows = spark.createDataFrame([(d, p, t) for d, doc in enumerate(docs) for p, t in enumerate(doc)], "doc_id bigint, pos bigint, tokens int")
    got = {(r.doc_id, r.pos): r.segment for r in G.packed(rows, 15).collect()}
    for d, doc in enumerate(docs):
        groups, now = [], []
        for p, t in enumerate(doc):
            if now and sum(doc[i] for i in now) + t > 15:
                groups.append(now)
                now = []
            if t > 15:
                groups.append([p])
            else:
                now.append(p)
        groups += [now] if now else []
        assert {p: k for k, g in enumerate(groups) for p in g} == {p: got[d, p] for p in range(len(doc))}


def test_section_mentions(spark):
    text = "See Section 2.1, Sections 1, 2 and 3.4, and Appendix B. Sections here. Section 9."
    rows = spark.createDataFrame([(1, 0, text, "paragraph")], "doc_id bigint, pos int, text string, block_type string")
    assert sorted(r.number for r in R.section_mentions(rows).collect()) == ["1", "2", "2.1", "3.4", "9", "B"]
    sections = spark.createDataFrame([(1, 0, "2.1", "s1"), (1, 5, "2.1", "s2"), (1, 6, "b", "s3"), (2, 0, "9", "s4")], "doc_id bigint, pos int, number string, section_id string")
    assert sorted((r.literal, r.target_id) for r in R.section_references(rows, sections).collect()) == [("Appendix B", "s3"), ("Section 2.1", "s2")]


def test_strings(spark):
    row = spark.createDataFrame([("\u00a0 a \x1c b\n", "Report printed  page iv ", "see page A-7")], "a string, b string, c string")
    got = row.select(T.strip(F.col("a")), T.collapse(F.col("a")), T.margin_text(F.col("b")), T.page_label(F.col("b")), T.page_label(F.col("c")), T.stable_id(F.col("a"), F.lit(None))).first()
    assert tuple(got)[:5] == ("a \x1c b", "a b", "Report <page-label>", "iv", "A-7") and len(got[5]) == 16


def test_headings_of_any_number_and_depth(spark):
    """100,000 headings in one document, and one document that goes over many batches between others."""
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 50 + 1).cast("int").alias("level"))
    rows = rows.union(spark.createDataFrame([(0, 5, 12), (0, 7, 13), (2, 0, 9), (2, 1, None)], "doc_id int, pos int, level int"))
    got = S.nested_sections(rows.repartition(1))
    assert got.count() == 100_003
    assert got.where("doc_id = 1 and parent_pos is distinct from if(pos % 50 = 0, null, pos - 1)").count() == 0
    assert got.where("doc_id = 1 and next_pos is distinct from if(pos < 99950, pos - pos % 50 + 50, null)").count() == 0
    assert {tuple(r) for r in got.where("doc_id <> 1").collect()} == {(0, 5, 12, None, None), (0, 7, 13, 5, None), (2, 0, 9, None, None)}
