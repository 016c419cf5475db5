import random
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bloom, linefreq
from tracewell.llm.html import html_lines, sql_lines

DOCS = "doc_id bigint, text string, source string, lines string, host string, h string"
PAGES = "page_id bigint, url string, html string, host string, id string"


def _norm(text):
    return [x for x in (" ".join(y for y in line.replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ") if y) for line in (text or "").split("\n")) if x]


def _docs():
    rng = random.Random(6)
    common = [f"Common line {k} of all" for k in range(12)]
    out = []
    for k in range(200):
        if out and rng.random() < 0.1:
            out.append((k, *rng.choice(out)[1:]))
            continue
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own {k} {i} text" for i in range(rng.randrange(1, 12))]
        out.append((k, "\n".join(lines).replace(" line", "  LINE" if k % 3 else "\tline"), f"s{rng.randrange(3)}", "x", "y", "z"))
    return out


def _brute(docs, limit, kept):
    seen = defaultdict(set)
    for doc_id, text, source, *_ in docs:
        for line in _norm(text):
            seen[source, line.lower()].add(doc_id)
    out = []
    for doc_id, text, source, *_ in docs:
        lines = _norm(text)
        left = [x for x in lines if len(seen[source, x.lower()]) <= limit]
        if left and sum(map(len, left)) >= kept * sum(map(len, lines)):
            out.append((doc_id, source, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [27, 7])
def test_documents_equal_brute_force(spark, monkeypatch, bits):
    """Also with a filter so small that it lets nearly everything through to the join."""
    monkeypatch.setattr(bloom, "FILTER_BITS", bits)
    docs = _docs()
    frame = spark.createDataFrame(docs, DOCS)
    for limit, kept in ((3, 0.5), (8, 0.0), (10**6, 0.5)):
        got = sorted((tuple(r) for r in linefreq.clean_documents(frame, max_docs=limit, min_kept=kept).collect()), key=repr)
        assert got == _brute(docs, limit, kept)


def test_copies_count_as_documents(spark):
    rows = [(k, "Shared\nsame to all", "a", "x", "y", "z") for k in range(30)] + [(100 + k, f"Twenty\n{'own' * 9} {k % 15}", "a", "x", "y", "z") for k in range(20)]
    rows += [(200, "Again\nown", "a", "x", "y", "z")] * 30 + [(None, f"No id\n{'alone' * 9} {k}", "b", "x", "y", "z") for k in range(21)]
    got = sorted((str(r.doc_id), r.n_removed) for r in linefreq.clean_documents(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([(str(100 + k), 0) for k in range(20)] + [("200", 0)] * 30 + [("None", 1)] * 21)


def test_documents_edge_rows(spark):
    long = "\n".join(f"line number {k}" for k in range(100_000))
    rows = [(1, None, "a", "x", "y", "z"), (2, "", "a", "x", "y", "z"), (3, " \n\t", "a", "x", "y", "z"), (4, long, "a", "x", "y", "z"), (None, "alone", None, "x", "y", "z"), (5, "twice\ntwice", "a", "x", "y", "z"), (5, "twice\ntwice", "a", "x", "y", "z")]
    frame = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in linefreq.clean_documents(frame, max_docs=1).collect())
    assert got == [("4", 100_000, 0), ("5", 2, 0), ("5", 2, 0), ("None", 1, 0)]
    assert linefreq.clean_documents(frame, max_docs=0).count() == 0
    assert linefreq.clean_documents(frame.limit(0)).count() == 0


def test_pages_equal_brute_force(spark):
    rng = random.Random(8)
    pages, plain = [], []
    for k in range(120):
        host = f"h{min(3, int(rng.expovariate(0.7)))}.example.org"
        lines = [rng.choice([f"Menu {host}", "Imprint", f"Footer {host}"]) if rng.random() < 0.4 else f"own {k} {i}" for i in range(8)]
        pages.append((k, f"https://{host.upper()}:80/p/{k}?q=1", "<html><body>" + "".join(f"<p>{x} <b></b></p>" for x in lines) + "<script>var a='<p>no</p>'</script><!-- <p>no</p> --></body></html>", "x", "y"))
        plain.append((k, host, lines))
    total, seen = defaultdict(set), defaultdict(set)
    for k, host, lines in plain:
        total[host].add(k)
        for line in lines:
            seen[host, line].add(k)
    want = []
    for k, host, lines in plain:
        limit = len(total[host]) * linefreq.MAX_RATIO
        left = [x for x in lines if len(seen[host, x]) < 2 or len(seen[host, x]) <= limit]
        want.append((k, host, "\n".join(left), len(lines), len(lines) - len(left)))
    got = sorted(tuple(r) for r in linefreq.clean_pages(spark.createDataFrame(pages, PAGES)).collect())
    assert got == sorted(want) and sum(w[4] for w in want) > 50


def test_pages_of_small_hosts_lose_shared_lines(spark):
    rows = [(10 * n + k, f"http://h{n}.org/{k}", f"<p>Menu</p><p>own {k}</p>" + ("<p>pair</p>" if k < 2 else ""), "x", "y") for n in range(1, 8) for k in range(n)]
    got = {r.page_id: r.text.split("\n") for r in linefreq.clean_pages(spark.createDataFrame(rows, PAGES)).collect()}
    for n in range(1, 8):
        for k in range(n):
            menu, pair = n == 1, k < 2 and (n == 1 or 2 <= n * linefreq.MAX_RATIO)
            assert got[10 * n + k] == ["Menu"] * menu + [f"own {k}"] + ["pair"] * pair


def test_pages_edge_rows(spark):
    rows = [(1, None, "<p>a</p>", "x", "y"), (2, "no url", None, "x", "y"), (3, "http://h.org/", "", "x", "y"), (None, "http://h.org/a", "<p>b" * 50_000, "x", "y"), (4, "http://h.org/b", "<p>same", "x", "y"), (4, "http://h.org/b", "<p>same", "x", "y")]
    got = linefreq.clean_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == 6 and all(r.n_removed == 0 for r in got)
    assert {r.page_id: r.host for r in got} == {1: None, 2: None, 3: "h.org", None: "h.org", 4: "h.org"}
    assert linefreq.clean_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_hostile_pages_take_time_in_proportion(spark):
    """Signs that begin tags, comments and scripts which never end."""
    heads = ["<", "<p", "<!--", "<script ", "<style>", "</script ", "<!-- -->", "&amp;", "<" + " " * 50]
    pages = [(k, f"http://h{k}.org/", "first<br>" + head * (5_000_000 // len(head))) for k, head in enumerate(heads)]
    began = time.monotonic()
    out = linefreq.clean_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).select("page_id", F.substring("text", 1, 5).alias("text")).collect()
    assert {r.page_id for r in out} == set(range(len(heads))) and all(r.text == "first" for r in out)
    assert time.monotonic() - began < 90


def test_what_a_page_leaves_open_ends_with_it(spark):
    rows = [(1, "<p>a<!-- b"), (2, "a<script>b<p>c"), (3, "a<STYLE>b"), (4, "a<b c"), (5, "a</script>b"), (6, "a --> b"), (7, "a<!-- x --><script>y</script ><style>z</style>b")]
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k int, h string").select("k", html_lines(F.col("h")).alias("x")).collect()}
    assert got == {1: ["a"], 2: ["a"], 3: ["a"], 4: ["a"], 5: ["ab"], 6: ["a --> b"], 7: ["a b"]}
    sql = duckdb.execute(f"SELECT k, {sql_lines('h')} FROM (VALUES {', '.join(map(str, rows))}) t(k, h)").fetchall()
    assert dict(sql) == got
