import json
import os

import pytest
from pyspark.sql import functions as F

from tracewell.functions import json as J
from tracewell.operators import catalog as C
from tracewell.operators import graph
from tracewell.plans import sequence
from tracewell.sources import artifacts as A
from tracewell.sources import files
from tracewell.sources import inference as I
from tracewell.streaming import events as E


def test_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("x.pdf", b"1"), ("a/Y.PDF", b"2"), ("a/z.txt", b"3"), ("a/empty.pdf", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"x.pdf": "accepted", "Y.PDF": "accepted", "z.txt": "unsupported_suffix", "empty.pdf": "empty"}


def test_walk_gives_reasons_in_order(spark, tmp_path):
    for name in ("b", "store", "a"):
        (tmp_path / name).mkdir()
    for name in ("b/x.pdf", "a/y.pdf", "store/blob", "cat.db", "cat.db-wal", "a/empty"):
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"1")
    (tmp_path / "b/link.pdf").symlink_to(tmp_path / "a/y.pdf")
    os.mkfifo(tmp_path / "pipe")
    found = files.walk(spark, str(tmp_path), catalog=str(tmp_path / "cat.db"), stores=(str(tmp_path / "store"),))
    rows = [(r.relative_path, r.reason) for r in found.collect()]
    assert rows == [("a/empty", None), ("a/y.pdf", None), ("b/link.pdf", "symlink"), ("b/x.pdf", None), ("cat.db", "catalog"), ("cat.db-wal", "catalog"), ("pipe", "special_entry"), ("store", "storage_root")]
    assert files.walk(spark, str(tmp_path), recursive=False).where("relative_path like 'a/%'").count() == 0
    assert [r.reason for r in files.walk(spark, str(tmp_path / "nowhere")).collect()] == ["FileNotFoundError"]


def test_payload(spark):
    payload = {"pages": 3, "texts": [{"label": "title", "text": "T", "prov": [{"page_no": 1, "bbox": '{"l":1,"t":2,"r":3,"b":4}'}]}, {"label": "text", "text": "x", "prov": []}, {"label": "heading", "text": "H", "prov": [{"page_no": 9, "bbox": "[1,2,3,4]"}]}, {"label": "text", "text": "y", "prov": [{"page_no": 0, "bbox": "[4,3,2,1]"}]}]}
    items = files.parser_payload(spark.createDataFrame([(1, json.dumps(payload)), (2, "no json")], "doc_id bigint, payload string"))
    assert [(r.pos, r.page_index, r.box is None) for r in items.orderBy("pos").collect()] == [(0, 0, False), (1, 0, True), (2, 2, False), (3, 0, True)]
    assert [(r.title, r.start_page, r.end_page) for r in files.payload_sections(items).orderBy("pos").collect()] == [("T", 0, 1), ("H", 2, 2)]


def test_html_blocks(spark):
    page = "<html><title>T</title><script><p>no</p></script><h2>Head</h2><p>one <b>two</b><li>item<td>cell</td></html>"
    got = [(r.observed_type, r.text) for r in files.html_blocks(spark.createDataFrame([(1, page)], "page_id bigint, html string")).orderBy("pos").collect()]
    assert got == [("heading", "T"), ("heading", "Head"), ("text", "one two"), ("list_item", "item"), ("table", "cell")]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 1, None)], "doc_id bigint, pos int, text string")
    assert A.put(rows, str(tmp_path), "document", "r1") and not A.put(rows.orderBy(F.desc("doc_id")), str(tmp_path), "document", "r1")
    with pytest.raises(A.Conflict):
        A.put(rows.limit(1), str(tmp_path), "document", "r1")
    with pytest.raises(ValueError):
        A.read(spark, str(tmp_path), "other", "r1")
    assert [tuple(r) for r in A.runs(spark, str(tmp_path)).collect()] == [("r1", "document")]
    assert not [x for x in os.listdir(tmp_path / "r1") if x.startswith("_")], "no draft stays"
    A.put(rows, str(tmp_path), "graph", "r1")
    (now,) = graph.revision(("graph", rows)).first()
    assert A.graph_of(spark, str(tmp_path), "r1", now).count() == 2
    with pytest.raises(A.Conflict):
        A.graph_of(spark, str(tmp_path), "r1", "sg-" + "0" * 64)
    A.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    nested = A.nested(rows.select("doc_id"), ("blocks", rows)).orderBy("doc_id").collect()
    assert nested[0].blocks[0].text == "a"


def test_native_store(spark):
    store = spark.createDataFrame([("a", bytearray(b"x"), "j")], "artifact_id string, payload binary, media_type string").withColumn("sha256", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    incoming = spark.createDataFrame([("a", bytearray(b"x"), "j"), ("b", bytearray(b"y"), "j")], "artifact_id string, payload binary, media_type string")
    assert {r.artifact_id: r.status for r in A.store_native(incoming, store).collect()} == {"a": "unchanged", "b": "stored"}
    assert A.store_native(incoming.withColumn("media_type", F.lit("k")), store).where("status = 'conflict'").count() == 1
    assert A.damaged(store).count() == 0 and A.damaged(store.withColumn("size", F.lit(9))).count() == 1


def test_native_payloads_are_stored_whole_or_not(spark, tmp_path):
    folder, schema = str(tmp_path / "native"), "artifact_id string, payload binary, media_type string"
    first = spark.createDataFrame([("a", bytearray(b"x"), "j"), ("b", bytearray(b""), "j"), ("b", bytearray(b""), "j")], schema)
    assert {r.status for r in A.put_native(first, folder).collect()} == {"stored"}
    assert {r.status for r in A.put_native(first, folder).collect()} == {"unchanged"}
    for bad in ([("c", bytearray(b"z"), "j"), ("a", bytearray(b"other"), "j")], [("c", bytearray(b"z"), "j"), ("c", bytearray(b"y"), "j")]):
        with pytest.raises(A.Conflict):
            A.put_native(spark.createDataFrame(bad, schema), folder)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    assert sorted(r.artifact_id for r in stored.collect()) == ["a", "b"] and A.damaged(stored).count() == 0


def test_models_only_propose(spark):
    def client(prompt):
        if "bad" in prompt:
            return "[1]"
        if "down" in prompt:
            raise TimeoutError
        return json.dumps({"target_id": prompt[-1], "confidence": 7, "title": "T", "tags": ["a"]})

    tasks = spark.createDataFrame([("r", f"t{k}", "cites" if k else "other", p) for k, p in enumerate(["to a", "to a", "to z", "bad", "down", "to a"])], "run_id string, task_id string, relation_type string, prompt string")
    anchors = spark.createDataFrame([("a",)], "anchor_id string")
    got = {r.task_id: (r.target_id, r.confidence, r.status) for r in I.resolve(tasks, client, ("cites",), anchors, 5).collect()}
    assert got == {"t0": (None, None, "relation_not_allowed"), "t1": ("a", 1.0, "inferred"), "t2": (None, None, "unknown_target"), "t3": (None, None, "inference_failed:ValueError"), "t4": (None, None, "inference_failed:TimeoutError"), "t5": (None, None, "inference_call_limit_reached")}
    (row,) = I.enhance(spark.createDataFrame([("s", "text a")], "section_id string, text string"), client, "m").collect()
    assert tuple(row) == ("s", "m", "T", ["a"], False, None)


def test_pointers(spark):
    doc = '{"a/b": [10, {"m~n": "\u00e9"}], "k": null}'
    cases = {"#": '{"a/b":[10,{"m~n":"\u00e9"}],"k":null}', "#/a~1b/0": "10", "#/a~1b/1/m~0n": '"\u00e9"', "#/k": "null", "#/a~1b/00": None, "#/a~1b/2": None, "#/k/x": None, "#/a~2": None, "/k": None, "#/%6B": "null"}
    rows = spark.createDataFrame([(doc, p) for p in cases], "d string, p string")
    assert {r.p: r.v for r in rows.select("p", J.resolve(F.col("d"), F.col("p")).alias("v")).collect()} == cases
    strict = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ('{"a":NaN}',)], "d string").select(J.strict(F.col("d")).alias("s")).collect()
    assert [r.s for r in strict] == [True, False, False]


def test_keys_and_paths(spark):
    keys = {"apiKey": True, "session_token": True, "layoutMode": False, "DBPassword": True, "max-pages": False}
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", C.is_secret_key(F.col("k")).alias("s")).collect()}
    assert got == keys
    paths = {"a//b/": "a/b", "/etc": None, "a/../b": None, "C:\\x": None, "  ": None, "x\\y": "x/y"}
    assert {r.p: r.b for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", C.bundle_path(F.col("p")).alias("b")).collect()} == paths


def test_stream_is_a_fold_that_can_be_repeated(spark, tmp_path):
    events = [(1, 7, "registered", "a"), (2, 7, "hold_set", None), (3, 7, "reference_removed", "a"), (4, 7, "hold_released", None), (5, 7, "expired", None), (6, 8, "registered", "b"), (6, 8, "registered", "b")]
    frame = spark.createDataFrame(events, "event_sequence bigint, artifact_id bigint, event_type string, reference_id string").withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, event_sequence)"))
    landing, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    frame.where("event_sequence < 4").write.parquet(landing)
    E.append_log(E.landed(spark, landing), log, mark).awaitTermination(120)
    assert {r.artifact_id: (r.references, r.legal_hold) for r in E.state_of(spark, log).collect()} == {7: (0, True)}
    frame.where("event_sequence >= 3").write.mode("append").parquet(landing)
    E.append_log(E.landed(spark, landing), log, mark).awaitTermination(120)
    got = {r.artifact_id: (r.references, r.legal_hold, r.expired) for r in E.state_of(spark, log).collect()}
    assert got == {7: (0, False, True), 8: (1, False, False)}
    assert [r.event_sequence for r in E.follow(spark, log, 4).collect()] == [5, 6]


def test_sums_and_neighbours(spark):
    rows = [("a" if k % 4 else None, k, k % 7) for k in range(300)]
    frame = spark.createDataFrame(rows, "g string, k int, v bigint").repartition(9)
    summed = {r.k: r.s for r in sequence.running_sum(frame, "g", ["k"], "v", "s").collect()}
    beside = {r.k: (r.previous.k if r.previous else None, r.following.k if r.following else None) for r in sequence.neighbours(frame, "g", ["k"], ["k"]).collect()}
    for g in ("a", None):
        own, total = [r for r in rows if r[0] == g], 0
        for i, (_, k, v) in enumerate(own):
            total += v
            assert summed[k] == total
            assert beside[k] == (own[i - 1][1] if i else None, own[i + 1][1] if i + 1 < len(own) else None)
