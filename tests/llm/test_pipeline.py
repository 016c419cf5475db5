"""The stages one after the other against brute force on each stage's own input."""

from collections import Counter

import numpy as np
import pyarrow as pa

from test_mixing import _brute as brute_copies
from test_mixing import _starts as brute_starts
from test_sharding import _brute as brute_shards
from test_sharding import _code as brute_code

import corpus_pipeline
from tracewell.llm import classifier, decontam, sharding, simhash
from tracewell.plans.lineage import standing, sweep

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        outs.append(corpus_pipeline.written(stage(spark, outs[-1] if outs else docs, SF), "test"))
    quality, single, clean, mixed, sharded = outs
    assert all(o.columns == docs.columns for o in outs[:-1]) and sharded.columns == [*docs.columns, "shard_id"]

    models = classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    scores = classifier.Scorer(list(models)).scores(pa.array([r.text for r in rows]))
    assert {r.doc_id for r in quality.collect()} == {r.doc_id for r, s in zip(rows, scores) if (s <= 0).all()}

    rows = quality.orderBy("doc_id").collect()
    sig = simhash.signatures(pa.array([r.text for r in rows]))
    near = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(2) <= simhash.MAX_BITS
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    want = {rows[i].doc_id for i, r in enumerate(root) if i == r}
    assert {r.doc_id for r in single.collect()} == want

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scanner = decontam.Scanner(items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not scanner.scan(r.text)}

    rows = [(r.doc_id, r.text, r.source, 1, "") for r in clean.collect()]
    copies, _ = brute_copies(rows, brute_starts(clean))
    assert Counter(r.doc_id for r in mixed.collect()) == copies

    rows = mixed.collect()
    meta = [((brute_code(r.lang), brute_code(r.source), r.n_chars, r.doc_id), len(r.text.encode())) for r in rows]
    parts = brute_shards(meta, sharding.TARGET_BYTES, 4)
    assert Counter((r.doc_id, r.shard_id) for r in sharded.collect()) == Counter((rows[i].doc_id, s) for s, part in enumerate(parts) for i in part)


def test_edge_rows(spark, tmp_path):
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = benchmark.first().text
    kept = docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id", "left_semi").limit(20).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in kept]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, " \n", "en", "s", 2), rows[0], rows[0], (None, kept[1].text + " once more", None, None, None), (903, kept[2].text + " " + item, "en", "s", 9), (904, kept[3].text * 200, "en", "s", 9)]
    frame = spark.createDataFrame([(*r, "x", 1, "y", None) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard_id string, text_hash int, scores string, hits string")
    for name, table in (("documents", frame), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    before = standing()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*frame.columns, "shard_id_"]
    got = {r.doc_id for r in out.collect()}
    assert got and not {900, 901, 902, 903} & got and len(standing() - before) == 1
    frame.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    sweep(before)


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.columns[-1] == "shard_id"
    assert [n for n in entry.queries() if n.startswith("op")] and len([n for n in entry.queries() if n.startswith("op")]) == 10
