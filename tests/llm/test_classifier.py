import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.llm import classifier

DOCS = "doc_id bigint, text string, scores string"


def _corpus(n=600, seed=2):
    rng = random.Random(seed)
    good, bad, vile = ([f"{p}{k}" for k in range(200)] for p in ("plain", "junk", "vile"))
    docs, labels = [], []
    for k in range(n):
        low, toxic = rng.random() < 0.3, rng.random() < 0.2
        words = [rng.choice(bad if low and rng.random() < 0.5 else good) for _ in range(80)]
        if toxic:
            words[::15] = [rng.choice(vile) for _ in words[::15]]
        docs.append((k, " ".join(words), "s"))
        labels.append((k, int(not low), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _corpus()
    frame = spark.createDataFrame(docs, DOCS)
    kept = {r.doc_id for r in classifier.kept(frame, spark.createDataFrame(labels[:300], "doc_id bigint, quality int, toxic int")).collect()}
    right = sum((k in kept) == (quality == 1 and toxic == 0) for k, quality, toxic in labels[300:])
    assert right / 300 > 0.95


def test_accuracy_on_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    kept = {r.doc_id for r in classifier.kept(docs, train).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    clean = [r.doc_id in kept for r in held if r.quality == 1 and r.toxic == 0]
    toxic = [r.doc_id not in kept for r in held if r.toxic == 1]
    low = [r.doc_id not in kept for r in held if r.quality == 0]
    print("clean kept", np.mean(clean), "toxic gone", np.mean(toxic), "low gone", np.mean(low))
    assert np.mean(clean) > 0.97 and np.mean(toxic) > 0.9 and np.mean(low) > 0.9


def _plain_features(text):
    """Words, beginnings of words and neighbours of a text of plain words, without a hash."""
    words = text.split()
    out = {("1", w) for w in words} | {("p", w[:k]) for w in words for k in range(4, 9) if len(w) > k}
    marked = ["=" if i and words[i - 1] == w else w for i, w in enumerate(words)]
    return out | {("2", *pair) for pair in zip(marked, marked[1:])}


def _plain_model(texts, positive, min_texts, seed=7):
    """Log-count ratios and dual coordinate descent over dictionaries, in the order of the same generator."""
    rows = [_plain_features(t) for t in texts]
    seen = Counter(f for r in rows for f in r)
    rows = [sorted(f for f in r if seen[f] >= min_texts) for r in rows]
    n, n_yes = len(rows), sum(positive)
    n_no = n - n_yes
    yes, no = Counter(), Counter()
    for r, p in zip(rows, positive):
        (yes if p else no).update(r)
    smooth = classifier.SMOOTHING
    ratio = {f: math.log((yes[f] + smooth * n_yes / n) / n_yes) - math.log((no[f] + smooth * n_no / n) / n_no) for r in rows for f in r}
    norm = [1 + sum(ratio[f] ** 2 for f in r) for r in rows]
    weight, bias, alpha, rng = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * n, np.random.default_rng(seed)
    for _ in range(classifier.EPOCHS):
        for i in rng.permutation(n):
            sign = 1 if positive[i] else -1
            margin = sign * (sum(weight[f] * ratio[f] for f in rows[i]) + bias)
            new = min(max(alpha[i] - (margin - 1) / norm[i], 0.0), classifier.C * n / (2 * (n_yes if positive[i] else n_no)))
            for f in rows[i]:
                weight[f] += (new - alpha[i]) * sign * ratio[f]
            bias += (new - alpha[i]) * sign
            alpha[i] = new
    return lambda text: bias + sum(weight[f] * ratio[f] for f in _plain_features(text) if f in ratio), alpha


def _mixed(n=80, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"word{x}ing" if x % 3 else f"w{x}" for x in rng.integers(0, 30 if k % 2 else 60, 40)) for k in range(n)]


def test_ratios_and_fit_equal_a_plain_version():
    texts, unseen = _mixed(), _mixed(20, 1)
    positive = np.arange(80) % 2 == 0
    value, first = classifier.features(pa.array(texts))
    keys, at = np.unique(value, return_inverse=True)
    score, alpha = _plain_model(texts, positive, 1)
    model = classifier.fit(keys, at, first, positive)
    got = classifier.Scorer([model]).scores(pa.array(texts + unseen))[:, 0]
    assert np.allclose(got, [score(t) for t in texts + unseen])
    assert ((got[:80] > 0) == positive).mean() > 0.95 and any(alpha) and min(alpha) >= 0


def test_training_on_tables_equals_the_plain_version(spark):
    """Text ids, an id that repeats and a label of its own kind: the models still are those of the plain version."""
    texts = _mixed(60, 3)
    docs = [(f"d{k:03}", t) for k, t in enumerate(texts)] + [("d003", texts[3])] * 5 + [(None, "w1 w2")]
    labels = [(f"d{k:03}", int(k % 2 == 0), int(k % 5 == 0)) for k in range(60)]
    frame, marks = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(labels, "doc_id string, quality int, toxic int")
    order = [r[0] for r in spark.createDataFrame(labels, "doc_id string, quality int, toxic int").orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    by_id = {f"d{k:03}": k for k in range(60)}
    at = [by_id[d] for d in order]
    for min_texts in (1, 3):
        models = classifier.train(frame, marks, min_texts=min_texts)
        got = classifier.Scorer(list(models)).scores(pa.array(texts))
        for i, positive in enumerate(([k % 2 != 0 for k in at], [k % 5 == 0 for k in at])):
            score, _ = _plain_model([texts[k] for k in at], positive, min_texts)
            assert np.allclose(got[:, i], [score(t) for t in texts])
    assert classifier.kept(frame, marks).count() > 0


def test_edge_rows(spark):
    docs, labels = _corpus(200)
    extra = [(1000, None, "s"), (1001, "", "s"), (None, docs[0][1], "s"), (1002, "plain1 " * 100_000, "s"), docs[0], (1003, "   \n", "s")]
    frame = spark.createDataFrame(docs + extra, DOCS)
    label = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (4, 0, None), labels[5], (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = classifier.drop_rejected(frame, label)
    assert out.columns == frame.columns
    left = [r.doc_id for r in out.collect()]
    assert not {1000, 1001, 1003} & set(left)
    assert classifier.drop_rejected(frame, label.limit(0)).count() == frame.where(F.length(F.trim("text")) > 4).count()
    assert classifier.drop_rejected(frame.limit(0), label).count() == 0
