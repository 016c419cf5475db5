"""A quality classifier: naive Bayes log-count ratios under a linear hinge-loss model.

Tokens are words, runs of other signs, and a mark in place of a token that repeats
the one before it, which lets the model see stuttering text of any vocabulary.
Features are the distinct token 1-grams and 2-grams of a text, and the first 4 to
8 bytes of longer words, as word families carry what single rare words cannot.  For each feature
the log ratio of its smoothed document rates in the two classes scales its
indicator; a linear model with hinge loss is fitted to the scaled indicators by
dual coordinate descent.  Two models are fitted: one for low quality and one for
toxicity.  A text is rejected if either says so.

The fit uses a bounded sample of labelled rows: in each of the label combinations
the ``per_class`` labels of least hash of ``doc_id`` (default PER_CLASS), one text each.
The model holds at most as many features as that sample has, those of ``min_texts``
texts at least (default MIN_TEXTS).  Every document is scored on all its features.

Defined results: a null or empty text and a text without tokens are rejected, as
there is nothing to keep; a null or repeated ``doc_id`` and ties do not matter to
scoring, which looks at the text alone; ids may have any type; of several texts of one
labelled id the fit takes the one of least hash; labels that are null or without a document
are not used, and of contradicting labels of one document the sum counts as worse
(least quality, most toxic); with no labels of one of the classes its model rejects
nothing; empty tables give empty results; texts are read whole; other columns pass
through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.wordhash import U, mix, per_text, prefixes, raw, texts_in_slices, tokens
from tracewell.plans.lineage import drop_written, fresh, written

#: Labelled rows of each (quality, toxic) combination that the fit uses at most.
PER_CLASS = 3000
#: A feature of fewer sample texts than this has no weight, unless the caller says otherwise.
MIN_TEXTS = 3
#: Lengths in bytes of the beginnings of longer words that are features.
PREFIXES = range(4, 9)
#: Texts added to each feature's count, spread over the classes as all texts are: rare features get ratios near 0.
SMOOTHING = 4.0
C = 1.0
EPOCHS = 12
#: Leading hash bits by which a scorer first sees that a feature has no weight.
FILTER_BITS = 24

_REPEAT = U(0x51ED270B35A1F00D)
_PAIR = U(0x9E3779B97F4A7C15)


def occurrences(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and hash of features as they occur, some of them repeatedly, and the number of tokens of each text."""
    body, offsets = raw(arr)
    starts, ends, hashes = tokens(body, offsets, marks=True)
    first = per_text(starts, offsets)
    owner = np.repeat(np.arange(len(arr)), np.diff(first))
    if not len(owner):
        return owner, hashes, np.diff(first)
    _, at = np.unique(mix(hashes + owner.astype(np.uint64) * _PAIR), return_index=True)
    which, stem = prefixes(body, starts[at], ends[at], PREFIXES)
    inner = owner[1:] == owner[:-1]
    marked = hashes.copy()
    marked[1:][inner & (hashes[1:] == hashes[:-1])] = _REPEAT
    pair = mix(marked[:-1] * _PAIR + mix(marked[1:]))[inner]
    return np.concatenate([owner[at], owner[at][which], owner[1:][inner]]), np.concatenate([hashes[at], stem, pair]), np.diff(first)


def features(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct feature hashes of each text, and where each text's begin (n + 1 values)."""
    owner, value, _ = occurrences(arr)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(len(arr) + 1))


@dataclass(frozen=True)
class Linear:
    """Weights of features (sorted hashes), and the bias; a score above 0 is the positive class."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


class Scorer:
    """Several models over one table of features."""

    def __init__(self, models: list[Linear]) -> None:
        self.keys = np.unique(np.concatenate([m.keys for m in models]))
        self.weights = np.zeros((len(models), len(self.keys)))
        self.bias = np.array([m.bias for m in models])
        for i, m in enumerate(models):
            self.weights[i, np.searchsorted(self.keys, m.keys)] = m.weights
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> U(64 - FILTER_BITS)] = True

    def scores(self, arr: pa.Array) -> np.ndarray:
        """(texts, models) scores; NaN for a text without tokens."""
        owner, value, count = occurrences(arr)
        near = np.flatnonzero(self.filter[value >> U(64 - FILTER_BITS)])
        owner, value = owner[near], value[near]
        out = np.tile(self.bias, (len(arr), 1))
        if len(self.keys) and len(value):
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            hit = self.keys[at] == value
            once = np.sort(owner[hit] * len(self.keys) + at[hit])
            once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]
            who, which = np.divmod(once, len(self.keys))
            for i, weights in enumerate(self.weights):
                out[:, i] += np.bincount(who, weights[which], len(arr))
        out[count == 0] = np.nan
        return out


def fit(keys: np.ndarray, at: np.ndarray, first: np.ndarray, positive: np.ndarray, seed: int = 7) -> Linear:
    """Fit the model to texts given by the places of their features in ``keys``; with one class only, it says never."""
    n = len(positive)
    if not positive.any() or positive.all():
        return Linear(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    yes, no = np.zeros(len(keys)), np.zeros(len(keys))
    for i in range(n):
        (yes if positive[i] else no)[at[first[i] : first[i + 1]]] += 1
    n_yes, n_no = positive.sum(), (~positive).sum()
    ratio = np.log((yes + SMOOTHING * n_yes / n) / n_yes) - np.log((no + SMOOTHING * n_no / n) / n_no)
    norm = np.array([np.square(ratio[at[first[i] : first[i + 1]]]).sum() for i in range(n)]) + 1.0
    sign = np.where(positive, 1.0, -1.0)
    cap = C * np.where(positive, n / (2 * n_yes), n / (2 * n_no))
    w, bias, alpha = np.zeros(len(keys)), 0.0, np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            cols = at[first[i] : first[i + 1]]
            vals = ratio[cols]
            gradient = sign[i] * (w[cols] @ vals + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cap[i])
            if step := (new - alpha[i]) * sign[i]:
                w[cols] += step * vals
                bias += step
                alpha[i] = new
    weights = w * ratio
    heavy = weights != 0
    return Linear(keys[heavy], weights[heavy], bias)


def sample(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_, quality, toxic of the labelled rows that the fit uses.

    At most ``4 * per_class`` labels are chosen, so they are broadcast and the
    texts of the others never leave their tasks.  A label whose id stands in many rows
    gives one text, so the sample is bounded however often an id repeats.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = one.groupBy(F.col("doc_id").alias("doc_")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = Window.partitionBy("quality", "toxic").orderBy(F.xxhash64("doc_"), "doc_")
    chosen = one.withColumn("nth_", F.row_number().over(order)).where(F.col("nth_") <= per_class).drop("nth_")
    docs = documents.select(F.col(id_col).alias("doc_"), F.col(text_col).alias("text_")).where("text_ is not null")
    found = docs.join(F.broadcast(chosen), "doc_")
    whole = dict(found.dtypes)["doc_"] in ("tinyint", "smallint", "int", "bigint")
    found = found.groupBy("doc_", "quality", "toxic").agg(F.min_by("text_", F.xxhash64("text_")).alias("text_"))
    return found.withColumn("doc_", F.col("doc_").cast("bigint") if whole else F.xxhash64("doc_"))


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, min_texts: int = MIN_TEXTS, **columns: str) -> tuple[Linear, Linear]:
    """The models of low quality and of toxicity.

    The sample's features are counted on the cluster; the driver gets those of
    ``min_texts`` texts and more, and the texts as places among them.
    """
    spark = documents.sparkSession

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in texts_in_slices(batch.column("text_")):
                part = batch.slice(a, b - a)
                value, first = features(part.column("text_"))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_"), part.column("quality").cast(pa.int32()), part.column("toxic").cast(pa.int32()), lists], names=["doc_", "quality", "toxic", "value"])

    rows = written(sample(documents, labels, per_class, **columns).mapInArrow(extract, "doc_ bigint, quality int, toxic int, value array<bigint>"), "sample")
    common = rows.select(F.explode("value").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select("f").toArrow()
    keys = np.sort(np.asarray(common.column("f").combine_chunks()).view(np.uint64))
    del common
    shared = spark.sparkContext.broadcast(keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lists = batch.column("value")
            value = np.asarray(lists.flatten()).view(np.uint64)
            at = np.searchsorted(known, value)
            hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == value) if len(known) else np.zeros(len(value), bool))
            first = np.searchsorted(hit, np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths())))))
            places = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_"), batch.column("quality"), batch.column("toxic"), places], names=["doc_", "quality", "toxic", "at"])

    sampled = rows.mapInArrow(encode, "doc_ bigint, quality int, toxic int, at array<int>").toArrow()
    shared.unpersist()
    drop_written(rows)
    order = np.argsort(np.asarray(sampled.column("doc_").combine_chunks()), kind="stable")
    lists = [x for chunk in sampled.column("at").chunks for x in np.split(np.asarray(chunk.flatten()), np.cumsum(np.asarray(chunk.value_lengths()))[:-1])] if len(sampled) else []
    lists = [lists[i] for i in order]
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    at = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    quality, toxic = (np.asarray(sampled.column(c).combine_chunks())[order] for c in ("quality", "toxic"))
    del lists, sampled
    return fit(keys, at, first, quality < 1), fit(keys, at, first, toxic > 0)


def _score(shared):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer([Linear(*m) for m in shared.value])
        for batch in batches:
            parts = [scorer.scores(batch.slice(a, b - a)) for a, b in texts_in_slices(batch)]
            both = np.concatenate(parts) if parts else np.zeros((0, 2))
            fields = [("low", pa.float64()), ("toxic", pa.float64())]
            yield pa.StructArray.from_arrays([pa.array(both[:, i].copy()) for i in (0, 1)], fields=[pa.field(*f) for f in fields])

    return score


def scores(documents: DataFrame, labels: DataFrame, text: Column, **options) -> Column:
    """A struct of the two models' scores of ``text``: low, toxic. NaN for a text without tokens. Trains when called."""
    models = train(documents, labels, **options)
    shared = documents.sparkSession.sparkContext.broadcast([(m.keys, m.weights, m.bias) for m in models])
    return F.arrow_udf(_score(shared), "struct<low:double,toxic:double>").asNondeterministic()(text)


def kept(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and both scores of the documents that pass (scores at most 0)."""
    found = scores(documents, labels, F.col("text_"), id_col=id_col, text_col=text_col, **options)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"))
    return docs.select("doc_id", found.alias("s_")).where("s_.low <= 0 and s_.toxic <= 0").select("doc_id", F.col("s_.low").alias("low_quality"), F.col("s_.toxic").alias("toxic"))


def drop_rejected(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    (name,) = fresh(documents, "scores")
    found = scores(documents, labels, F.col(text_col), id_col=id_col, text_col=text_col, **options)
    passed = documents.withColumn(name, found).where((F.col(f"{name}.low") <= 0) & (F.col(f"{name}.toxic") <= 0))
    return passed.select(*[F.col(f"`{c}`") for c in documents.columns])
