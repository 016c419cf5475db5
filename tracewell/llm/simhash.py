"""SimHash near-duplicates through one-wildcard segment variants.

Each text gets a 128-bit SimHash of its words, weighted by the square root of
their count (words of under four bytes only if there are no others, since they
tell texts apart badly).  Two texts are near-duplicates if their signatures differ
in at most ``MAX_BITS`` = 15 bits.  The signature is cut into ``SEGMENTS`` = 8
segments, so of any two such signatures one segment differs in at most one bit (two
bits in each would be 16).  For each bit of each segment the segment with that bit
masked is a key; two segments that differ in at most one bit share a key.  An
equality join on the keys therefore finds every such pair, without exception, and
each is verified on the whole signature.

Within a key, links are a spanning forest of the verified pairs instead of all pairs:
groups are connected components, and those stay the same.  Keys of up to ``PAIRS``
signatures compare all pairs at once.  In larger ones tight groups are taken out
first; what is left, beyond ``WIDE`` signatures, is keyed again in the same way over
another order of the bits, which is exact for the same reason, so the cost of a key
full of unrelated signatures grows with its size and not with its square.  A key gets
about one in 32,768 of the distinct signatures, 24 bytes each.

Groups hold the rows whose signatures are linked, directly or through others.  The
row with the least ``doc_id`` (nulls last, then the least text hash) stays.
Signatures are numbered, not hashed, so groups never meet by an accident of a hash.

Defined results: a null text belongs to no group and stays; texts without words
are near-duplicates only of equal texts, so all empty texts are one group; a
repeated row (same doc_id and text) is a copy and one of them stays; a null
doc_id is a value like others in the stage, and in :func:`duplicate_pairs` it
takes part in groups but such a row cannot be named, so it gives no pair; an empty
table gives an empty result; texts are hashed whole; other columns pass through
under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.wordhash import U, mix, per_text, raw, texts_in_slices, tokens
from tracewell.operators.fusion import aligned_groups
from tracewell.plans.lineage import fresh, written

BITS = 128
SEGMENTS = 8
#: The most bits of which one segment differs in at most one, whichever they are.
MAX_BITS = 2 * SEGMENTS - 1
#: Signatures of a key of which all pairs are compared at once.
PAIRS = 512
#: Signatures of a key beyond which it is keyed again, at most DEPTH times.
WIDE = 2048
DEPTH = 3
#: Key rows for one task of the join; the number of partitions follows from the number of signatures.
TASK_ROWS = 2_000_000
#: Features whose bits are unpacked at once.
FEATURES = 1 << 15

_EDGES = np.linspace(0, BITS, SEGMENTS + 1).astype(int)
_HALF = mix(np.array([1, 2], np.uint64))
_SIG = "struct<a:bigint,b:bigint>"
_SIG_ARROW = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _accumulate(owner: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sign bits of the weighted sums of each text's features, as two 64-bit words. Sums are of integers: no order of adding changes them."""
    out = np.zeros((n, 2), np.uint64)
    mass = np.bincount(owner, weight, n).astype(np.int64)
    for half in (0, 1):
        total = np.zeros((n, 64), np.int64)
        for at in range(0, len(owner), FEATURES):
            part = slice(at, at + FEATURES)
            mine = owner[part]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            x = mix(feature[part] + _HALF[half])
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[mine[first]] += np.add.reduceat(bits * weight[part, None], first, axis=0)
        out[:, half] = np.packbits(2 * total > mass[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def signatures(arr: pa.Array) -> np.ndarray:
    """An (n, 2) array of signature words."""
    body, offsets = raw(arr)
    starts, ends, hashes = tokens(body, offsets)
    first = per_text(starts, offsets)
    owner = np.repeat(np.arange(len(arr)), np.diff(first))
    long = ends - starts >= 4
    any_long = np.zeros(len(arr), bool)
    any_long[owner[long]] = True
    keep = long | ~any_long[owner]
    owner, hashes = owner[keep], hashes[keep]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    weight = np.rint(16 * np.sqrt(np.diff(np.append(at, len(owner))))).astype(np.int32)
    first = np.searchsorted(owner[at], np.arange(len(arr) + 1))
    out = _accumulate(owner[at], hashes[at], weight, len(arr))
    for i in np.flatnonzero(np.diff(first) == 0):
        whole = body[offsets[i] : offsets[i + 1]]
        h = 0
        for part in range(0, len(whole), 1 << 16):
            step = whole[part : part + (1 << 16)].astype(np.uint64)
            h = int(mix(np.array([h], np.uint64) + mix(step + np.arange(1, len(step) + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).sum())[0])
        out[i] = mix(np.array([h, h], np.uint64) + np.array([1, 2], np.uint64))
    return out


def _sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        parts = [signatures(batch.slice(a, b - a)) for a, b in texts_in_slices(batch)]
        sig = (np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)).view(np.int64)
        null = pa.array(np.asarray(batch.is_null()))
        yield pa.StructArray.from_arrays([pa.array(sig[:, 0].copy()), pa.array(sig[:, 1].copy())], fields=list(_SIG_ARROW), mask=null)


def signature(text: Column) -> Column:
    """The 128-bit SimHash as a struct of two longs; null for a null text."""
    return F.arrow_udf(_sign, _SIG).asNondeterministic()(text)


def keys_of(sig: np.ndarray) -> Iterator[np.ndarray]:
    """For each wildcard the keys of all signatures: the segment's number and wildcard, and its masked bits."""
    for segment in range(SEGMENTS):
        lo, hi = int(_EDGES[segment]), int(_EDGES[segment + 1])
        if lo // 64 == (hi - 1) // 64:
            part = sig[:, lo // 64] >> U(lo % 64)
        else:
            part = (sig[:, 0] >> U(lo)) | (sig[:, 1] << U(64 - lo))
        part = part & U((1 << (hi - lo)) - 1)
        for bit in range(hi - lo):
            yield (part & ~U(1 << bit)) | U((segment * 64 + bit) << 40)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            sig = np.stack([np.asarray(part.column(0)), np.asarray(part.column(1))], 1).view(np.uint64)
            keys = np.concatenate([mix(k) for k in keys_of(sig)]).view(np.int64)
            a, b = (np.tile(sig[:, i].view(np.int64), BITS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(a), pa.array(b)], names=["key", "a", "b"])


def _near(one: np.ndarray, other: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(one ^ other).sum(1) <= max_bits


def _join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the rows that the pairs (i, j) join one root, the least row; ``root`` is changed in place."""
    while len(i):
        one, two = root[i], root[j]
        differ = one != two
        i, j = i[differ], j[differ]
        np.minimum.at(root, np.maximum(one, two)[differ], np.minimum(one, two)[differ])
        while (root != (up := root[root])).any():
            root[:] = up


def _all_pairs(sig: np.ndarray, end: np.ndarray, rows: np.ndarray, max_bits: int) -> np.ndarray:
    """Links (row, root) among ``rows``, each compared with the following ones before its ``end``."""
    a, b = np.ascontiguousarray(sig[:, 0]), np.ascontiguousarray(sig[:, 1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    root, held, k = np.arange(len(sig)), 0, 1
    while len(rows := rows[rows + k < end[rows]]):
        half = np.bitwise_count(a[rows] ^ a[rows + k])
        some = np.flatnonzero(half <= max_bits)
        near = rows[some[half[some] + np.bitwise_count(b[rows[some]] ^ b[rows[some] + k]) <= max_bits]]
        found.append((near, near + k))
        held += len(near)
        k += 1
        if held > 4 * len(sig):
            _join_roots(root, *map(np.concatenate, zip(*found)))
            found, held = [], 0
    if found:
        _join_roots(root, *map(np.concatenate, zip(*found)))
    at = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([root[at], at], 1)


def _component(sig: np.ndarray, rest: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The links of the component of the first row of ``rest``, by breadth-first search, and the rows outside it."""
    links, todo, rest = [], [rest[0]], rest[1:]
    while todo and len(rest):
        at = todo.pop()
        near = _near(sig[rest], sig[at], max_bits)
        if near.any():
            new = rest[near]
            links.append(np.stack([np.full(len(new), at), new], 1))
            todo += list(new)
            rest = rest[~near]
    return links, rest


def _large(sig: np.ndarray, max_bits: int, depth: int) -> list[np.ndarray]:
    """Links among all of ``sig``, which share a key."""
    links: list[np.ndarray] = []
    rest = np.arange(len(sig))
    # Copies by the thousand: while an eighth of a key is near its first signature, that one's group is taken out.
    while len(rest) > PAIRS and 8 * np.count_nonzero(_near(sig[rest], sig[rest[0]], max_bits)) >= len(rest):
        more, rest = _component(sig, rest, max_bits)
        links += more
    if len(rest) > WIDE and depth < DEPTH:
        mine = sig[rest]
        bits = np.unpackbits(mine.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
        bits = bits[:, np.random.default_rng(depth).permutation(BITS)]
        for key in keys_of(np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)):
            links.append(rest[linked(key, mine, max_bits, depth + 1)])
        return links
    while len(rest):
        more, rest = _component(sig, rest, max_bits)
        links += more
    return links


def linked(key: np.ndarray, sig: np.ndarray, max_bits: int = MAX_BITS, depth: int = 0) -> np.ndarray:
    """Pairs of rows that join, within each key, what the pairs of at most ``max_bits`` differing bits join."""
    order = np.argsort(key, kind="stable")
    key, sig = key[order], sig[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(start, len(key)))
    end = np.repeat(start + size, size)
    links = [_all_pairs(sig, end, np.flatnonzero(np.repeat((size > 1) & (size <= PAIRS), size)), max_bits)]
    for at, n in zip(start[size > PAIRS], size[size > PAIRS]):
        links += [x + at for x in _large(sig[at : at + n], max_bits, depth)]
    return order[np.concatenate(links).reshape(-1, 2)]


def _match(max_bits: int):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        sig = np.stack([table.column(c).to_numpy() for c in ("a", "b")], 1).view(np.uint64)
        key = table.column("key").to_numpy()
        del table, batches
        links = linked(key, sig, max_bits)
        left, right = sig[links[:, 0]].view(np.int64), sig[links[:, 1]].view(np.int64)
        swap = (left[:, 0] > right[:, 0]) | ((left[:, 0] == right[:, 0]) & (left[:, 1] > right[:, 1]))
        left[swap], right[swap] = right[swap], left[swap].copy()
        both = np.unique(np.concatenate([left, right], 1), axis=0)
        for at in range(0, len(both), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[at : at + 100_000, i].copy()) for i in range(4)], names=["a1", "b1", "a2", "b2"])

    return match


def links(sigs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct links a1, b1, a2, b2 among distinct signatures ``a``, ``b`` (columns of a written table).

    They join exactly what the pairs of at most ``max_bits`` (MAX_BITS at most) differing bits join.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"{SEGMENTS} segments find pairs of up to {MAX_BITS} bits")
    spark = sigs.sparkSession
    n = sigs.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * BITS // TASK_ROWS))
    keyed = sigs.select("a", "b").mapInArrow(_variants, "key bigint, a bigint, b bigint")
    return keyed.repartition(parts, "key").mapInArrow(_match(max_bits), "a1 bigint, b1 bigint, a2 bigint, b2 bigint").distinct()


def groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """grp, doc_id, text_hash of the rows in groups of two or more, and kept_id, kept_hash of the row that stays."""
    narrow = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_")).where("text_ is not null")
    narrow = written(narrow.select("doc_id", F.xxhash64("text_").alias("text_hash"), signature(F.col("text_")).alias("sig")).select("doc_id", "text_hash", "sig.a", "sig.b"), "signatures")
    nodes = written(narrow.select("a", "b").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = links(nodes, max_bits)
    for u, a, b in (("u", "a1", "b1"), ("v", "a2", "b2")):
        ends = nodes.select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.col("node").alias(u))
        found = found.join(ends, (F.col(a) == F.col("a_")) & (F.col(b) == F.col("b_"))).drop("a_", "b_")
    joined = aligned_groups(found.select("u", "v"))
    named = nodes.join(joined.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select(F.col("a").alias("a_"), F.col("b").alias("b_"), F.coalesce("root", "node").alias("grp"))
    rows = narrow.join(named, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).select("doc_id", "text_hash", "grp")
    kept = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    return rows.join(kept, "grp").select("grp", "doc_id", "text_hash", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))


def duplicate_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, duplicate_of): every near-duplicate that goes, with the document of its group that stays."""
    pairs = groups(documents, id_col, text_col, max_bits).where("doc_id <> kept_id")
    return pairs.select("doc_id", F.col("kept_id").alias("duplicate_of")).distinct()


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one row of each group, and their own columns.

    One shuffle of the texts, by (doc_id, text hash): the rows that go are joined
    against and what repeats a row is dropped with the same partitioning.
    """
    key, nth = fresh(documents, "text_hash", "nth")
    gone = groups(documents, id_col, text_col, max_bits).where("not (doc_id <=> kept_id and text_hash = kept_hash)")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    docs = documents.withColumn(key, F.xxhash64(F.col(text_col))).alias("d")
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.gone_id")) & (F.col(f"d.{key}") == F.col("g.gone_hash"))
    left = docs.join(gone.alias("g"), same & F.col(f"d.{text_col}").isNotNull(), "left_anti")
    order = Window.partitionBy(id_col, key).orderBy(F.lit(1))
    kept = left.withColumn(nth, F.row_number().over(order)).where((F.col(nth) == 1) | F.col(text_col).isNull())
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
