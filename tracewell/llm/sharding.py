"""Shards of about equal bytes by a k-d tree over metadata.

A node that holds more than the target bytes is split along its widest metadata
dimension, at the weighted median of that dimension: the least value below which,
itself included, lies half of the node's bytes (the value before it if it is the
greatest).  Width is measured against the width over all documents; of equally
wide dimensions the first named is taken.  All nodes of a level are split at once.

Medians are exact.  Nodes of more than ``FINISH_ROWS`` documents find theirs without
sorting or moving rows: each pass sums bytes in equal slots over all such nodes, inside
the tasks, and the slot with the median becomes the next pass's range.  Once a node has
fewer documents, their metadata (five longs a document, no text) go to one task, which
splits the node down to its leaves.  So passes over the metadata grow with the logarithm
of its rows over FINISH_ROWS, the metadata are shuffled once, and no task gets more than
FINISH_ROWS of them.  The driver holds the tree and one pass's sums, both bounded by the
number of shards, of large nodes and SLOTS, never rows.

Numbers count exactly: floating ones by their bits in order, decimals of up to 18 digits
unscaled.  Text dimensions count by their first seven bytes where these tell all values of
the column apart, else by the rank of the whole value among the column's distinct values,
in byte order, as wider decimals do by value: equal codes mean equal values.  Ranks are
found in range partitions and joined to the metadata; the assignment compares whole values
with those at the splits.

Defined results: a null in any dimension counts as -1, in floating ones as less than any
number (not-a-number is the greatest); a null or empty text has 0 bytes; a node whose
documents agree in all dimensions stays whole above the target (so does a single document);
rows that repeat land in one shard; an empty table gives an empty result; without
dimensions all is one shard; other columns pass through under any name.  Shards are
numbered from 0 in tree order.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.plans.lineage import drop_written, fresh, written
from tracewell.plans.sequence import running_sum

TARGET_BYTES = 32 << 20
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
#: Sums of one pass, over all nodes, and the least for each node.
SLOTS = 1 << 16
NODE_SLOTS = 64
#: Documents of a node that one task splits down to its leaves.
FINISH_ROWS = 1 << 20


@dataclass
class Tree:
    """Splits by node: dimension (-1 for a leaf) and value; a row goes left if its value is at most that."""

    dim: array = field(default_factory=lambda: array("h", [-1]))
    value: array = field(default_factory=lambda: array("q", [0]))
    left: array = field(default_factory=lambda: array("i", [-1]))

    def split(self, node: int, dim: int, value: int) -> tuple[int, int]:
        at = len(self.dim)
        self.dim[node], self.value[node], self.left[node] = dim, value, at
        self.dim.extend((-1, -1))
        self.value.extend((0, 0))
        self.left.extend((-1, -1))
        return at, at + 1

    def grow(self, node: int, dims: np.ndarray, values: np.ndarray) -> None:
        """Put the subtree of :func:`subtree` under a leaf."""
        todo, cuts = [node], iter(values.tolist())
        for dim in dims.tolist():
            node = todo.pop()
            if dim >= 0:
                left, right = self.split(node, dim, next(cuts))
                todo += [right, left]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.dim, np.int16), np.array(self.value, np.int64), np.array(self.left, np.int32)

    def leaves(self) -> np.ndarray:
        """For each node its number among the leaves in tree order, -1 for the others."""
        out, stack, n = np.full(len(self.dim), -1, np.int64), [0], 0
        while stack:
            node = stack.pop()
            if self.dim[node] < 0:
                out[node] = n
                n += 1
            else:
                stack += [self.left[node] + 1, self.left[node]]
        return out


def descend(tree: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    """The leaf node of each row of ``values`` (dimensions, rows)."""
    dim, value, left = tree
    node = np.zeros(values.shape[1], np.int64)
    live = np.arange(values.shape[1])
    while len(live := live[dim[node[live]] >= 0]):
        at = node[live]
        node[live] = left[at] + (values[dim[at], live] > value[at])
    return node


def _in_order(values: pa.Array) -> np.ndarray:
    """Floating numbers as longs in the same order; null as the least."""
    plain = np.asarray(values.cast(pa.float64()).fill_null(0.0)) + 0.0
    bits = np.where(np.isnan(plain), np.nan, plain).view(np.int64)
    bits = bits ^ ((bits >> 63) & np.int64(2**63 - 1))
    return np.where(np.asarray(values.is_null()), np.int64(-(2**63)), bits)


def _floating(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(_in_order(batch))


def _by_rank(kind: str) -> bool:
    """Whether a type's values have no code of their own, so that ranks may be needed."""
    return kind == "string" or (kind.startswith("decimal") and int(kind[8:].split(",")[0]) > 18)


def code(column: Column, kind: str) -> Column:
    """A dimension as a long that keeps its order; of texts the beginning, of wide decimals nothing but null."""
    if kind == "string":
        bytes_ = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0")
        column = F.conv(bytes_, 16, 10)
    elif kind in ("timestamp", "date", "timestamp_ntz"):
        column = F.unix_micros(column.cast("timestamp"))
    elif kind in ("double", "float"):
        column = F.arrow_udf(_floating, "bigint")(column)
    elif _by_rank(kind):
        column = F.when(column.isNotNull(), F.lit(0))
    elif kind.startswith("decimal"):
        column = column * F.lit(10 ** int(kind[8:-1].split(",")[1])).cast("decimal(19,0)")
    return F.coalesce(column.cast("bigint"), F.lit(-1).cast("bigint"))


def _values(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(i)) for i in range(n)]) if n else np.zeros((0, batch.num_rows), np.int64)


def _stats(tree, n: int):
    """Per open node: bytes, rows, and least and greatest value of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = tree.value
        size = len(splits[0])
        total, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
        low, high = np.full((n, size), np.iinfo(np.int64).max), np.full((n, size), np.iinfo(np.int64).min)
        for batch in batches:
            values = _values(batch, n)
            node = descend(splits, values)
            np.add.at(total, node, np.asarray(batch.column(n)))
            count += np.bincount(node, minlength=size)
            for d in range(n):
                np.minimum.at(low[d], node, values[d])
                np.maximum.at(high[d], node, values[d])
        at = np.flatnonzero(count)
        columns = [at, total[at], count[at], *[x[d][at] for d in range(n) for x in (low, high)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "bytes", "n", *[f"{x}{d}" for d in range(n) for x in ("low", "high")]])

    return run


def _histogram(shared, n: int):
    """Bytes by node and slot of the node's present range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, nodes, dims, lows, widths, slots = shared.value
        place = np.full(len(splits[0]), -1)
        place[nodes] = np.arange(len(nodes))
        sums = np.zeros(len(nodes) * slots, np.int64)
        for batch in batches:
            values = _values(batch, n)
            mine = place[descend(splits, values)]
            rows = np.flatnonzero(mine >= 0)
            mine = mine[rows]
            v = values[dims[mine], rows]
            slot = (v.view(np.uint64) - lows[mine].view(np.uint64)) // widths[mine]
            inside = (v >= lows[mine]) & (slot < np.uint64(slots))
            np.add.at(sums, (mine[inside] * slots + slot[inside].astype(np.int64)), np.asarray(batch.column(n))[rows[inside]])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["slot", "bytes"])

    return run


def widest(low: list[int], high: list[int], root: list[int]) -> int | None:
    """The widest dimension against ``root``, the first of equals; None if all agree."""
    span = [h - x for x, h in zip(low, high)]
    return max(range(len(span)), key=lambda d: (span[d] / root[d], -d)) if any(span) else None


def subtree(values: np.ndarray, size: np.ndarray, root: list[int], target: int) -> tuple[list[int], list[int]]:
    """Dimensions (-1 for a leaf) of the nodes below one node, in tree order, and the values at its splits in that order."""
    dims: list[int] = []
    cuts: list[int] = []
    todo = [np.arange(values.shape[1])]
    while todo:
        at = todo.pop()
        own, total = values[:, at], int(size[at].sum())
        high = own.max(1).tolist()
        dim = widest(own.min(1).tolist(), high, root) if total > target else None
        if dim is None:
            dims.append(-1)
            continue
        order = np.argsort(own[dim], kind="stable")
        median = int(own[dim][order[np.searchsorted(2 * np.cumsum(size[at][order]), total)]])
        cut = median - 1 if median == high[dim] else median
        dims.append(dim)
        cuts.append(cut)
        left = own[dim] <= cut
        todo += [at[~left], at[left]]
    return dims, cuts


def _tagged(shared, n: int):
    """The rows of the nodes that tasks finish, with their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, nodes = shared.value
        wanted = np.zeros(len(splits[0]), bool)
        wanted[nodes] = True
        for batch in batches:
            node = descend(splits, _values(batch, n))
            some = pa.array(np.flatnonzero(wanted[node]))
            yield pa.RecordBatch.from_arrays([pa.array(node).take(some), *[c.take(some) for c in batch.columns]], names=["node", *batch.schema.names])

    return run


def _finish(rows: DataFrame, n: int, tree: Tree, nodes: list[int], root: list[int], target: int) -> None:
    """Split each of ``nodes`` down to its leaves in one task, and put what comes out under it."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((tree.arrays(), np.array(nodes)))

    def below(table: pa.Table) -> pa.Table:
        columns = [table.column(i).to_numpy() for i in range(1, n + 2)]
        dims, cuts = subtree(np.stack(columns[:n]), columns[n], root, target)
        return pa.table({"node": table.column(0)[:1], "dims": pa.array([dims], pa.list_(pa.int16())), "cuts": pa.array([cuts], pa.list_(pa.int64()))})

    names = ", ".join(f"`{c}` bigint" for c in ("node", *rows.columns))
    found = rows.mapInArrow(_tagged(shared, n), names).groupBy("node").applyInArrow(below, "node bigint, dims array<smallint>, cuts array<bigint>").toArrow()
    for node, dims, cuts in sorted(zip(found.column("node").to_pylist(), *[[x.values.to_numpy() for x in found.column(c)] for c in ("dims", "cuts")]), key=lambda x: x[0]):
        tree.grow(node, dims, cuts)
    shared.unpersist()


def _medians(rows: DataFrame, n: int, tree: Tree, splits: list[list]) -> list[int]:
    """The weighted median of each of ``splits``: node, dimension, least and greatest value, bytes."""
    sc = rows.sparkSession.sparkContext
    nodes, dims, sizes = (np.array([s[i] for s in splits], np.int64) for i in (0, 1, 4))
    low, high, below = [s[2] for s in splits], [s[3] for s in splits], np.zeros(len(splits), np.int64)
    todo = list(range(len(splits)))
    while todo:
        slots = max(NODE_SLOTS, SLOTS // len(todo))
        widths = [-(-(high[i] - low[i] + 1) // slots) for i in todo]
        shared = sc.broadcast((tree.arrays(), nodes[todo], dims[todo], np.array([low[i] for i in todo], np.int64), np.array(widths, np.uint64), slots))
        table = rows.mapInArrow(_histogram(shared, n), "slot bigint, bytes bigint").groupBy("slot").agg(F.sum("bytes").alias("bytes")).toArrow()
        shared.unpersist()
        place, size = (table.column(c).to_numpy() for c in ("slot", "bytes"))
        order = np.argsort(place)
        place, size = place[order], size[order]
        first = np.searchsorted(place, np.arange(len(todo) + 1) * slots)
        total = np.concatenate(([0], np.cumsum(size)))
        for k, i in enumerate(todo):
            sums = total[first[k] : first[k + 1] + 1] - total[first[k]] + below[i]
            at = int(np.searchsorted(2 * sums[1:], sizes[i]))
            slot = int(place[first[k] + at]) - k * slots
            low[i], high[i], below[i] = low[i] + slot * widths[k], min(high[i], low[i] + (slot + 1) * widths[k] - 1), sums[at]
        todo = [i for i in todo if high[i] > low[i]]
    return low


def build(rows: DataFrame, n: int, target: int) -> Tree:
    """The tree over ``rows``: ``n`` long columns and the bytes."""
    spark = rows.sparkSession
    tree, root = Tree(), None
    open_nodes, finish = {0}, []
    stat_type = ", ".join(["node bigint", "bytes bigint", "n bigint", *[f"{x}{d} bigint" for d in range(n) for x in ("low", "high")]])
    while open_nodes:
        shared = spark.sparkContext.broadcast(tree.arrays())
        part = rows.mapInArrow(_stats(shared, n), stat_type)
        wanted = [*[F.sum(c).alias(c) for c in ("bytes", "n")], *[F.min(f"low{d}").alias(f"low{d}") for d in range(n)], *[F.max(f"high{d}").alias(f"high{d}") for d in range(n)]]
        found = part.groupBy("node").agg(*wanted).where(F.col("bytes") > target if root else F.lit(True)).collect()
        shared.unpersist()
        splits = []
        for row in sorted(found):
            if row["node"] not in open_nodes:
                continue
            low, high = ([row[f"{x}{d}"] for d in range(n)] for x in ("low", "high"))
            root = root or [max(1, h - x) for x, h in zip(low, high)]
            if row["bytes"] > target and (dim := widest(low, high, root)) is not None:
                if row["n"] <= FINISH_ROWS:
                    finish.append(row["node"])
                else:
                    splits.append([row["node"], dim, low[dim], high[dim], row["bytes"]])
        open_nodes = set()
        for (node, dim, _, high, _), value in zip(splits, _medians(rows, n, tree, splits)):
            open_nodes.update(tree.split(node, dim, value - 1 if value == high else value))
    if finish:
        _finish(rows, n, tree, finish, root, target)
    return tree


def _ranks(narrow: DataFrame, i: int) -> DataFrame | None:
    """v, rank (from 0) of the distinct values of text dimension ``i``, if its codes do not tell them apart."""
    values = narrow.select(F.col(f"v{i}").alias("v"), F.col(f"d{i}").alias("d")).where("v is not null").distinct()
    if values.groupBy("d").count().where("count > 1").isEmpty():
        return None
    ranked = running_sum(values.select("v", F.lit(0).alias("g"), F.lit(1).alias("one")), "g", ["v"], "one", "rank", "values")
    return written(ranked.select("v", (F.col("rank") - 1).alias("rank")), "ranks")


def _bounds(tree: Tree, i: int, ranks: DataFrame) -> list:
    """The values at the splits of dimension ``i`` in order; the tree's ranks become places among them (null stays -1)."""
    nodes = [k for k, d in enumerate(tree.dim) if d == i and tree.value[k] >= 0]
    wanted = ranks.sparkSession.createDataFrame([(r,) for r in sorted({tree.value[k] for k in nodes})], "r_ bigint")
    found = sorted((r["rank"], bytes(r["v"]) if isinstance(r["v"], bytearray) else r["v"]) for r in ranks.join(wanted, F.col("rank") == F.col("r_")).collect())
    place = {rank: at for at, (rank, _) in enumerate(found)}
    for k in nodes:
        tree.value[k] = place[tree.value[k]]
    return [value for _, value in found]


def _places(array: pa.Array, bounds: list) -> np.ndarray:
    """How many of ``bounds`` lie below each value; -1 for null."""
    words = array.dictionary_encode()
    at = np.array([*(bisect_left(bounds, w) for w in words.dictionary.to_pylist()), -1], np.int64)
    return at[np.asarray(words.indices.fill_null(-1))]


def _assign(shared):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        splits, leaves, bounds = shared.value
        for arrays in batches:
            values = np.stack([_places(a, bounds[i]) if i in bounds else np.asarray(a) for i, a in enumerate(arrays)])
            yield pa.array(leaves[descend(splits, values)])

    return run


def shard(documents: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, target_bytes: int = TARGET_BYTES, text_col: str = "text") -> Column:
    """The shard of each document. Builds the tree when called; assigning moves no row."""
    if not dimensions:
        return F.lit(0).cast("bigint")
    kinds = dict(documents.dtypes)
    codes = [code(F.col(f"`{d}`"), kinds[d]) for d in dimensions]
    whole = {i: F.col(f"`{d}`").cast("binary") if kinds[d] == "string" else F.col(f"`{d}`") for i, d in enumerate(dimensions) if _by_rank(kinds[d])}
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("bytes")
    narrow = written(documents.select(*[c.alias(f"d{i}") for i, c in enumerate(codes)], size, *[v.alias(f"v{i}") for i, v in whole.items()]), "metadata")
    ranks = {i: r for i in whole if (r := _ranks(narrow, i)) is not None}
    columns = [*[f"d{i}" for i in range(len(codes))], "bytes"]
    rows = narrow
    for i, r in ranks.items():
        rows = rows.join(r.select(F.col("v").alias("v_"), F.col("rank").alias("rank_")), F.col(f"v{i}") == F.col("v_"), "left")
        rows = rows.withColumn(f"d{i}", F.coalesce(F.col("rank_"), F.lit(-1)).cast("bigint")).drop("v_", "rank_")
    if ranks:
        coded = written(rows.select(*columns), "metadata")
        drop_written(narrow)
        narrow = coded
    tree = build(narrow.select(*columns), len(codes), target_bytes)
    drop_written(narrow)
    bounds = {i: _bounds(tree, i, r) for i, r in ranks.items()}
    for r in ranks.values():
        drop_written(r)
    shared = documents.sparkSession.sparkContext.broadcast((tree.arrays(), tree.leaves(), bounds))
    # A function of one column would get arrays instead of tuples; the last one is never split on.
    return F.arrow_udf(_assign(shared), "bigint").asNondeterministic()(*[whole[i] if i in ranks else c for i, c in enumerate(codes)], F.lit(0).cast("bigint"))


def shards(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, shard_id of every document."""
    found = shard(documents, text_col=text_col, **options)
    return documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).alias("n_bytes"), found.alias("shard_id"))


def with_shard(documents: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with their columns and a last one, ``shard_id`` (with a sign added if that name is taken)."""
    (name,) = fresh(documents, "shard_id")
    return documents.withColumn(name, shard(documents, text_col=text_col, **options))
