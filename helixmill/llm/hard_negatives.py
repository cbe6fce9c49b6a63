"""Hard-negative mining over an STR-packed R-tree.

Building is Spark's sort-tile-recursive order: rows are range-partitioned by label and the coordinate that varies most,
then inside these slabs by the second, and sorted. Each task packs its run of rows into tiles, each cut
along the third coordinate into leaves, and writes them to a file of its own in the shared folder, with a node on top;
nodes are packed into nodes above them, Sizes.fan at a time, until few enough are left for a root.

A box holds the least and the largest value of each coordinate, so an anchor's inner product with all rows in it lies in
an interval. Search goes best first: a queue hands out the box with the largest upper end. For positives, a box goes
when its end lies strictly below the fifth best score (or equals it, with larger ids only) or the label is not inside.
For negatives, all windows of an anchor share one search; a box goes when it lies outside every window or strictly below
what a full window holds already. Anchors are dealt by range to tasks; a task reads nodes as it needs them and keeps
at most Sizes.held bytes of them, so neither memory nor what is sent to tasks grows with the table.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no part. Components are read as
integers and end at +-LARGEST, which keeps scores within 64 bits. A shorter vector has zeros where it ends. Each
repeated row counts as a row; rows that share the anchor's id are never its positives. Ties go to the smaller id. An
anchor without positives, or whose windows are empty, has no rows. Without rows there is no result.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._common import partitions, shared_dir, stage, table

SCALE, LARGEST = 256, 1 << 24
POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
#: Anchors of one searching task at 1000 executors' scale; fewer where the table is small.
ANCHORS = 512


@dataclass(frozen=True)
class Sizes:
    leaf: int = 256  # rows of a leaf, of a tile, and children of a node above tiles
    tile: int = 4096
    fan: int = 64
    file: int = 64 << 20  # bytes of vectors in one file
    held: int = 128 << 20  # bytes of nodes that a searching task keeps


VECTORS = "vec_id bigint, label bigint, q array<int>"
NODES = "file string, at bigint, size bigint, boxed binary, place bigint"
FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, q of the rows that take part: each component x as floor(SCALE * x)."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q"))


@dataclass
class Shape:
    rows: int
    width: int
    axes: list[int]  # coordinates by how much they vary
    exact: bool  # whether doubles hold every score


def shape_of(vectors: DataFrame) -> Shape:
    """One pass: each task sends sums for each coordinate."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((0, 3))
        for batch in batches:
            q = matrix(batch.column("q"), 0).astype(float)
            if q.shape[1] > len(total):
                total = np.concatenate([total, np.zeros((q.shape[1] - len(total), 3))])
            n += len(q)
            total[: q.shape[1]] += np.stack([q.sum(0), (q * q).sum(0), np.zeros(q.shape[1])], 1)
            total[: q.shape[1], 2] = np.maximum(total[: q.shape[1], 2], np.abs(q).max(0, initial=0))
        yield pa.record_batch([pa.array(np.arange(-1, len(total))), *(pa.array(np.append(float(n), total[:, k])) for k in range(3))], ["c", "s", "ss", "top"])

    found = vectors.mapInArrow(sums, "c bigint, s double, ss double, top double").groupBy("c").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.max("top").alias("top")).collect()  # one row a coordinate
    n = max([0, *(int(r.s) for r in found if r.c < 0)])
    by_spread = sorted((r for r in found if r.c >= 0), key=lambda r: (-(r.ss / max(n, 1) - (r.s / max(n, 1)) ** 2), r.c))
    top = max([0, *(int(r.top) for r in by_spread)])
    return Shape(n, len(by_spread), [r.c for r in by_spread], top * top * len(by_spread) < 1 << 53)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of at least so many columns, zeros where a list ends."""
    sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def boxes(starts: np.ndarray, ids: np.ndarray, labels: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """Boxes around runs of rows (or of boxes) that begin at starts."""
    least, most = np.minimum.reduceat, np.maximum.reduceat
    return {"first": least(ids, starts), "low": least(labels[0], starts), "high": most(labels[1], starts), "lo": least(lo, starts, axis=0), "hi": most(hi, starts, axis=0)}


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Bytes of a node; unpacked() of them costs little, which counts where a search opens many small nodes."""
    return pickle.dumps(arrays, 5)


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(blob)


class NodeFile:
    """A file of tree nodes that one task writes. Its name is new in each attempt, so attempts never meet."""

    def __init__(self, folder: str):
        self.store, top = fs.FileSystem.from_uri(folder)
        self.store.create_dir(top, recursive=True)
        self.name, self.at = uuid.uuid4().hex, 0
        self.out = self.store.open_output_stream(f"{top}/{self.name}", compression=None)

    def put(self, arrays: dict[str, np.ndarray]) -> tuple[int, int]:
        blob = packed(arrays)
        self.out.write(blob)
        self.at += len(blob)
        return self.at - len(blob), len(blob)

    def node(self, children: list[tuple[str, int, int, dict]], place: int) -> tuple:
        """Write a node over children (file, at, size, box); the row that stands for it one level up."""
        joined = {k: np.concatenate([c[3][k] for c in children]) for k in children[0][3]}
        at, size = self.put(joined | {"name": np.array([c[0] for c in children]), "at": np.array([c[1] for c in children]), "size": np.array([c[2] for c in children])})
        around = boxes(np.zeros(1, np.int64), joined["first"], (joined["low"], joined["high"]), joined["lo"], joined["hi"])
        return self.name, at, size, packed(around), place


def node_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "at", "size", "boxed", "place"])


def tile_packer(folder: str, width: int, third: int | None, sizes: Sizes):
    """Task that packs rows, as they come, into tiles and nodes over them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, n, children, done = None, [], 0, [], []
        place = TaskContext.get().partitionId() << 32

        def tile(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            ids, labels, q = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((ids, q[:, third])) if third is not None else np.argsort(ids)
            ids, labels, q = ids[order], labels[order], q[order]
            leaves = boxes(np.arange(0, len(ids), sizes.leaf), ids, (labels, labels), q, q)
            around = boxes(np.zeros(1, np.int64), ids, (labels, labels), q, q)
            children.append((out.name, *out.put(leaves | {"ids": ids, "labels": labels, "q": q}), around))

        for batch in batches:
            rows = (batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("q"), width))
            at = 0
            while at < batch.num_rows:
                out = out or NodeFile(folder)
                took = min(sizes.tile - n, batch.num_rows - at)
                held.append(tuple(x[at : at + took] for x in rows))
                n, at = n + took, at + took
                if n == sizes.tile:
                    tile(held)
                    held, n = [], 0
                if len(children) == sizes.fan:
                    done.append(out.node(children, place + len(done)))
                    children.clear()
        if held:
            tile(held)
        if children:
            done.append(out.node(children, place + len(done)))
        if out:
            out.out.close()
            yield node_rows(done)

    return run


def node_packer(folder: str, fan: int):
    """Task that packs a fixed number of nodes at a time, in order, into nodes above them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, children, done, place = NodeFile(folder), [], [], TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in batch.to_pylist():
                children.append((row["file"], row["at"], row["size"], unpacked(row["boxed"])))
                if len(children) == fan:
                    done.append(out.node(children, place + len(done)))
                    children = []
        if children:
            done.append(out.node(children, place + len(done)))
        out.out.close()
        if done:
            yield node_rows(done)

    return run


@dataclass
class Tree:
    folder: str
    shape: Shape
    sizes: Sizes
    root: list[tuple]  # at most sizes.fan nodes


def build(vectors: DataFrame, sizes: Sizes = Sizes()) -> Tree:
    """The tree over vec_id, label, q. Its files stay in the shared folder."""
    spark = vectors.sparkSession
    shape, folder = shape_of(vectors), shared_dir(spark)
    axis = lambda k: [F.coalesce(F.get("q", F.lit(shape.axes[k])), F.lit(0)).alias(f"c{k}")] if len(shape.axes) > k else []
    per_file = max(sizes.tile, sizes.file // (4 * max(shape.width, 1)))
    files = max(1, -(-shape.rows // per_file), min(partitions(spark), -(-shape.rows // sizes.tile)))
    slabs = math.isqrt(files - 1) + 1
    rows = vectors.repartitionByRange(slabs, "label", *axis(0), "vec_id").withColumn("slab", F.spark_partition_id())
    inner = [F.col("slab"), *axis(1), F.col("vec_id")]
    rows = rows.repartitionByRange(files, *inner).sortWithinPartitions(*inner)
    third = shape.axes[2] if shape.width > 2 else None
    nodes = stage(rows.select("vec_id", "label", "q").mapInArrow(tile_packer(folder, shape.width, third, sizes), NODES), "tiles")
    while (n := nodes.count()) > sizes.fan:
        level = nodes.coalesce(-(-n // sizes.fan**2)).sortWithinPartitions("place")  # each task packs many, so levels shrink
        nodes = stage(level.mapInArrow(node_packer(folder, sizes.fan), NODES), "nodes")
    return Tree(folder, shape, sizes, [tuple(r) for r in nodes.collect()])


class Boxes:
    def __init__(self, found: dict[str, np.ndarray], kind: type):
        self.first, self.low, self.high = found["first"], found["low"], found["high"]
        self.lo, self.hi = found["lo"].astype(kind), found["hi"].astype(kind)
        self.bytes = sum(x.nbytes for x in (self.first, self.low, self.high, self.lo, self.hi))
        self.refs = [(str(f), int(a), int(s)) for f, a, s in zip(found["name"], found["at"], found["size"], strict=True)] if "name" in found else None
        if self.refs is None:
            self.ids, self.labels, self.q = found["ids"], found["labels"], found["q"].astype(kind)
            self.bytes += self.ids.nbytes + self.labels.nbytes + self.q.nbytes

    def interval(self, plus: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product with an anchor, given its positive and negative components."""
        return self.lo @ plus + self.hi @ minus, self.hi @ plus + self.lo @ minus


class Best:
    """The best few rows inside one window of scores, ties by smaller id."""

    def __init__(self, most: int, low: float, high: float):
        self.most, self.low, self.high = most, low, high
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.ids) == self.most

    def wants(self, least: np.ndarray, most: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which boxes may hold a row that belongs here."""
        ok = (most >= self.low) & (least <= self.high)
        if self.full():
            end, kth = np.minimum(most, self.high), self.scores[-1]
            ok &= (end > kth) | ((end == kth) & (first < self.ids[-1]))
        return ok

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= (self.scores[-1] if self.full() else self.low)) & (scores <= self.high)
        if inside.any():
            s, i = np.append(self.scores, scores[inside]), np.append(self.ids, ids[inside])
            order = np.lexsort((i, -s))[: self.most]
            self.scores, self.ids = s[order], i[order]


class Searcher:
    def __init__(self, tree: Tree):
        self.tree, self.kind = tree, np.float64 if tree.shape.exact else np.int64
        self.store, self.top = fs.FileSystem.from_uri(tree.folder)
        self.held: OrderedDict[tuple, Boxes] = OrderedDict()
        self.bytes = 0
        around = [unpacked(r[3]) for r in tree.root]
        self.root = Boxes({k: np.concatenate([x[k] for x in around]) for k in around[0]} | {"name": [r[0] for r in tree.root], "at": [r[1] for r in tree.root], "size": [r[2] for r in tree.root]}, self.kind)

    def node(self, ref: tuple[str, int, int]) -> Boxes:
        if ref in self.held:
            self.held.move_to_end(ref)
            return self.held[ref]
        with self.store.open_input_file(f"{self.top}/{ref[0]}") as f:
            found = Boxes(unpacked(f.read_at(ref[2], ref[1])), self.kind)
        self.held[ref] = found
        self.bytes += found.bytes
        while self.bytes > self.tree.sizes.held and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1].bytes
        return found

    def search(self, q: np.ndarray, wanted: list[Best], boxed, rowed) -> None:
        """Best first. boxed(boxes): which of them hold a row of a right label; rowed(labels, ids): which rows are."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        queue, count = [], 0

        def push(node: Boxes, ref: tuple | None) -> None:
            nonlocal count
            least, most = node.interval(plus, minus)
            ok = np.logical_or.reduce([b.wants(least, most, node.first) for b in wanted]) & boxed(node)
            for k in np.flatnonzero(ok).tolist():
                heapq.heappush(queue, (-most[k], int(node.first[k]), count, least[k], node.refs[k] if ref is None else (ref, k)))
                count += 1

        push(self.root, None)
        while queue:
            end, first, _, least, ref = heapq.heappop(queue)
            if all(b.full() and -end < b.scores[-1] for b in wanted):
                break
            if not any(b.wants(least, -end, first) for b in wanted):
                continue
            if len(ref) == 3:
                node = self.node(ref)
                push(node, ref if node.refs is None else None)
                continue
            tile, k = self.node(ref[0]), ref[1]
            part = slice(k * self.tree.sizes.leaf, (k + 1) * self.tree.sizes.leaf)
            ok = rowed(tile.labels[part], tile.ids[part])
            scores, ids = (tile.q[part] @ q)[ok], tile.ids[part][ok]
            for b in wanted:
                b.take(scores, ids)

    def mine(self, anchor: int, label: int, q: np.ndarray) -> list[tuple]:
        inf = float("inf")
        near = Best(POSITIVES, -inf, inf)
        self.search(q, [near], lambda n: (n.low <= label) & (n.high >= label), lambda labels, ids: (labels == label) & (ids != anchor))
        ends = [int(s) for s in near.scores]
        windows = {s: Best(NEGATIVES, -(-PERCENT * s // 100), s) for s in ends if s >= 0}  # below zero a window is empty
        if windows:
            self.search(q, list(windows.values()), lambda n: (n.low != label) | (n.high != label), lambda labels, ids: labels != label)
        return [(anchor, int(p), k + 1, int(i), s, int(v)) for p, s in zip(near.ids, ends, strict=True) if s in windows for k, (i, v) in enumerate(zip(windows[s].ids, windows[s].scores, strict=True))]


def miner(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = None
        for batch in batches:
            searcher = searcher or Searcher(tree)
            q = matrix(batch.column("q"), tree.shape.width).astype(searcher.kind)
            for anchor, label, row in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), q, strict=True):
                found = searcher.mine(anchor, label, row)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, sizes: Sizes = Sizes()) -> DataFrame:
    """vectors (vec_id, label, q) -> FOUND: for each anchor and positive, the best rows of other labels in the window."""
    spark = vectors.sparkSession
    tree = build(vectors, sizes)
    if not tree.root:
        return spark.createDataFrame([], FOUND)
    axis = [F.get("q", F.lit(c)) for c in tree.shape.axes[:1]]
    anchors = vectors.where(is_anchor)
    n = anchors.count()
    return anchors.repartitionByRange(max(1, -(-n // ANCHORS), min(n, 4 * partitions(spark))), "label", *axis, "vec_id").mapInArrow(miner(tree), FOUND)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    wrong = F.col("vec_id") % 7 == 0
    vectors = vectors.withColumn("label", F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


SQL = {
    "op11_hard_negatives": r"""
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(greatest(least(floor(256 * CAST(x AS DOUBLE)), 16777216), -16777216) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rn, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rn <> b.rn),
p AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS k FROM s WHERE same AND vec_id <> anchor_id QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.rn, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.rn = p.rn AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
""",
}
