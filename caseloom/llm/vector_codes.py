"""Compression of vectors to short codes: one codebook for each part of a vector, found by the filtering form of Lloyd's rounds.

Vectors are cut into equal consecutive parts.  Every task packs its vectors into
chunks and builds a kd-tree over each part of a chunk, once; a node keeps its
bounding box, and the sum and count of what is below it.  In a round the
candidates of a node are the entries that may be nearest to some point of its
box: entries that another one beats in every corner are dropped, and where one is
left the whole subtree is its own, by the node's sum and count.  Sums are added
up by Spark; what reaches the driver are the codebooks, ``entries`` times the
dimension.  All arithmetic is on integers, so the result is the same however the
rows are dealt.

Null vectors and vectors with a null or non-finite component are dropped, and so
are vectors of another length than the first one's.  A length that the parts
don't divide is filled up with zeros.  A component beyond ``LARGEST`` after
scaling counts as that.  Null ids are kept and stand behind all others; rows of
one id are ordered by their vectors and each count.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import OUT_ROWS, arrow_batches, table, to_batch

#: Vectors in one chunk, and points in a leaf of its trees.
CHUNK, LEAF = 4096, 32
#: Chunks in one Arrow batch.
BATCH = 4
#: The largest scaled component: squared distances of some thousand components stay below 2**63.
LARGEST = 1 << 24
#: Below this, sums of squares are exact as doubles too.
EXACT = 1 << 53


class Tree:
    """A kd-tree over the rows of ``points``, which it holds in the order of its leaves."""

    FIELDS = ("points", "order", "start", "stop", "left", "right", "low", "high", "total")

    def __init__(self, *arrays: np.ndarray):
        for name, a in zip(self.FIELDS, arrays):
            setattr(self, name, a)

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points), dtype=np.int32)
        nodes: list[list[int]] = []  # start, stop, left, right
        boxes, totals = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            at = len(nodes)
            nodes.append([a, b, -1, -1])
            boxes.append((low, high))
            totals.append(own.sum(axis=0, dtype=np.int64))
            if parent >= 0:
                nodes[parent][2 + side] = at
            wide = int(np.argmax(high - low)) if len(low) else 0
            if b - a > leaf and len(low) and high[wide] > low[wide]:
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide], middle)]
                todo += [(a, a + middle, at, 0), (a + middle, b, at, 1)]
        n = np.array(nodes, np.int32).reshape(-1, 4)
        low, high = (np.array([x[k] for x in boxes], np.int32) for k in (0, 1))
        return cls(points[order], order, *n.T, low, high, np.array(totals, np.int64))

    def dump(self) -> bytes:
        out = io.BytesIO()
        for name in self.FIELDS:
            np.save(out, getattr(self, name), allow_pickle=False)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        source = io.BytesIO(data)
        return cls(*(np.load(source, allow_pickle=False) for _ in cls.FIELDS))

    def filtered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the nearest of ``entries``, ties to the lower index: each point's (in the tree's order), and each entry's sum and count."""
        width = self.points.shape[1]
        most = max(int(np.abs(entries).max(initial=0)), int(np.abs(self.low).max(initial=0)), int(np.abs(self.high).max(initial=0)))
        # Doubles hold these integers exactly, and are multiplied faster.
        kind = np.float64 if 16 * width * most * most < EXACT else np.int64
        z, points, low, high = (x.astype(kind) for x in (entries, self.points, self.low, self.high))
        norms = (z * z).sum(axis=1)
        found = np.zeros(len(points), np.int32)
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        todo = [(0, np.arange(len(entries)))]
        while todo:
            at, able = todo.pop()
            a, b = int(self.start[at]), int(self.stop[at])
            if len(able) > 1 and self.left[at] < 0 and b - a <= LEAF:
                near = able[np.argmin(norms[able] - 2 * (points[a:b] @ z[able].T), axis=1)]
                found[a:b] = near
                np.add.at(sums, near, self.points[a:b])
                counts += np.bincount(near, minlength=len(entries))
                continue
            if len(able) > 1:
                own = z[able]
                best = int(np.argmin(((2 * own - (low[at] + high[at])) ** 2).sum(axis=1)))
                # The corner that suits an entry most, seen from the best one.
                corner = np.where(own > own[best], high[at], low[at])
                more = ((own - corner) ** 2).sum(axis=1) - ((own[best] - corner) ** 2).sum(axis=1)
                stays = (more < 0) | ((more == 0) & (able < able[best]))
                stays[best] = True
                able = able[stays]
            if len(able) == 1:
                found[a:b] = able[0]
                sums[able[0]] += self.total[at]
                counts[able[0]] += b - a
            else:
                todo += [(int(self.left[at]), able), (int(self.right[at]), able)]
        return found, sums, counts


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, v``: the kept rows with their components as integers."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    limit = F.lit(LARGEST).cast("long")
    floor = lambda c: F.greatest(F.least(F.floor(c * F.lit(float(scale))), limit), -limit).cast("int")
    return vectors.where(F.col("embedding").isNotNull() & whole).select("vec_id", "label", F.transform(x, floor).alias("v"))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every kept row of ``vec_id, embedding, label``."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits: at most 256 entries")
    spark = vectors.sparkSession
    kept = scaled(vectors, scale)
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    id_type, label_type = (vectors.schema[n].dataType for n in ("vec_id", "label"))
    result = T.StructType(
        [
            T.StructField("vec_id", id_type),
            *(T.StructField(n, k) for n, k in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))),
        ]
    )
    if not first:
        return spark.createDataFrame([], result)
    dim = len(first[0])
    if any(len(v) != dim for v in first):  # the first entries come from vectors of one length alone
        first = [r.v for r in kept.where(F.size("v") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    width = -(-dim // parts)
    books = _cut(np.array(first, np.int64).reshape(len(first), dim), parts, width)
    chunked = T.StructType(
        [T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("trees", T.ArrayType(T.BinaryType()))]
    )
    with arrow_batches(spark, chunk):
        trees = table(kept.where(F.size("v") == dim).mapInArrow(_planter(parts, width, dim, chunk, chunked), chunked), "vector-trees")
    with arrow_batches(spark, BATCH):
        for _ in range(rounds):
            sums = trees.select("trees").mapInArrow(_summer(books), "part int, entry int, place int, total long, n long")
            sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
            books = [b.copy() for b in books]
            for r in sums.collect():  # entries times the dimension, whatever the number of vectors
                books[r.part][r.entry, r.place] = int(r.total) // r.n
        own = T.StructType([result["vec_id"], T.StructField("label", label_type), result["code"], result["error"]])
        coded = table(trees.mapInArrow(_coder(books, own), own), "vector-codes")
    # Labels may be as many as rows or as few as one: both sides are stored, so that Spark knows their sizes and splits a hot label.
    by_label = table(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "vector-label-errors")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _cut(rows: np.ndarray, parts: int, width: int) -> list[np.ndarray]:
    """The parts of the rows, filled up with zeros."""
    full = np.zeros((len(rows), parts * width), rows.dtype)
    full[:, : rows.shape[1]] = rows
    return [full[:, k * width : (k + 1) * width] for k in range(parts)]


def _planter(parts: int, width: int, dim: int, chunk: int, schema: T.StructType):
    """Rows to chunks: their ids and labels, and a tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []

        def chunk_of(rows: pa.Table) -> pa.RecordBatch:
            flat = rows.column("v").combine_chunks()
            v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(rows.num_rows, dim)
            trees = [Tree.of(p).dump() for p in _cut(v, parts, width)]
            lists = [pa.array([rows.column(n).to_pylist()], f.type) for n, f in zip(("vec_id", "label"), arrow)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], arrow.field("trees").type)], schema=arrow)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= chunk:
                rows = pa.Table.from_batches(held)
                yield chunk_of(rows.slice(0, chunk))
                held = rows.slice(chunk).to_batches()
        if sum(b.num_rows for b in held):
            yield chunk_of(pa.Table.from_batches(held))

    return run


def _summer(books: list[np.ndarray]):
    """The entries' sums and counts over all chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for row in batch.column("trees"):
                for k, data in enumerate(row):
                    _, s, n = Tree.load(data.as_py()).filtered(books[k])
                    sums[k] += s
                    counts[k] += n
        for k, (s, n) in enumerate(zip(sums, counts)):
            used = np.flatnonzero(n)
            width = s.shape[1]
            columns = (np.full(len(used) * width, k, np.int32), np.repeat(used, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(used)), s[used].ravel(), np.repeat(n[used], width))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "place", "total", "n"])

    return run


def _coder(books: list[np.ndarray], schema: T.StructType):
    """Chunks to rows with their codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(n) for n in ("ids", "labels", "trees"))):
                n = len(ids)
                codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for k, data in enumerate(trees):
                    tree = Tree.load(data.as_py())
                    found, _, _ = tree.filtered(books[k])
                    codes[tree.order, k] = found
                    error[tree.order] += ((tree.points - books[k][found]) ** 2).sum(axis=1)
                rows = list(zip(ids.as_py(), labels.as_py(), (c.tobytes().hex() for c in codes), error.tolist()))
                for at in range(0, n, OUT_ROWS):
                    yield to_batch(rows[at : at + OUT_ROWS], arrow)

    return run
