"""Compression of vectors to short codes: product codebooks by Lloyd's rounds, filtered through kd-trees.

Vectors become integers and are cut into equal consecutive parts; each part position has a codebook. Every task
gathers its vectors in blocks and builds a kd-tree over each part of a block, once: a node knows the bounding box, the sum and the number
of its points. The trees are written to the shared folder and read by all rounds. In a round the entries of a codebook go down a
tree together: an entry goes no further where, for every point of the node's box, another entry of the node is nearer (or as near, with a smaller index).
A node with one entry left goes to it whole, by its sum; in leaves with several the points are weighed
one by one. All decisions are made in integers, so the result is that of plain rounds over all points.

What a round exchanges is the sums of one task: a number for each entry and component. The codebooks (entries x components
numbers) are the only thing the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 4096  # vectors of a tree
LEAF = 16  # points of a leaf, at most


def spans(dim: int, parts: int) -> list[slice]:
    """The components of each part; where dim can't be cut evenly, the first parts have one more."""
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(dim), parts)])
    return [slice(int(a), int(b)) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), held within what leaves squared distances of such vectors below 2^63."""
    most = 1 << ((62 - max(0, x.shape[1] - 1).bit_length()) // 2 - 1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x.astype(np.float64)), -most, most).astype(np.int64)


class Tree:
    """A kd-tree over points (n, d): levels of nodes, each the half of its parent along the widest side of its box."""

    def __init__(self, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.order, self.lo, self.hi, self.sums = order, lo, hi, sums
        self.depth = (len(lo) + 1).bit_length() - 2
        self.n = len(order)

    @classmethod
    def planted(cls, points: np.ndarray) -> Tree:
        n, depth = len(points), 0
        while n > LEAF << depth:
            depth += 1
        order, levels = np.arange(n), []
        for level in range(depth + 1):
            first = cls.starts(n, level)[:-1]
            x = points[order]
            lo, hi, sums = (f.reduceat(x, first, axis=0) for f in (np.minimum, np.maximum, np.add))
            levels.append((lo, hi, sums))
            if level < depth and points.shape[1]:
                node = np.repeat(np.arange(len(first)), np.diff(cls.starts(n, level)))
                order = order[np.lexsort((x[np.arange(n), (hi - lo).argmax(1)[node]], node))]
        return cls(order, *(np.concatenate(z) for z in zip(*levels, strict=True)))

    @staticmethod
    def starts(n: int, level: int) -> np.ndarray:
        """Where the nodes of a level begin in order; the level below halves each."""
        return (np.arange((1 << level) + 1) * n) >> level

    def assigned(self, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entry of each point, and each entry's sum and number of points."""
        k = len(book)
        entry, total, count = np.zeros(self.n, np.int64), np.zeros_like(book), np.zeros(k, np.int64)
        node, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        index = np.arange(k)
        for level in range(self.depth + 1):
            at, starts = (1 << level) - 1 + node, self.starts(self.n, level)
            lo, hi = self.lo[at], self.hi[at]
            # Any entry may stand for the nearest here; that nearest to the middle leaves the fewest.
            far = ((book[None] - (lo + hi)[:, None] / 2) ** 2).sum(2)
            best = np.where(left, far, np.inf).argmin(1)
            corner = np.where(book[None] > book[best][:, None], hi[:, None], lo[:, None])  # where the other entry does best
            behind = ((book[None] - corner) ** 2 - (book[best][:, None] - corner) ** 2).sum(2)
            left &= (behind < 0) | (behind == 0) & (index[None] <= best[:, None])
            alone = left.sum(1) == 1
            if alone.any():
                one, whole_ = left[alone].argmax(1), node[alone]
                sizes = starts[whole_ + 1] - starts[whole_]
                np.add.at(total, one, self.sums[at[alone]])
                np.add.at(count, one, sizes)
                entry[ranges(starts[whole_], sizes)] = np.repeat(one, sizes)
            node, left = node[~alone], left[~alone]
            if not len(node):
                break
            if level < self.depth:
                node, left = (2 * node[:, None] + np.arange(2)).ravel(), np.repeat(left, 2, axis=0)
                continue
            sizes = starts[node + 1] - starts[node]
            place = ranges(starts[node], sizes)
            x = points[self.order[place]]
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            d[~np.repeat(left, sizes, axis=0)] = np.iinfo(np.int64).max
            entry[place] = one = d.argmin(1)
            np.add.at(total, one, x)
            count += np.bincount(one, minlength=k)
        out = np.empty(self.n, np.int64)
        out[self.order] = entry
        return out, total, count


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of all ranges, one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def sound(vectors: DataFrame, vec_col: str) -> DataFrame:
    """vectors with v, array<double>, of the rows whose vector is not null and has no null or non-finite component."""
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # a NaN is larger than infinity
    return vectors.withColumn("v", F.col(vec_col).cast("array<double>")).filter(F.col("v").isNotNull() & fine)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped; zero vectors stay. Components become floor(scale * x), held within
    the range whose squared distances fit 64 bits. A codebook starts as the parts of the vectors of the smallest ids (equal ids: the smallest
    vector; null ids last), fewer where there are fewer vectors. Ties go to the smaller index; entries that no part takes stay as they are.
    label_error is the sum of error over equal labels, nulls together (null beyond 64 bits). Rows that repeat an id are
    coded each. Vectors of different lengths are coded apart, with codebooks of their own. An empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = sound(plain, "embedding").select("vec_id", "v", "label")
    lengths = [r[0] for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]  # one row for each length of vectors
    done = [coded(rows.filter(F.size("v") == dim), dim, parts, entries, rounds, scale) for dim in lengths]
    if not done:
        text = F.lit("").alias
        return rows.select("vec_id", "label", text("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), text("codebooks_sha256"))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    out = materialise(out, "codes")
    sums = out.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("string").try_cast("long").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def coded(rows: DataFrame, dim: int, parts: int, entries: int, rounds: int, scale: float) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of vectors of one length."""
    cuts = spans(dim, parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # bounded by entries
    start = whole(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim), scale)
    books = [start[:, c] for c in cuts]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                v = b.column("v").flatten().to_numpy(zero_copy_only=False)
                x = whole(v.reshape(b.num_rows, dim), scale)
                trees = [Tree.planted(x[:, c]) for c in cuts]
                ends = pa.array([0, b.num_rows], pa.int32())
                listed = [pa.ListArray.from_arrays(ends, b.column(c)) for c in ("vec_id", "label")]
                packed = [x, np.concatenate([t.order for t in trees]), *(np.concatenate([getattr(t, k).ravel() for t in trees]) for k in ("lo", "hi", "sums"))]
                columns = [*listed, *(pa.array([z.astype("<i8").tobytes()], pa.binary()) for z in packed)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "points", "orders", "lo", "hi", "sums"])

    def read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, list[Tree]]:
        """The points of a block and the tree of each of its parts."""
        x, orders, *boxes = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("points", "orders", "lo", "hi", "sums"))
        n = len(orders) // parts
        nodes = 1
        while n > LEAF * (nodes + 1) // 2:
            nodes = 2 * nodes + 1
        of = lambda z, c: z[nodes * c.start : nodes * c.stop].reshape(nodes, c.stop - c.start)
        return x.reshape(n, dim), [Tree(orders[n * p : n * (p + 1)], *(of(z, c) for z in boxes)) for p, c in enumerate(cuts)]

    def gather(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The sums of one task: a row for each part, entry and component; place -1 has the number of points."""
            total = [np.column_stack([np.zeros(len(b), np.int64), np.zeros_like(b)]) for b in books]
            for batch in batches:
                for i in range(batch.num_rows):
                    x, trees = read(batch, i)
                    for p, (tree, c) in enumerate(zip(trees, cuts, strict=True)):
                        _, sums, count = tree.assigned(books[p], x[:, c])
                        total[p] += np.column_stack([count, sums])
            keys = [np.array([(p, e, k) for e in range(len(t)) for k in range(-1, t.shape[1] - 1)]).reshape(-1, 3) for p, t in enumerate(total)]
            part, entry, place = np.concatenate(keys).T
            yield pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in ((part, pa.int32()), (entry, pa.int32()), (place, pa.int32()), (np.concatenate([t.ravel() for t in total]), pa.int64()))], names=["part", "entry", "place", "total"])

        return run

    def final(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x, trees = read(batch, i)
                    code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                    for p, (tree, c) in enumerate(zip(trees, cuts, strict=True)):
                        entry, _, _ = tree.assigned(books[p], x[:, c])
                        code[:, p] = entry
                        error += ((x[:, c] - books[p][entry]) ** 2).sum(1)
                    hexed = code.tobytes().hex()
                    texts = pa.array([hexed[k : k + 2 * parts] for k in range(0, len(hexed), 2 * parts)], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, texts, pa.array(error)], names=["vec_id", "label", "code", "error"])

        return run

    kind = rows.schema["label"].dataType.simpleString()
    binary = ", ".join(f"{c} binary" for c in ("points", "orders", "lo", "hi", "sums"))
    trees = materialise(rows.mapInArrow(plant, f"vec_id array<bigint>, label array<{kind}>, {binary}"), "trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(gather(books), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
        found = {(r.part, r.entry, r.place): int(r.total) for r in sums.collect()}  # entries x (components + parts) numbers
        for p, book in enumerate(books):
            new = book.copy()
            for e in range(len(book)):
                if count := found.get((p, e, -1), 0):
                    new[e] = [found[p, e, k] // count for k in range(book.shape[1])]
            books[p] = new
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    out = trees.mapInArrow(final(books), f"vec_id long, label {kind}, code string, error long")
    return out.withColumn("codebooks_sha256", F.lit(digest))
