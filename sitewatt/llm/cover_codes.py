"""Product codes of vectors by Lloyd rounds over partition-local cover trees.

Vectors become integers (floor of a fixed scale) and are cut into equal parts; each
part position has a codebook of a few entries, moved by Lloyd rounds.

Trees: every task cuts its rows into chunks and builds, for each part position of a
chunk, a cover tree: the children of a node are a greedy net of its points (each point
within half the node's covering radius of a child's centre, child centres further
apart than that), down to leaves of a few points. Points are stored in the tree's own
order, so a subtree is a range of them and its sum the difference of two cumulative
sums. The trees are written once and serve all rounds.

A round walks down each tree, a level at a time: if a node's centre is nearer to one
entry than to any other by more than twice the node's radius, the triangle inequality
gives the whole subtree to that entry (one subtraction of cumulative sums); other
nodes go on to their children, and the points of ambiguous leaves are compared
exactly, in integers, ties to the lower index. Tasks return sums per part, entry and
position; only the codebooks (part positions x entries x part length numbers, whatever
the table's size) pass the driver.

Defined cases: rows whose vector is null or holds null or non-finite components are
left out; a null id is coded but never starts an entry; repeated rows are coded each,
an id that repeats starts one entry, with its least vector; fewer ids than entries give
fewer entries; no id at all, or an empty table, gives an empty result; null labels are
one label. Only the three named columns are read, so extra columns do not matter.
Vectors must have one length, a multiple of the number of parts, and components up to
65,536 in size (beyond that an error need not fit a long): otherwise a ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatt.llm.common import drop_table, materialize
from sitewatt.operators.joins import checked_broadcast

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LARGEST = 1 << 28        # of the integers
CHUNK_BYTES = 1 << 19    # of a chunk's integers
LEAF = 12                # points of a node that is not split further

# ---------------------------------------------------------------------------
# Cover trees of one part position of one chunk.


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Tree:
    """Points in tree order and nodes: range of points, centre, radius, range of children."""

    def __init__(self, order, points, lo, hi, centre, first, count, radius):
        self.order, self.points = order, points
        self.lo, self.hi, self.centre, self.first, self.count, self.radius = lo, hi, centre, first, count, radius
        self.sums = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points, axis=0, out=self.sums[1:])

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(x))
        lo, hi, centre, first, count, radius = [0], [len(x)], [0], [], [], []
        node = 0
        while node < len(lo):
            own = order[lo[node]:hi[node]]
            d = _squares(x[own], x[centre[node]])
            far = int(d.max())
            radius.append(np.nextafter(np.sqrt(float(far)), np.inf))
            if far == 0 or len(own) <= leaf:
                first.append(0)
                count.append(0)
                node += 1
                continue
            cover = 1 << 2 * ((far.bit_length() + 1) // 2)   # a power of 4 at least the square of the radius
            cover = (cover if cover // 4 < far else cover // 4) / 4
            groups, rest, c = [], own, centre[node]
            first.append(len(lo))
            at = lo[node]
            while len(rest):
                near = (d if c == centre[node] else _squares(x[rest], x[c])) <= cover
                groups.append(rest[near])
                lo.append(at)
                at += len(groups[-1])
                hi.append(at)
                centre.append(c)
                rest = rest[~near]
                c = rest[0] if len(rest) else None
            order[lo[node]:hi[node]] = np.concatenate(groups)
            count.append(len(groups))
            node += 1
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        ints = [np.array(v, np.int64) for v in (lo, hi, place[centre], first, count)]
        return cls(order, x[order], *ints, np.array(radius))

    def dump(self) -> bytes:
        head = np.array([len(self.points), self.points.shape[1], len(self.lo)], "<i4")
        ints = [head, self.order, self.points.ravel(), self.lo, self.hi, self.centre, self.first, self.count]
        return b"".join([v.astype("<i4").tobytes() for v in ints] + [self.radius.astype("<f8").tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        n, width, m = np.frombuffer(raw, "<i4", 3).tolist()
        v = np.frombuffer(raw, "<i4", n + n * width + 5 * m, 12).astype(np.int64)
        nodes = v[n + n * width:].reshape(5, m)
        return cls(v[:n], v[n:n + n * width].reshape(n, width), *nodes, np.frombuffer(raw, "<f8", m, 12 + 4 * len(v)))

    def assign(self, book: np.ndarray, codes: bool = False):
        """Points and sums of each entry; with ``codes`` the entry of every point in tree order instead.
        Also returns how many points were compared one by one."""
        k = len(book)
        copy = (_squares(book[:, None], book[None]) == 0) & np.tri(k, k, -1, dtype=bool)
        live = np.flatnonzero(~copy.any(axis=1))            # a repeated entry never wins a tie
        n, total = np.zeros(k, np.int64), np.zeros(book.shape, np.int64)
        out = np.empty(len(self.points), np.int64) if codes else None
        compared = 0
        nodes = np.zeros(1, np.int64)
        while len(nodes):
            d = np.sqrt(_squares(self.points[self.centre[nodes], None], book[live]).astype(np.float64))
            best = d.argmin(axis=1)
            row = np.arange(len(nodes))
            near = d[row, best]
            d[row, best] = np.inf
            sure = d.min(axis=1) * (1 - 1e-12) > (near + 2 * self.radius[nodes]) * (1 + 1e-12) + 1e-9
            some, entry = nodes[sure], live[best[sure]]
            if codes:
                size = self.hi[some] - self.lo[some]
                out[_ranges(self.lo[some], size)] = np.repeat(entry, size)
            else:
                np.add.at(n, entry, self.hi[some] - self.lo[some])
                np.add.at(total, entry, self.sums[self.hi[some]] - self.sums[self.lo[some]])
            rest = nodes[~sure]
            ends = rest[self.count[rest] == 0]
            if len(ends):
                at = _ranges(self.lo[ends], self.hi[ends] - self.lo[ends])
                compared += len(at)
                entry = live[_squares(self.points[at, None], book[live]).argmin(axis=1)]
                if codes:
                    out[at] = entry
                else:
                    np.add.at(n, entry, 1)
                    np.add.at(total, entry, self.points[at])
            inner = rest[self.count[rest] > 0]
            nodes = _ranges(self.first[inner], self.count[inner])
        return (out if codes else (n, total)), compared


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for ``size`` numbers each."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


# ---------------------------------------------------------------------------
# Spark jobs: trees, rounds, codes.

TREES = "dim int, ids array<long>, labels array<string>, seeds array<struct<id: long, v: array<int>>>, trees array<binary>"
_TREE_ARROW = pa.schema([("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
                         ("seeds", pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.int32()))]))),
                         ("trees", pa.list_(pa.binary()))])


def _integers(column: pa.Array, scale: int):
    """Rows that hold a vector of finite components, and their floored integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    keep = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(keep))
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    v = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    bad = np.zeros(len(size), bool)
    bad[np.repeat(np.arange(len(size)), size)[~np.isfinite(v)]] = True
    keep, start, size = keep[~bad], start[~bad], size[~bad]
    if not len(keep):
        return keep, np.zeros((0, 0), np.int64)
    if size.min() != size.max() or size[0] % PARTS or not size[0]:
        raise ValueError(f"vectors of lengths {size.min()} to {size.max()}: one length, a multiple of {PARTS}, is needed")
    x = np.floor(v[start[:, None] + np.arange(size[0])] * scale)
    if np.abs(x).max() > LARGEST:
        raise ValueError(f"component beyond {LARGEST // scale} in size")
    return keep, x.astype(np.int64)


def _chunk_rows(ids: list, labels: list, x: np.ndarray, parts: int, entries: int):
    cut = x.reshape(len(x), parts, -1)
    least = {}
    for i in np.lexsort(x.T[::-1]).tolist():                # vectors ascending
        if ids[i] is not None:
            least.setdefault(ids[i], i)
    seeds = [{"id": i, "v": x[least[i]].tolist()} for i in sorted(least)[:entries]]
    trees = [Tree.build(np.ascontiguousarray(cut[:, p])).dump() for p in range(parts)]
    return {"dim": x.shape[1], "ids": ids, "labels": labels, "seeds": seeds, "trees": trees}


def _grow(scale: int, parts: int, entries: int):
    def work(batches):
        ids, labels, rows, held = [], [], [], 0
        for b in batches:
            keep, x = _integers(b.column(1), scale)
            if not len(keep):
                continue
            most = max(CHUNK_BYTES // (4 * x.shape[1]), 64)
            at = pa.array(keep)
            own_ids, own_labels = b.column(0).take(at).to_pylist(), b.column(2).take(at).to_pylist()
            done = 0
            while done < len(keep):
                n = min(most - held, len(keep) - done)
                ids += own_ids[done:done + n]
                labels += own_labels[done:done + n]
                rows.append(x[done:done + n])
                held, done = held + n, done + n
                if held == most:
                    yield pa.RecordBatch.from_pylist([_chunk_rows(ids, labels, np.concatenate(rows), parts, entries)], _TREE_ARROW)
                    ids, labels, rows, held = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_chunk_rows(ids, labels, np.concatenate(rows), parts, entries)], _TREE_ARROW)
    return work


def grow_trees(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
               scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES) -> DataFrame:
    """One row per chunk of a partition: ids, labels and the trees of its part positions (written)."""
    chunks = vectors.select(F.col(vec_id).cast("long"), F.col(vector), F.col(label).cast("string"))
    return materialize(chunks.mapInArrow(_grow(scale, parts, entries), TREES), "cover-trees")


def first_books(trees: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks made of the vectors of the smallest ids (a bounded number of rows), or None without any."""
    seeds = trees.select(F.inline("seeds")).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    if not seeds:
        return None
    lengths = trees.agg(F.min("dim"), F.max("dim")).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of lengths {lengths[0]} to {lengths[1]}")
    return np.array([s["v"] for s in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()


def _round(books: np.ndarray):
    def work(batches):
        n = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for b in batches:
            for trees in b.column(0):
                for p, raw in enumerate(trees):
                    (a, s), _ = Tree.load(raw.as_py()).assign(books[p])
                    n[p] += a
                    total[p] += s
        both = np.concatenate([n[..., None], total], axis=2)
        part, entry, place = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(both[part, entry, place])],
                                         names=["part", "entry", "place", "value"])
    return work


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry without parts stays."""
    sums = (trees.select("trees").mapInArrow(_round(books), "part long, entry long, place long, value long")
            .groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    found = {(r["part"], r["entry"], r["place"]): int(r["value"]) for r in sums}
    out = books.copy()
    for p, e in {k[:2] for k in found}:
        n = found[p, e, 0]
        out[p, e] = [found.get((p, e, 1 + i), 0) // n for i in range(books.shape[2])]
    return out


def _coded(books: np.ndarray):
    def work(batches):
        for b in batches:
            for ids, labels, trees in zip(b.column(0), b.column(1), b.column(2)):
                n = len(ids)
                code, error = np.empty((n, len(books)), np.int64), np.zeros(n, np.int64)
                for p, raw in enumerate(trees):
                    t = Tree.load(raw.as_py())
                    entry, _ = t.assign(books[p], codes=True)
                    code[t.order, p] = entry
                    error[t.order] += _squares(t.points, books[p][entry])
                text = [bytes(c).hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(text, pa.string()), pa.array(error), labels.values],
                                                 names=["vec_id", "code", "error", "label"])
    return work


def encode_vectors(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, code, error, label`` of every kept vector."""
    return trees.select("ids", "labels", "trees").mapInArrow(
        _coded(books), "vec_id long, code string, error long, label string")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compress(vectors: DataFrame, rounds: int = ROUNDS, **columns) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of all vectors after ``rounds`` Lloyd rounds, and the codebooks."""
    trees = grow_trees(vectors, **columns)
    books = first_books(trees)
    if books is None:
        return vectors.sparkSession.createDataFrame([], RESULT), None
    for _ in range(rounds):
        books = lloyd_round(trees, books)
    coded = materialize(encode_vectors(trees, books), "codes")
    drop_table(trees)
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = by_label.withColumnRenamed("label", "__label")
    joined = coded.join(checked_broadcast(by_label), F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")), books


def op12(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
