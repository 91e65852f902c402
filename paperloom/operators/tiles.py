"""Exact work on all pairs of vectors, in tiles: a block of rows against a block of others.

Vectors are packed into blocks; blocks meet in a Cartesian product whose tasks
each hold one part of bounded bytes of one side, and see the blocks of the other
side one by one.  Distances of a tile are a product of matrices; whatever is
decided by them is decided by exact distances (summed in order) where the product
is too coarse.  The work is quadratic, the memory of a task is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block at most, and bytes of the blocks that a task holds.
ROWS = 1024
PART_BYTES = 32 << 20
#: What a product of matrices may be wrong by, as a share of the squared lengths.
SLACK = 1e-11


def block_rows(rows: DataFrame, n: int, widest: int = 1) -> int:
    """So many rows that all cores get blocks; ``widest``: doubles that are held for each row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(16, min(ROWS, n // (4 * cores) + 1, (8 << 20) // max(1, widest)))


def packed(vectors: DataFrame, key: str, vector: str, rows: int = ROWS, **more: Column) -> DataFrame:
    """k (keys), x (doubles, row by row), dims, and arrays of ``more``: blocks of vectors of one length.

    Rows without key or vector, or with a gap in it, are in no block.
    """
    whole = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), *[c.alias(name) for name, c in more.items()], F.col(vector).cast("array<double>").alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    names = ["k", *more]
    kinds = {name: whole.schema[name].dataType for name in names}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            sizes = np.diff(lists.offsets.to_numpy())
            flat, first = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dims in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dims)
                for at in range(0, len(of), rows):
                    some = of[at : at + rows]
                    x = flat[(first[some][:, None] + np.arange(dims)).ravel()].astype("<f8")
                    arrays = [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column(c).take(pa.array(some))) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([x.tobytes()], pa.binary()), pa.array([dims], pa.int32())], names=[*names, "x", "dims"])

    return whole.mapInArrow(pack, ", ".join([*(f"{name} array<{kinds[name].simpleString()}>" for name in names), "x binary", "dims int"]))


def crossed(left: DataFrame, right: DataFrame, n: int, dims: int, part_bytes: int | None = None) -> DataFrame:
    """Every block of ``left`` (columns a...) with every one of ``right`` (b...) of its length.

    ``n`` and ``dims`` of the right side decide its parts.  A task goes through
    all blocks of its part for one block of the left side after the other.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n * (8 * max(1, dims) + 32) // (part_bytes or PART_BYTES)))
    a = left.select(*[F.col(c).alias(f"a{c}") for c in left.columns]).withColumn("a", F.monotonically_increasing_id()).repartition(4 * cores)
    b = right.select(*[F.col(c).alias(f"b{c}") for c in right.columns]).withColumn("b", F.monotonically_increasing_id()).repartition(parts)
    return a.crossJoin(b.hint("shuffle_replicate_nl"))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of :func:`crossed`: arrays by column name, x as a matrix; lengths that differ don't meet."""
    for batch in batches:
        columns = {name: batch.column(c) for c, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            if (dims := columns["adims"][r].as_py()) != columns["bdims"][r].as_py():
                continue
            out = {}
            for name, column in columns.items():
                if name in ("ax", "bx"):
                    out[name] = np.frombuffer(column[r].as_buffer(), "<f8").reshape(-1, dims)
                elif name in ("a", "b"):
                    out[name] = column[r].as_py()
                elif name not in ("adims", "bdims"):
                    values = column[r].values.to_numpy(zero_copy_only=False)
                    out[name] = values.astype(str) if values.dtype == object else values
            yield out


def squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows by one product, and what they may be wrong by."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left = np.concatenate([-2 * a, na[:, None], np.ones((len(a), 1))], 1)
    right = np.concatenate([b, np.ones((len(b), 1)), nb[:, None]], 1)
    return left @ right.T, SLACK * float(na.max(initial=0) + nb.max(initial=0))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of equal number, summed dimension by dimension."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        apart = a[:, d] - b[:, d]
        out += apart * apart
    return out


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows lie within ``eps``; those at its edge by exact distances."""
    d, slack = squared(a, b)
    slack += SLACK * eps * eps
    near = d <= eps * eps
    i, j = np.nonzero(np.abs(d - eps * eps) <= slack)
    if len(i):
        near[i, j] = np.sqrt(exact(a[i], b[j])) <= eps
    return near


def best(crossed_blocks: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame:
    """query_id, key, distance: of each task, the ``k`` nearest left rows of every right row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # of each block of queries: its keys, bounds, and the best so far
        for t in tiles(batches):
            x, q = t["ax"], t["bx"]
            ids, most, at, far, keys = held.get(t["b"]) or (t["bk"], np.full(len(q), np.inf), np.empty(0, np.int64), np.empty(0), np.empty(0, t["ak"].dtype))
            d, slack = squared(q, x)
            if d.shape[1] > k and np.isinf(most).any():
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1] + slack)
            i, j = np.nonzero(d <= (most + slack)[:, None])
            at, far, keys = np.concatenate([at, i]), np.concatenate([far, exact(q[i], x[j])]), np.concatenate([keys, t["ak"][j]])
            order = np.lexsort((keys, far, at))
            at, far, keys = at[order], far[order], keys[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            most = most.copy()
            most[at[rank == k - 1]] = far[rank == k - 1]
            keep = rank < k
            held[t["b"]] = (ids, most, at[keep], far[keep], keys[keep])
        for ids, _, at, far, keys in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(keys), pa.array(far)], names=["query_id", "key", "distance"])

    return crossed_blocks.mapInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, distance double")


def summed(crossed_blocks: DataFrame, labels: list) -> DataFrame:
    """total, n: sums and counts of silhouettes, from sums of distances by block and cluster.

    Left and right blocks have a column ``label``; ``labels`` lists the clusters
    and their sizes.  Points of two clusters none of which is apart from
    them have no silhouette.
    """
    names = np.array([x for x, _ in labels])
    names = names if len(names) else np.empty(0)
    order = np.argsort(names)
    sizes = np.array([n for _, n in labels], float)[order]
    names, k = names[order], len(labels)

    def codes(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(names, values)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, own = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([own.astype("<i8").tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["a", "own", "total"])

        for t in tiles(batches):
            if t["a"] != now:
                if now is not None:
                    yield done()
                now, own, total = t["a"], codes(t["alabel"]), np.zeros((len(t["ax"]), k))
            c = codes(t["blabel"])
            order = np.argsort(c, kind="stable")
            y, c = t["bx"][order], c[order]
            d, slack = squared(t["ax"], y)
            i, j = np.nonzero(d <= 1e3 * slack)
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            if len(i):  # equal or nearly: the product's error shows in the root
                d[i, j] = np.sqrt(exact(t["ax"][i], y[j]))
            starts = np.flatnonzero(np.diff(c, prepend=-1))
            total[:, c[starts]] += np.add.reduceat(d, starts, axis=1)
        if now is not None:
            yield done()

    def scores(table: pa.Table) -> pa.Table:
        own = np.frombuffer(table.column("own")[0].as_py(), "<i8")
        total = np.zeros((len(own), k))
        for x in table.column("total"):
            total += np.frombuffer(x.as_py(), "<f8").reshape(len(own), k)
        rows = np.arange(len(own))
        mine = total[rows, own] / np.maximum(sizes[own] - 1, 1)
        total /= sizes
        total[rows, own] = np.inf
        other = total.min(1, initial=np.inf)
        defined = (sizes[own] > 1) & np.isfinite(other)
        most = np.where(defined, np.maximum(mine, other), 1)
        score = np.where(defined, (np.where(defined, other, 0) - mine) / np.where(most > 0, most, 1), 0.0)
        kept = most > 0
        return pa.table({"total": [float(score[kept].sum())], "n": [int(kept.sum())]})

    parts = crossed_blocks.mapInArrow(sums, "a long, own binary, total binary")
    return parts.groupBy("a").applyInArrow(scores, "total double, n long")


def neighbours(crossed_blocks: DataFrame, eps: float, kind: str) -> DataFrame:
    """key, n: how many right rows of a task lie within ``eps`` of each left row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, n = None, None, None
        for t in tiles(batches):
            if t["a"] != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                now, keys, n = t["a"], t["ak"], np.zeros(len(t["ax"]), np.int64)
            n += within(t["ax"], t["bx"], eps).sum(1)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return crossed_blocks.mapInArrow(run, f"key {kind}, n long")


def reached(crossed_blocks: DataFrame, eps: float, kind: str) -> DataFrame:
    """key, label: the least ``label`` of a task's right rows within ``eps`` of each left row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tiles(batches):
            labels = np.sort(np.unique(t["blabel"]))
            code = np.searchsorted(labels, t["blabel"])
            first = np.where(within(t["ax"], t["bx"], eps), code[None, :], len(labels)).min(1, initial=len(labels))
            found = first < len(labels)
            yield pa.RecordBatch.from_arrays([pa.array(t["ak"][found]), pa.array(labels[first[found]])], names=["key", "label"])

    return crossed_blocks.mapInArrow(run, f"key {kind}, label {kind}")


class Forest:
    """Disjoint sets of keys; the least key of a set is its root."""

    def __init__(self) -> None:
        self.above: dict = {}

    def root(self, x):
        top = x
        while (up := self.above.get(top, top)) != top:
            top = up
        while (up := self.above.get(x, x)) != top and x != top:
            self.above[x], x = top, up
        return top

    def join(self, x, y) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)

    def roots(self, labels: np.ndarray) -> np.ndarray:
        names, at = np.unique(labels, return_inverse=True)
        return np.array([self.root(x) for x in names.tolist()], labels.dtype)[at]


def linked(crossed_blocks: DataFrame, eps: float, kind: str) -> DataFrame:
    """key, root: a forest of each task that joins what its pairs within ``eps`` join.

    No pair is listed: the sets that meet in a tile are joined, and a tile all
    of whose rows are in one set already isn't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rows = Forest(), {}
        for t in tiles(batches):
            sides = []
            for side in ("a", "b"):
                name = (side, t[side])
                rows[name] = (t[f"{side}k"], forest.roots(rows[name][1] if name in rows else t[f"{side}k"]))
                sides.append(np.unique(rows[name][1], return_inverse=True))
            (ua, ia), (ub, ib) = sides
            if len(ua) == len(ub) == 1 and ua[0] == ub[0]:
                continue
            near = within(t["ax"], t["bx"], eps)
            for axis, at in ((0, ia), (1, ib)):  # sets instead of rows
                order = np.argsort(at, kind="stable")
                near = np.logical_or.reduceat(near.take(order, axis), np.flatnonzero(np.diff(at[order], prepend=-1)), axis=axis)
            i, j = np.nonzero(near)
            if len(i) <= 8 * (len(ua) + len(ub)):
                for x, y in zip(ua[i].tolist(), ub[j].tolist(), strict=True):
                    forest.join(x, y)
                continue
            names = np.unique(np.concatenate([ua, ub]))
            la, lb = np.searchsorted(names, ua), np.searchsorted(names, ub)
            oa, ob = la, lb
            while True:  # dense: the least label spreads in a few rounds
                na = np.minimum(la, np.where(near, lb[None, :], len(names)).min(1))
                nb = np.minimum(lb, np.where(near, na[:, None], len(names)).min(0))
                if (na == la).all() and (nb == lb).all():
                    break
                la, lb = na, nb
            for x, y in zip(np.concatenate([oa, ob]).tolist(), np.concatenate([la, lb]).tolist(), strict=True):
                if x != y:
                    forest.join(names[x].item(), names[y].item())
        for keys, labels in rows.values():
            labels = forest.roots(labels)
            under = labels != keys
            yield pa.RecordBatch.from_arrays([pa.array(keys[under]), pa.array(labels[under])], names=["key", "root"])

    return crossed_blocks.mapInArrow(run, f"key {kind}, root {kind}")
