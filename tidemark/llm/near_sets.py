"""Similar sets: sketches, verified links inside buckets of candidates, and components of links. Used by the set join and by paragraph dedup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, materialize, mix

#: Coordinates of a sketch: one-permutation MinHash, empty coordinates filled from the next one that is not.
COORDINATES = 128
#: Members of a bucket that one task compares with each other; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
_PAIRS_AT_ONCE = 1 << 18
_SMALL = 32
#: Keys of at most this many bytes are sent to every executor; more are joined by a shuffle.
_BROADCAST_BYTES = 16 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128 numbers of 32 bits for each of many sets that are not empty; set k holds values[starts[k] : starts[k + 1]], distinct. Two sets agree in a coordinate with about their Jaccard similarity as probability."""
    sizes = np.diff(np.append(starts, len(values)))
    x = mix(values + _STEP)
    cell = np.repeat(np.arange(len(starts)), sizes) * COORDINATES + (x >> np.uint64(57)).astype(np.int64)
    low = np.full(len(starts) * COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, cell, x)
    full = np.zeros(len(low), bool)
    full[cell] = True
    full = full.reshape(-1, COORDINATES)
    low = ((low >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).reshape(-1, COORDINATES)
    # an empty coordinate takes the next full one, beyond the last the first again
    at = np.where(full, np.arange(COORDINATES), 2 * COORDINATES)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
    at = np.minimum(at, at[:, :1] + COORDINATES)
    away = (at - np.arange(COORDINATES)).astype(np.uint64)
    return ((np.take_along_axis(low, at % COORDINATES, 1) + away * _STEP) & np.uint64(0xFFFFFFFF)).astype("<u4")


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, owner) sorted by owner and value, each value once for an owner. Owners come in order."""
    by = np.lexsort((values, owner))
    values, owner = values[by], owner[by]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def set_name(unique: np.ndarray) -> bytes:
    """128 bits that name a sorted set."""
    return xxhash.xxh3_128_digest(unique.tobytes())


def crowded(paths: DataFrame) -> DataFrame:
    """(path, node) rows whose path has two nodes or more, with that number as `size`. Counts are combined before the shuffle; Spark splits hot paths in the join."""
    # a table of its own, so that Spark can split a hot path's rows in the join
    sizes = materialize(paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "path-sizes")
    return paths.hint("merge").join(sizes, "path")


def _pairs(starts: np.ndarray, rows: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows inside groups, a bounded number at a time; none of groups of more than `most` rows."""
    ends = np.repeat(np.append(starts[1:], rows), np.diff(np.append(starts, rows)))
    partners = ends - np.arange(rows) - 1
    if most is not None:
        sizes = np.diff(np.append(starts, rows))
        partners[np.repeat(sizes > most, sizes)] = 0
    total = np.cumsum(partners)
    k = 0
    while k < rows:
        j = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _PAIRS_AT_ONCE, "right")))
        many = partners[k:j]
        left = np.repeat(np.arange(k, j), many)
        within = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        yield left, left + 1 + within
        k = j


class _Group:
    """Columns of the rows of some buckets as arrays, and the pairs of rows to look at."""

    def __init__(self, table: pa.Table, threshold: float):
        self.table, self.threshold = table, threshold
        col = lambda name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
        self.n = col("n").to_numpy().astype(np.float64)
        self.bucket, self.block = col("bucket").to_numpy(), col("block").to_numpy()
        self.diagonal = col("bi").to_numpy() == col("bj").to_numpy()
        paths = col("paths")
        self.path_at, self.path_values = paths.offsets.to_numpy() - paths.offsets[0].as_py(), paths.flatten().to_numpy()
        self.col = col

    def paths(self, k: int) -> np.ndarray:
        return self.path_values[self.path_at[k] : self.path_at[k + 1]]

    def sized(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs of a block pair whose sizes allow the threshold."""
        a, b = self.n[left], self.n[right]
        return (np.minimum(a, b) >= self.threshold * np.maximum(a, b) - 1e-9) & (self.diagonal[left] | (self.block[left] != self.block[right]))

    def first_meeting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs for which this bucket is the smallest that both are in: each pair is handled once over all buckets."""
        sets: dict[int, set] = {}
        out = np.empty(len(left), bool)
        for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            for x in (a, b):
                if x not in sets:
                    sets[x] = set(self.paths(x).tolist())
            out[k] = min(sets[a] & sets[b]) == self.bucket[a]
        return out

    def met_before(self, low: int, high: int) -> np.ndarray:
        """For the rows low .. high - 1 of one bucket: which pairs share a smaller bucket."""
        m = high - low
        values = self.path_values[self.path_at[low] : self.path_at[high]]
        owner = np.repeat(np.arange(m), np.diff(self.path_at[low : high + 1]))
        earlier = values < self.bucket[low]
        values, owner = values[earlier], owner[earlier]
        by = np.argsort(values, kind="stable")
        values, owner = values[by], owner[by]
        met = np.zeros((m, m), bool)
        if not len(values):
            return met
        edge = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        for s, e in zip(edge, np.append(edge[1:], len(values)), strict=True):
            if e - s > 1:
                met[np.ix_(owner[s:e], owner[s:e])] = True
        return met


def _likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows that have a pair to verify in their bucket: sizes and sketches allow it and the pair has not met in a smaller bucket.

    The bound on the sketch lies 4.5 standard deviations under the threshold, by the number of coordinates that carry news.
    """

    def close(g: _Group, bytes_: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        width = bytes_.shape[1]
        same = (bytes_[left] == bytes_[right]).sum(1) / width
        news = np.minimum(width, np.minimum(g.n[left], g.n[right]))
        # coordinates filled from neighbours repeat what few elements say, hence the factor 2 where the set is small
        return same >= threshold - 4.5 * np.sqrt(threshold * (1 - threshold) / news * np.where(g.n[left] < 2 * COORDINATES, 2, 1))

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        g = _Group(table, threshold)
        bytes_ = np.frombuffer(b"".join(g.col("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        wanted = np.zeros(table.num_rows, bool)
        sizes = np.diff(np.append(starts, table.num_rows))

        def look(left: np.ndarray, right: np.ndarray, new: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
            keep = g.sized(left, right)
            left, right = left[keep], right[keep]
            for k in range(0, len(left), 1 << 14):
                i, j = left[k : k + (1 << 14)], right[k : k + (1 << 14)]
                keep = close(g, bytes_, i, j)
                i, j = i[keep], j[keep]
                keep = new(i, j)
                wanted[i[keep]] = wanted[j[keep]] = True

        for left, right in _pairs(starts, table.num_rows, _SMALL):
            look(left, right, g.first_meeting)
        for low, m in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
            met = g.met_before(low, low + m)
            for left, right in _pairs(np.zeros(1, np.int64), m):
                look(left + low, right + low, lambda i, j, low=low, met=met: ~met[i - low, j - low])
        if wanted.any():
            yield from table.filter(pa.array(wanted)).select(["bucket", "bi", "bj", "block", "node", "n", "copies", "paths"]).to_batches()

    return by_group(batches, ["bucket", "bi", "bj"], work)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard similarity of the pairs handled in each bucket: per node the copies it links to, and an edge to a member of its part of the bucket."""

    def common(values: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Sizes of all intersections inside a bucket, by products of incidence matrices over values that two or more have."""
        part = values[at[low] : at[high]]
        owner = np.repeat(np.arange(high - low), np.diff(at[low : high + 1]))
        _, inverse, many = np.unique(part, return_inverse=True, return_counts=True)
        shared = many[inverse] > 1
        owner, inverse = owner[shared], (np.cumsum(many > 1) - 1)[inverse[shared]]
        out = np.zeros((high - low, high - low), np.float32)
        by = np.argsort(inverse, kind="stable")
        owner, inverse = owner[by], inverse[by]
        for s in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, 4096):
            a, b = np.searchsorted(inverse, (s, s + 4096))
            has = np.zeros((high - low, 4096), np.float32)
            has[owner[a:b], inverse[a:b] - s] = 1
            out += has @ has.T
        return out

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        g = _Group(table, threshold)
        sets = g.col("elements")
        at, values = sets.offsets.to_numpy() - sets.offsets[0].as_py(), sets.flatten().to_numpy()
        nodes, copies = g.col("node"), g.col("copies").to_numpy()
        rows, others, links = [], [], []
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
            m = high - low
            if m < 2:
                continue
            if m <= _SMALL:
                i, j = np.triu_indices(m, 1)
                i, j = i + low, j + low
                keep = g.sized(i, j)
                i, j = i[keep], j[keep]
                keep = g.first_meeting(i, j)
                i, j = i[keep], j[keep]
                both = np.array([len(np.intersect1d(values[at[a] : at[a + 1]], values[at[b] : at[b + 1]], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.float64)
                keep = both >= threshold * (g.n[i] + g.n[j] - both) - 1e-9
                i, j = i[keep], j[keep]
            else:
                both = common(values, at, low, high)
                n = g.n[low:high]
                good = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
                good &= ~g.met_before(low, high)
                if not g.diagonal[low]:
                    good &= g.block[low:high, None] != g.block[None, low:high]
                i, j = np.nonzero(np.triu(good, 1))
                i, j = i + low, j + low
            if not len(i):
                continue
            count = np.zeros(m, np.int64)
            np.add.at(count, i - low, copies[j])
            np.add.at(count, j - low, copies[i])
            root = _roots(m, i - low, j - low)
            for k in np.flatnonzero(count):
                rows.append(low + k)
                others.append(low + root[k])
                links.append(count[k])
        if rows:
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(rows)), nodes.take(pa.array(others)), pa.array(links, pa.int64())], ["node", "other", "links"])

    return by_group(batches, ["bucket", "bi", "bj"], work, rows=2_000)


def _roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's part, by the edges i - j."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            return root


def verified_links(buckets: DataFrame, nodes: DataFrame, elements_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(node, other, links): the exact links among nodes that share a bucket, as counts and edges, not as pairs.

    buckets: distinct (path, node, size). nodes: (node, n, copies, mins), one row each; mins: a byte of each of some coordinates. elements_of(names): (node,
    elements sorted) for a frame of node names. A pair is compared in the smallest bucket that both are in, so no
    count is taken twice and no pair has to be made a row to tell. A bucket beyond BLOCK members is dealt out as
    pairs of blocks of about BLOCK members, so no task holds a whole large bucket and none of its pairs is left out.
    """
    listed = buckets.groupBy("node").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    described = nodes.hint("merge").join(listed, "node").select("node", "n", "copies", F.col("mins").alias("sketch"), "paths")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = buckets.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int"))
    dealt = placed.select(
        "path", "node", "block", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least("block", o).alias("bi"), F.greatest("block", o).alias("bj")))).alias("p")
    ).select(F.col("path").alias("bucket"), "node", "block", "p.bi", "p.bj")
    full = dealt.hint("merge").join(described, "node").select("bucket", "bi", "bj", "block", "node", "n", "copies", "paths", "sketch")
    grouped = lambda df: df.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "node")
    kept = "bucket long, bi int, bj int, block int, node binary, n long, copies long, paths array<long>"
    likely = materialize(grouped(full).mapInArrow(lambda b: _likely(b, threshold), kept), "likely")
    elements = elements_of(likely.select("node").distinct())
    return grouped(likely.hint("merge").join(elements, "node")).mapInArrow(lambda b: _verified(b, threshold), "node binary, other binary, links long")


def semi(docs: DataFrame, names: DataFrame, on: list[str], row_bytes: int = 128) -> DataFrame:
    """docs whose key is in names: sent to every executor if counted to be small, else by a shuffle. row_bytes: what a key of two numbers takes in a hashed relation, its row and its place in the map, rounded up."""
    small = names.count() * row_bytes <= _BROADCAST_BYTES
    return docs.join(F.broadcast(names) if small else names.hint("merge"), on, "left_semi")
