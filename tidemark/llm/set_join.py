"""N-gram Jaccard join by chosen paths: recursively split sets on sampled shared tokens, brute-force small buckets, repeat until the target recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import components

from .common import WordHashes, fold_words, materialize, mix, shingles, texts
from .near_sets import BLOCK, COORDINATES, crowded, distinct, set_name, sketches, verified_links

_ODD = np.uint64(0xD1342543DE82EF95)


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold still shares a path after `depth` splits: each child is sampled with rate 1/threshold in all and kept by both with chance `threshold`."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_for(threshold: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def _sets_of(values: list[bytes | None], words: int, at_once: int = 1 << 18, sets: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, places of the sets that are not empty, elements, where each set begins) for runs of at most `sets` texts and about at_once shingles: sorted sets of word shingles."""
    hashes, first, parts, size = WordHashes(), 0, [], 0
    for k, text in enumerate(values):
        parts.append(shingles(hashes.of(fold_words(text or b"")), words))
        size += len(parts[-1])
        if size >= at_once or len(parts) == sets or k == len(values) - 1:
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            elements, owner = distinct(np.concatenate(parts), owner)
            starts = np.searchsorted(owner, np.arange(len(parts) + 1))
            yield first, np.append(np.flatnonzero(np.diff(starts)), len(parts)), elements, starts
            first, parts, size = k + 1, [], 0


def named_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, row_hash, node, n, mins): each document's set of word shingles by name, its size and its sketch (null for a set of none)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("mins", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, own, values, starts in _sets_of(texts(b.column(2)), words):
                mins = iter(sketches(values, starts[own[:-1]]) if len(values) else [])
                node, n, kept = [], [], []
                for k, text in enumerate(texts(b.column(2).slice(first, len(starts) - 1))):
                    unique = values[starts[k] : starts[k + 1]]
                    node.append(set_name(unique) if len(unique) else xxhash.xxh3_128_digest(b"text:" + (text or b"")))
                    n.append(len(unique))
                    kept.append(next(mins).tobytes() if len(unique) else None)
                part = b.slice(first, len(node))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, row_hash long, node binary, n long, mins binary")


def _elements(docs: DataFrame, words: int) -> DataFrame:
    """(node, elements) of documents with columns doc_id, row_hash and text."""
    schema = pa.schema([("node", pa.binary()), ("elements", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            nodes, sets, held = [], [], 0
            for text in texts(b.column(0)):
                unique = np.unique(shingles(hashes.of(fold_words(text or b"")), words))
                nodes.append(set_name(unique))
                sets.append(np.sort(unique.view(np.int64)))
                held += len(unique)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return docs.select("text").mapInArrow(work, "node binary, elements array<long>")


def _sampled(seeds: np.ndarray, threshold: float, at_least_one: bool) -> np.ndarray:
    """Which of the coordinates each path splits on: each with chance 1/(threshold * COORDINATES), by the path's hash."""
    draw = mix(mix(seeds)[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64)[None, :] * _ODD)
    chosen = draw < np.uint64(int(2**64 / (threshold * COORDINATES)))
    if at_least_one:
        chosen[np.arange(len(seeds)), draw.argmin(1)] = True
    return chosen


def _children(rows: DataFrame, threshold: float, runs: int | None) -> DataFrame:
    """(path, node) one level down. rows: (path, node, mins), or (node, mins) at the top, where each run is a path of its own."""
    schema = pa.schema([("path", pa.int64()), ("node", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                mins = np.frombuffer(b"".join(part.column("mins").to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
                if runs is None:
                    seeds = part.column("path").to_numpy().view(np.uint64)
                    row, coordinate = np.nonzero(_sampled(seeds, threshold, False))
                    seeds = seeds[row]
                else:
                    top = np.arange(1, runs + 1, dtype=np.uint64)
                    run, coordinate = np.nonzero(_sampled(top, threshold, True))
                    row = np.repeat(np.arange(len(mins)), len(run))
                    seeds, coordinate = np.tile(top[run], len(mins)), np.tile(coordinate, len(mins))
                path = mix(mix(seeds * _ODD + coordinate.astype(np.uint64)) + mins[row, coordinate])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column("node").take(pa.array(row))], schema=schema)

    return rows.mapInArrow(work, "path long, node binary")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.995, depth: int = 3, leaf: int = 128) -> DataFrame:
    """One row per document: doc_id, row_hash, copy_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of runs of `words` words (a text of fewer words,
    but not none, is one run) is at least `threshold`. n_links counts the documents a row is linked to, copy_id is the
    smallest id with an equal set, class_id the smallest id in its component of links. Documents without words are
    linked only to those of equal text (null and empty are equal). Repeated rows are documents of their own; null ids
    are carried but never the smallest where another id exists.

    Equal sets are collapsed first. Then each of runs_for(threshold, depth, recall) runs splits all sets on sampled
    coordinates of their MinHash sketch, splits buckets of more than `leaf` again up to `depth` times, and compares what shares a last
    bucket exactly. Every link found is exact; a pair at the threshold is missed with a chance of at most 1 - recall,
    more similar pairs with less.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(named_sets(source, "doc_id", "text", words), "sets")
    nodes = materialize(sets.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.min(F.struct("doc_id", "row_hash")).alias("pick")), "nodes")
    able = nodes.filter("n > 0")
    leaves = []
    frontier, now = able.select("node", "mins"), runs_for(threshold, depth, recall)
    for level in range(depth):
        found = materialize(crowded(_children(frontier, threshold, now)), "paths")
        if level == depth - 1:
            leaves.append(found)
            break
        leaves.append(found.filter(F.col("size") <= leaf))
        frontier, now = found.filter(F.col("size") > leaf).hint("merge").join(able.select("node", "mins"), "node").select("path", "node", "mins"), None
    buckets = leaves[0]
    for more in leaves[1:]:
        buckets = buckets.unionByName(more)

    def elements_of(names: DataFrame) -> DataFrame:
        picked = materialize(nodes.hint("merge").join(names, "node").select("pick.doc_id", "pick.row_hash"), "picked").distinct()
        keyed = source.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64("text").alias("row_hash"), "text")
        few = keyed.hint("merge").join(picked.select(F.coalesce("doc_id", F.lit(0)).alias("k"), "row_hash").distinct(), ["k", "row_hash"], "left_semi")
        return _elements(few, words).dropDuplicates(["node"])

    # the low byte of each coordinate is enough to tell whether a pair is worth its exact comparison
    small = low_bytes(able)
    links = materialize(verified_links(buckets, small, elements_of, threshold), "links")
    return labelled(sets, nodes, links)


def low_bytes(nodes: DataFrame) -> DataFrame:
    """nodes with the low byte of each coordinate as mins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u4").astype(np.uint8).reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "n", "copies", "mins"])

    return nodes.select("node", "n", "copies", "mins").mapInArrow(work, "node binary, n long, copies long, mins binary")


def labelled(sets: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Class, copies and links of each row of sets."""
    # nodes in order of their smallest id, so that the smallest node of a component names its class and no class is gathered
    named = lambda c: nodes.select(F.col("node").alias(c), F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "node").alias(f"{c}_named"))
    edges = links.select("node", "other").filter("node <> other").distinct().hint("merge").join(named("node"), "node").hint("merge").join(named("other"), "other")
    class_of = components(edges.select(F.col("node_named").alias("node"), F.col("other_named").alias("other"))).select("node.node", F.col("root.copy_id").alias("class_id"))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    labels = (
        nodes.hint("merge").join(class_of, "node", "left").hint("merge").join(counted, "node", "left")
        .select("node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return sets.select("doc_id", "row_hash", "node").hint("merge").join(materialize(labels, "labels"), "node").select("doc_id", "row_hash", "copy_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the smallest id's; of repeated rows one. Decisions join back by id and text hash."""
    found = similar_documents(docs, id_col, text_col, **options)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = materialize(first.groupBy("class_id").agg(F.min("row_hash").alias("h"), F.count(F.lit(1)).alias("rows")), "chosen")
    c = chosen.select(F.col("class_id").alias("__one_id"), F.col("h").alias("__one_hash"), F.col("rows").alias("__one_rows"))
    kept = docs.hint("merge").join(c, F.col(id_col).cast("long").eqNullSafe(F.col("__one_id")) & (F.xxhash64(F.col(text_col)) == F.col("__one_hash")))
    columns = [F.col(f"`{x}`") for x in docs.columns]
    single = kept.filter("__one_rows = 1").select(*columns)
    if chosen.filter("rows > 1").isEmpty():
        return single
    return single.unionByName(kept.filter("__one_rows > 1").dropDuplicates(["__one_id", "__one_hash"]).select(*columns))
