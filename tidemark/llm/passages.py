"""Substring dedup by paragraphs: MinHash bands tuned for recall, colliding paragraphs joined and verified, removals clustered by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.graph import components

from .common import WordHashes, fold_words, materialize, mix, shingles, texts
from .near_sets import COORDINATES, crowded, distinct, semi, set_name, sketches, verified_links

_STEP = np.uint64(0x9E3779B97F4A7C15)
_REACH = 23
_FLUSH = 100_000


def tune_bands(threshold: float, recall: float, coordinates: int = COORDINATES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have, hence the fewest false candidates, with which pairs at the threshold collide with the chance `recall` within a third of the coordinates."""
    best = (coordinates, 1)
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= coordinates // 3:
            best = (bands, rows)
    return best


def lines_of(parts: list[list[bytes]], least: int) -> Iterator[tuple[int, int]]:
    """(first word, number of words) of each line, and of each block of lines between lines without words, that has at least `least` words. A block of one line is that line."""
    at = begin = lines = 0
    for p in [*parts, []]:
        if len(p) >= least:
            yield at, len(p)
        if p:
            lines += 1
        else:
            if lines > 1 and at - begin >= least:
                yield begin, at - begin
            begin, lines = at, 0
        at += len(p)
        if not p:
            begin = at


def line_sets(shingled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(elements, where each set begins) of the distinct shingles of lines, sorted."""
    owner = np.repeat(np.arange(len(shingled)), [len(x) for x in shingled])
    elements, owner = distinct(np.concatenate(shingled), owner)
    return elements, np.searchsorted(owner, np.arange(len(shingled) + 1))


def windows_of(h: np.ndarray, n: int, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, two hashes) of windows of `least` words. A window begins where a shingle's hash is the smallest of _REACH shingles in a row, so two equal passages of least + _REACH - 1 words have an equal window, wherever they stand."""
    low = np.lib.stride_tricks.sliding_window_view(h, min(_REACH, len(h)))
    at = np.unique(low.argmin(1) + np.arange(len(low)))
    at = at[at <= n - least]
    one, two = np.full(len(at), _STEP), np.zeros(len(at), np.uint64)
    for j in [*range(0, least - words, words), least - words]:  # together these shingles hold each word
        one, two = mix(one * _STEP + h[at + j]), mix(two + (h[at + j] ^ _STEP))
    return at, one, two


def _banded(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each sketch, of coordinates spread over it."""
    at = np.arange(bands * rows) * (COORDINATES // (bands * rows))
    m, key = mins[:, at].astype(np.uint64).reshape(-1, rows, bands), np.arange(1, bands + 1, dtype=np.uint64)[None, :]
    for j in range(rows):
        key = mix(key * _STEP + m[:, j])
    return key


_FIELDS = [("doc_id", pa.int64()), ("row_hash", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("words", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("mins", pa.binary())]
_DDL = "doc_id long, row_hash long, kind int, start long, words long, h1 long, h2 long, node binary, n long, keys array<long>, mins binary"


def _paragraphs(docs: DataFrame, least: int, words: int, bands: int, rows: int) -> DataFrame:
    """All paragraphs of (doc_id, row_hash, text). Kind 0: lines, with name, size, band keys and a short sketch of their set of shingles; kind 1: windows, with two hashes of their words."""
    schema = pa.schema(_FIELDS)

    def batch(lines: list[tuple], windows: list[tuple]) -> pa.RecordBatch:
        cols: list[list[pa.Array]] = [[] for _ in _FIELDS]
        if lines:
            elements, starts = line_sets([x[4] for x in lines])
            mins = sketches(elements, starts[:-1])
            keys = _banded(mins, bands, rows).view(np.int64)
            short = mins[:, ::4].astype(np.uint8)
            given = {
                **{c: pa.array([x[k] for x in lines], pa.int64()) for k, c in enumerate(("doc_id", "row_hash", "start", "words"))}, "kind": pa.array(np.zeros(len(lines), np.int32)),
                "node": pa.array([set_name(elements[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary()), "n": pa.array(np.diff(starts)),
                "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(lines) + 1) * bands, pa.int32()), pa.array(keys.ravel())), "mins": pa.array([x.tobytes() for x in short], pa.binary()),
            }
            for col, (name, kind) in zip(cols, _FIELDS, strict=True):
                col.append(given[name] if name in given else pa.nulls(len(lines), kind))
        if windows:
            many = np.array([len(w[2]) for w in windows])
            total = int(many.sum())
            given = {
                "doc_id": pa.array([w[0] for w in windows], pa.int64()).take(pa.array(np.repeat(np.arange(len(many)), many))), "row_hash": pa.array(np.repeat([w[1] for w in windows], many), pa.int64()),
                "kind": pa.array(np.ones(total, np.int32)), "start": pa.array(np.concatenate([w[2] for w in windows])), "words": pa.array(np.full(total, least)),
                "h1": pa.array(np.concatenate([w[3] for w in windows]).view(np.int64)), "h2": pa.array(np.concatenate([w[4] for w in windows]).view(np.int64)),
            }
            for col, (name, kind) in zip(cols, _FIELDS, strict=True):
                col.append(given[name] if name in given else pa.nulls(total, kind))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lines, windows, held = WordHashes(), [], [], 0
        for b in batches:
            for doc_id, row_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                parts = [fold_words(line) for line in (text or b"").split(b"\n")]
                flat = [w for p in parts for w in p]
                if len(flat) < least:
                    continue
                h = shingles(hashes.of(flat), words)
                for start, count in lines_of(parts, least):
                    lines.append((doc_id, row_hash, start, count, h[start : start + count - words + 1]))
                    held += count // 4
                windows.append((doc_id, row_hash, *windows_of(h, len(flat), least, words)))
                held += len(windows[-1][2])
                if held >= _FLUSH:
                    yield batch(lines, windows)
                    lines, windows, held = [], [], 0
        if lines or windows:
            yield batch(lines, windows)

    return docs.select("doc_id", "row_hash", "text").mapInArrow(work, _DDL)


def _elements(docs: DataFrame, least: int, words: int) -> DataFrame:
    """(node, elements) of the lines of documents."""
    schema = pa.schema([("node", pa.binary()), ("elements", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            lines, held = [], 0
            for k, text in enumerate(texts(b.column(0))):
                parts = [fold_words(line) for line in (text or b"").split(b"\n")]
                h = shingles(hashes.of([w for p in parts for w in p]), words)
                lines += [h[start : start + count - words + 1] for start, count in lines_of(parts, least)]
                held += len(h)
                if lines and (held > _FLUSH or k == b.num_rows - 1):
                    elements, starts = line_sets(lines)
                    spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                    sets = [np.sort(elements[a:b].view(np.int64)) for a, b in spans]
                    yield pa.RecordBatch.from_arrays([pa.array([set_name(elements[a:b]) for a, b in spans], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)
                    lines, held = [], 0

    return docs.select("text").mapInArrow(work, "node binary, elements array<long>")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 28, words: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """One row per document with repeated passages: doc_id, row_hash, n_repeats, class_ids, partners, removals.

    A paragraph is a line of at least `least` words, a block of lines up to the next line without words (so a paragraph is
    the same however it is wrapped), or a window of `least` words at a place that its content chooses,
    so that passages which begin and end inside lines are found too: every passage of least + 22 = 50 words or more
    that two documents share is found whatever surrounds it, and nothing shorter than `least` words. Lines and blocks are repeats
    if the Jaccard similarity of their sets of runs of `words` words is at least `threshold` (MinHash bands tuned for
    `recall`, then verified exactly), windows if their words are equal. Lines linked directly or over others are one
    class, and so is each repeated window. A class counts only if two distinct ids hold it. In each class the paragraphs
    of its smallest id stay; all others are removals, arrays of (start, end) in words, merged. class_ids holds the
    smallest id of each of the row's classes, partners those other than the row's own id.

    Null, empty and short texts have no paragraphs. Rows with one id are one document; null ids never make a class
    count and their paragraphs are removals. Lines are collapsed by equal sets and windows combined by hash before any
    join, hot classes are split in the join, and no class is gathered: only its smallest and largest id.
    """
    bands, rows = tune_bands(threshold, recall)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    found = materialize(_paragraphs(source, least, words, bands, rows), "paragraphs")
    lines = found.filter("kind = 0")
    nodes = materialize(
        lines.groupBy("node").agg(
            F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("mins").alias("mins"), F.min(F.struct("doc_id", "row_hash")).alias("pick")
        ),
        "line-sets",
    )
    buckets = materialize(crowded(nodes.select(F.explode("keys").alias("path"), "node")), "bands")

    def elements_of(names: DataFrame) -> DataFrame:
        names = materialize(names, "names")
        picked = nodes.hint("merge").join(names, "node").select(F.coalesce("pick.doc_id", F.lit(0)).alias("k"), "pick.row_hash").distinct()
        keyed = source.select(F.coalesce("doc_id", F.lit(0)).alias("k"), "row_hash", "text")
        few = semi(keyed, materialize(picked, "picked"), ["k", "row_hash"])
        return _elements(few, least, words).hint("merge").join(names, "node", "left_semi").dropDuplicates(["node"])

    links = materialize(verified_links(buckets, nodes.select("node", "n", "copies", "mins"), elements_of, threshold), "line-links")
    roots = components(links.select("node", "other"))
    rooted = materialize(nodes.select("node", "low", "high").hint("merge").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low", "high"), "rooted")
    shared = rooted.groupBy("root").agg(F.min("low").alias("class_id"), F.max("high").alias("high")).filter("class_id < high").select("root", "class_id")
    line_classes = materialize(rooted.hint("merge").join(shared, "root").select("node", "class_id"), "line-classes")
    windows = found.filter("kind = 1").select("h1", "h2", "doc_id", "row_hash", "start", "words")
    window_classes = materialize(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("high")).filter("class_id < high").select("h1", "h2", "class_id"), "window-classes")
    columns = ["doc_id", "row_hash", "start", (F.col("start") + F.col("words")).alias("end"), "class_id"]
    hits = lines.select("node", "doc_id", "row_hash", "start", "words").hint("merge").join(line_classes, "node").select(*columns)
    hits = materialize(hits.unionByName(windows.hint("merge").join(window_classes, ["h1", "h2"]).select(*columns)), "repeats")

    row = ["doc_id", "row_hash"]
    before = Window.partitionBy(*row).orderBy("start", "end")
    gone = hits.filter(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = gone.withColumn("reach", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    gone = gone.withColumn("island", F.sum(F.when(F.col("start") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    removals = gone.groupBy(*row, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removals"))
    r = removals.withColumnsRenamed({"doc_id": "r_id", "row_hash": "r_hash"})
    per_row = hits.groupBy(*row).agg(F.count(F.lit(1)).alias("n_repeats"), F.sort_array(F.collect_set("class_id")).alias("class_ids"))
    joined = per_row.hint("merge").join(r, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("row_hash") == F.col("r_hash")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(*row, "n_repeats", "class_ids", F.array_except("class_ids", F.array("doc_id")).alias("partners"), F.coalesce("removals", none).alias("removals"))
