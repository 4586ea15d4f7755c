"""Benchmark decontamination: an FM-index for each shard of training documents, searched backward for test phrases; occurrences are merged to removal spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_words, materialize, texts
from .fm_index import FMIndex

_SHARD_SYMBOLS = 1 << 19
_SHARD_DOCS, _FLUSH_DOCS = 1 << 14, 4096
#: Distinct words of the test items that one pass over the documents knows: what is broadcast as vocabulary stays under some 100 MB.
_VOCABULARY = 1_000_000
#: Bytes of test items that one pass over the documents takes. Their phrases take some ten times as much, on the driver and in each task.
_PASS_BYTES = 32 << 20


class Phrases:
    """The windows of a block of benchmark items: patterns of word numbers, and the items of each pattern. New words get their numbers in `vocabulary`."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int, vocabulary: dict[bytes, int]):
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in fold_words(text or b"")]
            k = min(window, len(ids))
            for s in range(len(ids) - k + 1 if ids else 0):
                found.setdefault(tuple(ids[s : s + k]), set()).add(item)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.items = list(found.values())
        self.patterns = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.patterns[k, window - len(p) :] = p
        self.shortest = int(self.lengths.min()) if len(found) else 0


class _Shard:
    """Documents gathered for one index. Words of no test phrase are 0; stretches too short for any phrase are left out, losing no occurrence."""

    def __init__(self, vocabulary: dict[bytes, int], shortest: int, blocks: list[Broadcast]):
        self.words, self.known, self.shortest, self.blocks = len(vocabulary), vocabulary.get, shortest, blocks
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple] = []
        self.parts: list[np.ndarray] = []
        self.doc_of: list[np.ndarray] = []
        self.word_of: list[np.ndarray] = []
        self.symbols = 0

    def add(self, doc_id, row_hash: int, text: bytes | None) -> None:
        words = fold_words(text or b"")
        k = len(self.docs)
        self.docs.append((doc_id, row_hash, len(words)))
        if not self.shortest or len(words) < self.shortest:
            return
        ids = np.zeros(len(words) + 2, np.int32)
        ids[1:-1] = np.fromiter(map(self.known, words, repeat(0)), np.int32, len(words))
        inside = (ids > 0).view(np.int8)
        edge = np.flatnonzero(np.diff(inside))
        begin, end = edge[::2], edge[1::2]  # words begin .. end - 1, as ids has a 0 in front
        long = end - begin >= self.shortest
        if not long.any():
            return
        begin, end = begin[long], end[long]
        sizes = end - begin + 1  # and a separator
        flat = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        part = ids[flat + 1]  # a stretch is followed by a 0
        self.parts.append(part)
        self.doc_of.append(np.full(len(part), k, np.int32))
        self.word_of.append(flat)
        self.symbols += len(part)

    def search(self) -> Iterator[tuple]:
        """(doc_id, row_hash, n_words, spans, items) of each document gathered: the shard is indexed once and searched for the phrases of every block."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set] = {}
        if self.symbols:
            text, doc_of, word_of = (np.concatenate(x) for x in (self.parts, self.doc_of, self.word_of))
            index = FMIndex(text, self.words)
            found = [self._occurrences(index, block.value, doc_of, word_of, items) for block in self.blocks]
            doc, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((start, doc))
            doc, start, end = doc[by], start[by], end[by]
            for d in np.unique(doc):
                a, b = np.searchsorted(doc, (d, d + 1))
                s, reach = start[a:b], np.maximum.accumulate(end[a:b])
                new = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
                spans[d] = list(zip(s[new].tolist(), reach[np.append(new[1:] - 1, len(s) - 1)].tolist(), strict=True))
        for k, (doc_id, row_hash, n) in enumerate(self.docs):
            yield doc_id, row_hash, n, spans.get(k, []), sorted(i for i in items.get(k, ()) if i is not None)
        self.clear()

    @staticmethod
    def _occurrences(index: FMIndex, phrases: Phrases, doc_of: np.ndarray, word_of: np.ndarray, items: dict[int, set]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, end) of each occurrence of a block's phrases; their items are added to `items`."""
        low, high = index.find(phrases.patterns)
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        which = np.repeat(hit, many)
        places = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        at = index.locate(places)
        doc, start = doc_of[at], word_of[at]
        for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
            items.setdefault(d, set()).update(phrases.items[w])
        return doc, start, start + phrases.lengths[which]


def _spans_of(docs: DataFrame, vocabulary: dict[bytes, int], phrases: list[Phrases]) -> DataFrame:
    """One pass over the documents for the phrases of some blocks, each a broadcast of its own."""
    sc = docs.sparkSession.sparkContext
    known, blocks = sc.broadcast(vocabulary), [sc.broadcast(p) for p in phrases]
    shortest = min((p.shortest for p in phrases if p.shortest), default=0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = [("row_hash", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string()))]

    def batches_of(rows: Iterator[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", id_type), *rest])
        while some := list(islice(rows, _FLUSH_DOCS)):
            cols = list(zip(*some, strict=True))
            cols[3] = [[{"start": s, "end": e} for s, e in x] for x in cols[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, id_type = _Shard(known.value, shortest, blocks), pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, row_hash, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                shard.add(doc_id, row_hash, text)
                if shard.symbols >= _SHARD_SYMBOLS or len(shard.docs) >= _SHARD_DOCS:
                    yield from batches_of(shard.search(), id_type)
        yield from batches_of(shard.search(), id_type)

    return docs.mapInArrow(work, f"doc_id {kind}, row_hash long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>")


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The test items in blocks of about block_bytes each, one block on the driver at a time."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        text = (text or "").encode("utf-8", "surrogatepass")
        held.append((item, text))
        size += len(text) + 16
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 8 << 20, max_words: int = _VOCABULARY, pass_bytes: int = _PASS_BYTES) -> DataFrame:
    """One row per document: doc_id, row_hash, n_words, spans (merged word spans of test phrases), item_ids (as strings, sorted). Ids may be of any type.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A phrase is `window` consecutive words of an
    item; an item of fewer, but not none, is one phrase. Null and empty texts have no words and no spans, items without
    words no phrases; an item with a null id marks spans but is not listed; repeated items count once and repeated
    documents are each searched; without items nothing is marked. row_hash (xxhash64 of the text) with doc_id tells
    rows apart where ids repeat.

    The documents are not shuffled: each task gathers shards of a bounded number of words and documents, indexes each
    once and searches it for the phrases of all blocks of the benchmark. A block of block_bytes is one broadcast. Where the items know
    more than a million distinct words or have more than pass_bytes, a further pass takes the rest, so what a pass
    holds is bounded however large the benchmark; the findings are joined by row.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    passes: list[DataFrame] = []
    vocabulary: dict[bytes, int] = {}
    phrases: list[Phrases] = []
    held = 0
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        if len(vocabulary) >= max_words or held >= pass_bytes:
            passes.append(materialize(_spans_of(rows, vocabulary, phrases), "spans"))
            vocabulary, phrases, held = {}, [], 0
        held += sum(len(text) for _, text in items)
        phrases.append(Phrases(items, window, vocabulary))
    found = _spans_of(rows, vocabulary, phrases)
    if not passes:
        return found
    # only the first pass keeps the documents without findings
    found = reduce(DataFrame.unionByName, [passes[0], *[p.filter(F.size("spans") > 0) for p in [*passes[1:], found]]])
    # rows of one id and text have equal findings: merge the blocks, keep as many rows as there were
    merged = found.groupBy("doc_id", "row_hash").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    merged = merged.select("doc_id", "row_hash", "n_words", F.reduce(F.array_sort("all"), F.slice("all", 1, 0), step).alias("spans"), "item_ids")
    m = merged.withColumnsRenamed({"doc_id": "m_id", "row_hash": "m_hash"})
    return rows.select("doc_id", "row_hash").join(m, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("row_hash") == F.col("m_hash"))).select("doc_id", "row_hash", "n_words", "spans", "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any test phrase, unchanged: decisions of contamination() joined back by id and text hash."""
    found = materialize(contamination(docs, benchmark, id_col, text_col, **options).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__hit_id"), F.col("row_hash").alias("__hit_hash")).distinct(), "contaminated")
    return docs.hint("merge").join(found, F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.xxhash64(F.col(text_col)) == F.col("__hit_hash")), "left_anti")
