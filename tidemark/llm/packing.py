"""Packing: power-of-two decomposition. Each document is cut into pieces of power-of-two length, equal lengths share a bucket, no sequence crosses documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import cached_encoder

_FLUSH_BYTES = 16 << 20


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of length `longest` as fit, then the binary digits of the rest, largest first."""
    out, at = [], 0
    size = longest
    while at < n:
        while size > n - at:
            size >>= 1
        out.append((at, size))
        at += size
    return out


def numbered(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """rows with `name`: the sum of `weight` over all rows before, in the given order, whatever the partitioning.

    Rows are sorted by ranges and summed inside each; only the ranges' totals, one number for each task, reach the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            sums = np.cumsum(b.column(b.schema.get_field_index(weight)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done + sums - np.diff(sums, prepend=0))], [*b.schema.names, name])
            done += int(sums[-1]) if len(sums) else 0

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", part int, {name} long"
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    inside = materialize(sorted_.mapInArrow(work, schema), "ranges")
    totals = inside.groupBy("part").agg(F.sum(weight).alias("total")).orderBy("part").collect()
    before = np.cumsum([0, *[t.total for t in totals]])
    if not totals:
        return inside.drop("part")
    firsts = rows.sparkSession.createDataFrame([(t.part, int(n)) for t, n in zip(totals, before, strict=False)], "part int, __before long")
    return inside.join(F.broadcast(firsts), "part").withColumn(name, F.col(name) + F.col("__before")).drop("part", "__before")


def pack_power_of_two(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per sequence: doc_id, start, length, doc_tokens, sequence_id, offset, bucket (log2 of length), ids (binary, little-endian unsigned 32-bit).

    A document's tokens are its text's ids and then end_id. Each sequence is one whole piece, so lengths are powers of
    two up to `longest`, nothing is padded, offset is 0, and a batch taken from one bucket has one length. Null and
    empty texts are the one token end_id; repeated rows are packed each; a null id stays null. Long documents are
    emitted piece by piece. sequence_id counts from 0 in order of doc_id (null first), text hash, copy and start, so it does not depend on
    partitioning: the pieces are written once, documents are numbered by their piece counts, and the numbers join back.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached_encoder(tokenizer)
        for batch in batches:
            values, held = batch.column(2), 0
            picked: list[int] = []
            cols: list[list] = [[] for _ in range(5)]

            def flush() -> pa.RecordBatch:
                own = batch.select(["doc_id", "row_hash"]).take(pa.array(picked, pa.int64()))  # noqa: B023
                numbers = [pa.array(c, pa.int64()) for c in cols[:4]]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own.columns, *numbers, pa.array(cols[4], pa.binary())], ["doc_id", "row_hash", "start", "length", "doc_tokens", "piece", "ids"])  # noqa: B023

            for k in range(batch.num_rows):
                ids = encode(values[k].as_py() or "") + end
                n = len(ids) // 4
                for piece, (start, length) in enumerate(cut(n, longest)):
                    picked.append(k)
                    for col, x in zip(cols, (start, length, n, piece, ids[4 * start : 4 * (start + length)]), strict=True):
                        col.append(x)
                held += len(ids)
                if held >= _FLUSH_BYTES:
                    yield flush()
                    picked, cols, held = [], [[] for _ in range(5)], 0
            if picked:
                yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = materialize(rows.mapInArrow(work, f"doc_id {kind}, row_hash long, start long, length long, doc_tokens long, piece long, ids binary"), "pieces")
    # the copies of a repeated row take their numbers one after the other
    counts = (F.floor(F.col("doc_tokens") / longest) + F.bit_count(F.col("doc_tokens") % longest)).cast("long").alias("pieces")
    owners = pieces.filter("start = 0").groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("copies"), F.first(counts).alias("pieces")).withColumn("all", F.col("copies") * F.col("pieces"))
    firsts = numbered(owners, ["doc_id", "row_hash"], "all", "first")
    mine = firsts.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), "first", "pieces", "copies")
    found = pieces.hint("merge").join(mine, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash")))
    numbers = lambda copy: (F.col("first") + copy * F.col("pieces") + F.col("piece")).alias("sequence_id")
    columns = lambda copy: ["doc_id", "start", "length", "doc_tokens", numbers(copy), F.lit(0).cast("long").alias("offset"), (F.log2("length") + 0.5).cast("int").alias("bucket"), "ids"]
    once = found.filter("copies = 1").select(*columns(F.lit(0)))
    if firsts.filter("copies > 1").isEmpty():
        return once
    # a row of a thousand copies is spread by its pieces; each piece's copies are told apart by their number alone
    w = Window.partitionBy("__id", "__hash", "piece").orderBy("start")
    return once.unionByName(found.filter("copies > 1").withColumn("__copy", F.row_number().over(w) - 1).select(*columns(F.col("__copy"))))


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Store sequences by bucket: path/bucket=k holds those of 2**k tokens."""
    sequences.write.partitionBy("bucket").parquet(path)
