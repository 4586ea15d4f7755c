"""Media columns: texts kept as FLAC streams, read back as PCM with seekable blocks, and features of the samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts
from .flac import BLOCK, GROUP, decode, encode

UNIT = 64


def padded(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def _chunks(values: list[bytes], size: int) -> Iterator[list[bytes]]:
    held, total = [], 0
    for v in values:
        if held and total + len(v) > size:
            yield held
            held, total = [], 0
        held.append(v)
        total += len(v)
    if held:
        yield held


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as the 8-bit samples of a FLAC stream. Null is empty; repeated rows are kept each; equal texts give equal streams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for part in _chunks([padded(t or b"") for t in texts(b.column(1))], GROUP):
                rows = b.slice(done, len(part))
                sizes = [len(t or b"") for t in texts(rows.column(1))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(encode(part), pa.binary())], ["doc_id", "n_bytes", "media"])
                done += len(part)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def _feature(pcm: bytes, blocks: int) -> str:
    """Exact integers of the samples: blocks, peak, sum of squares, sign changes. Longer texts go by parts."""
    peak = energy = crossings = 0
    for at in range(0, len(pcm), GROUP):
        x = np.frombuffer(pcm[max(0, at - 1) : at + GROUP], np.uint8).astype(np.int32) - 128  # with the sample before
        crossings += int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        x = x[1 if at else 0 :]
        peak, energy = max(peak, int(np.abs(x).max())), energy + int((x * x).sum(dtype=np.int64))
    return f"blocks={blocks};peak={peak};energy={energy};crossings={crossings}"


def from_media(media: DataFrame) -> DataFrame:
    """media with `pcm` (the samples as unsigned bytes), `blocks` (first_sample, samples, frame_offset of each block) and `feature`.

    Rice residuals and linear predictors are decoded, every frame's CRC-8 and CRC-16 and the stream's MD5 verified; a
    damaged stream raises an error. frame_offset counts from the end of the metadata, so a reader can seek any sample.
    """
    kind = pa.list_(pa.struct([("first_sample", pa.int64()), ("samples", pa.int64()), ("frame_offset", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for part in _chunks(b.column(2).to_pylist(), GROUP):
                rows = b.slice(done, len(part))
                got = decode(part)
                blocks = [[{"first_sample": x.first_sample, "samples": x.samples, "frame_offset": x.frame_offset} for x in g[1]] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([g[0] for g in got], pa.binary()), pa.array(blocks, kind), pa.array([_feature(g[0], len(g[1])) for g in got], pa.string())], [*rows.schema.names, "pcm", "blocks", "feature"]
                )
                done += len(part)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, media binary, pcm binary, blocks array<struct<first_sample:long,samples:long,frame_offset:long>>, feature string")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, first_sample, samples, frame_offset, pcm): the decoded blocks of each stream as rows of at most 4096 samples, ready to be written.

    A reader that wants a sample takes the block of its first_sample, or seeks the stream's frame by frame_offset.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("first_sample", pa.int64()), ("samples", pa.int64()), ("frame_offset", pa.int64()), ("pcm", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, stream in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ((pcm, blocks),) = decode([stream])
                for at in range(0, len(blocks), GROUP // BLOCK):
                    some = blocks[at : at + GROUP // BLOCK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int64()), *(pa.array([getattr(x, c) for x in some], pa.int64()) for c in ("first_sample", "samples", "frame_offset")),
                         pa.array([pcm[x.first_sample : x.first_sample + x.samples] for x in some], pa.binary())], schema=schema)

    return media.select("doc_id", "media").mapInArrow(work, "doc_id long, block long, first_sample long, samples long, frame_offset long, pcm binary")


def stored(media: DataFrame) -> DataFrame:
    """media written to the shared folder and read back from there."""
    return materialize(media, "media")
