"""Shared helpers: words as numbers, groups inside a task; and the tables of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tidemark.tables import discard, materialize, new_path  # noqa: F401  (the operators take them from here)

#: Bytes of a text to word bytes: A-Z lower-cased, ASCII other than 0-9 and a-z to a blank; bytes of 0x80 and more stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CACHED_WORDS = 250_000


def fold_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text after lower-casing A-Z."""
    return text.translate(_FOLD).split()


class WordHashes(dict):
    """word -> 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of the public SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order; of the whole text where it has fewer than k words but some."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out + hashes[j : len(hashes) - k + 1 + j] + np.uint64(0x9E3779B97F4A7C15))
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def by_group(batches: Iterator[pa.RecordBatch], key: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Feed rows sorted by key to work(table, starts) so that each call gets whole groups: starts holds each group's first row.

    Holds about `rows` rows and the largest group at once; callers bound the size of a group.
    """

    def starts_of(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        if table.num_rows:
            new[0] = True
            for k in key:
                col = table[k].combine_chunks() if isinstance(table[k], pa.ChunkedArray) else table[k]
                new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    count, want = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < want:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of(table)
        if len(starts) > 1:
            yield from work(table.slice(0, starts[-1]), starts[:-1])
            table = table.slice(starts[-1])
            # copied, so that the done part can go
            table = table.take(pa.array(np.arange(table.num_rows)))
        held, count = table.to_batches(), table.num_rows
        want = max(rows, 2 * count)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from work(table, starts_of(table))
