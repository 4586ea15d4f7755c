"""Cross-tokenizer alignment: tokens of two tokenizers that cover the same bytes are linked; a linked id pair is counted by documents in dense vectors that a minimal perfect hash indexes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix
from .tokens import _byte_letters

#: A text longer than this (in characters) is aligned piece by piece, cut where a single blank stands between two words.
_SEGMENT = 1 << 20
#: Keys of a shard of the hash, on average.
_SHARD = 1 << 15
#: Keys whose counts are sent to the executors at once: 14 bytes each with the hash, some 60 MB. More keys take further passes over the documents' pairs.
PASS_KEYS = 4_000_000
#: Pairs that are held before they are merged, and that a row batch has or a look-up takes at once.
_HELD_PAIRS = 2_000_000
_HELD_LINKS = 500_000
#: Words whose alignment a task remembers, and characters that are encoded at once.
_REMEMBERED, _TOGETHER = 400_000, 1 << 18
_NEXT_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO_BLANKS = re.compile(r"\s\s|\s\Z")
_BEFORE_WORD = re.compile(r"(?<=\S)(?=[ \n]\S)")

#: How a word is aligned: tokens on either side, groups, its links' pairs (4 bytes each), and its groups as written with a semicolon after each.
Aligned = tuple[int, int, int, bytes, bytes]


def _fast_byte_level(made, spec: dict, ids: dict[bytes, int]) -> Callable[[str], list[int]]:
    """The tokenizer's encoding by the tiktoken library, which is several times faster, where both are sure to agree; else by the tokenizer itself.

    tiktoken merges any two neighbours that make a token, the token of the lowest id first; the tokenizer merges listed
    pairs in their order. They agree where the list is in order of its tokens' ids and every token's bytes alone are encoded
    as that token: inside a token's stretch of a word nothing reaches in from outside before the token is made, so
    merging goes there as it does for the token alone, and the last two parts are its listed pair.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made_by = [spec["model"]["vocab"][a + b] for a, b in merges]
    letters = _byte_letters()
    whole = lambda t: [x.id for x in made.model.tokenize("".join(letters[c] for c in t))]
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for t, i in ids.items() if i not in special}
    if made_by == sorted(made_by) and all(len(t) == 1 or whole(t) == [i] for t, i in ranks.items()) and not any(spec["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: made.encode(text, add_special_tokens=False).ids


class Aligner:
    """Encodes words both ways and tells the links and groups of their tokens.

    Text is cut into words before every blank or line end that stands between two other signs: tokens of neither side
    go over such a place (a byte-level token begins with a blank at most, no sentence piece holds one after another
    sign), so a text's tokens are those of its words, and a word's alignment is found once and remembered. Words that
    are not known yet are encoded together.
    """

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(first)
        made.encode_special_tokens = True  # their strings are plain text
        spec = json.loads(made.to_str())
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("the first tokenizer must be byte-level, without a normalizer or a prefix")
        back = {c: b for b, c in _byte_letters().items()}
        self.a_bytes = [b""] * made.get_vocab_size()
        for piece, i in made.get_vocab().items():
            self.a_bytes[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        self.first = _fast_byte_level(made, spec, {t: i for i, t in enumerate(self.a_bytes)})
        self.second = second_ = sentencepiece.SentencePieceProcessor(model_file=second)
        names = [second_.id_to_piece(i) for i in range(second_.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if second_.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        plain = [p for i, p in enumerate(self.b_bytes) if not (second_.is_byte(i) or second_.is_control(i) or second_.is_unknown(i))]
        if any(b" " in p.lstrip(b" ") or b"\n" in p for p in plain):
            raise ValueError("the second tokenizer must not have pieces over several words or with line ends")
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("pairs of the two vocabularies must fit 32 bits")
        self.a_len = np.array([len(p) for p in self.a_bytes], np.int64)
        self.b_len = np.array([len(p) for p in self.b_bytes], np.int64)
        # how an id is written: by itself and a comma, or the end of its side
        self.names = [b"%d%c" % (i, c) for n, ends in ((self.n_a, b",|"), (self.n_b, b",;")) for c in ends for i in range(n)]
        self.known: dict[str | tuple[str], Aligned | None] = {}

    def words(self, segment: str) -> list[str | tuple[str]]:
        """Words of a text that begins with a blank: one with a blank before it without that, one with a line end with it, any other as a tuple."""
        text = segment[1:]
        if not _TWO_BLANKS.search(segment):
            return text.replace("\n", " \n").split(" ")
        return [w[1:] if w[0] == " " and len(w) > 1 and w[1] not in " \n" else w if w[0] == "\n" else (w,) for w in _BEFORE_WORD.split(segment)]

    def learn(self, words: Iterable[str | tuple[str]]) -> None:
        """Align the words that are not known yet."""
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        held, size = [], 0
        for word in set(words) - self.known.keys():
            held.append(word)
            size += len(word)
            if size > _TOGETHER:
                self._align(held)
                held, size = [], 0
        if held:
            self._align(held)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where their bytes are not the texts'."""
        whole = "".join(texts)
        a = self.first(whole)
        # the second puts a blank before a text by itself; before a line end it is a token of its own
        each = self.second.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        b = [i for t, ids in zip(texts, each, strict=True) for i in (ids if t[0] == " " else ids[1:])]
        whole = whole.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _align(self, keys: list[str | tuple[str]]) -> None:
        texts = [k[0] if isinstance(k, tuple) else k if k[:1] == "\n" else " " + k for k in keys]
        apart = [k for k, t in enumerate(texts) if t[-1].isspace() or isinstance(keys[k], tuple)]
        if apart and len(keys) > 1:
            for k in apart:
                self._align([keys[k]])
            rest = sorted(set(range(len(keys))) - set(apart))
            if rest:
                self._align([keys[k] for k in rest])
            return
        found = self._encoded(texts)
        if found is None:
            if len(keys) == 1:
                self.known[keys[0]] = None
            else:
                half = len(keys) // 2
                self._align(keys[:half])
                self._align(keys[half:])
            return
        a, b = found
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        word_end = np.cumsum([len(t.encode()) for t in texts])
        # each stretch between two neighbouring ends is in just one token of each side
        ends = np.union1d(a_end, b_end)
        links = (a[np.searchsorted(a_end, ends)] * self.n_b + b[np.searchsorted(b_end, ends)]).astype("<u4").tobytes()
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = np.searchsorted(a_end, common), np.searchsorted(b_end, common)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        order = np.empty(len(a) + len(b), np.int64)
        written_a, written_b = a.copy(), b + 2 * self.n_a
        written_a[a_last] += self.n_a
        written_b[b_last] += self.n_b
        order[np.arange(len(a)) + np.concatenate([[0], b_last + 1])[a_group]] = written_a
        order[np.arange(len(b)) + a_last[b_group] + 1] = written_b
        written = list(map(self.names.__getitem__, order.tolist()))
        upto = lambda at: [0, *np.searchsorted(at, word_end, "right").tolist()]
        n_a, n_b, n_links, n_groups = upto(a_end), upto(b_end), upto(ends), upto(common)
        for k, key in enumerate(keys):
            a0, a1, b0, b1 = n_a[k], n_a[k + 1], n_b[k], n_b[k + 1]
            self.known[key] = (a1 - a0, b1 - b0, n_groups[k + 1] - n_groups[k], links[4 * n_links[k] : 4 * n_links[k + 1]], b"".join(written[a0 + b0 : a1 + b1]))

    def aligned(self, text: str, words: list[str | tuple[str]] | None = None) -> Iterator[tuple[int, int, int, np.ndarray, bytes]]:
        """Tokens of both sides, groups, pairs of links and written groups of each part of blank + text; raises Unaligned where the tokens' bytes are others."""
        for words in [words] if words else map(self.words, segments(text)):
            try:
                found = list(map(self.known.__getitem__, words))
            except KeyError:
                self.learn(words)
                found = list(map(self.known.__getitem__, words))
            if None in found:
                raise Unaligned
            n_a, n_b, groups, links, written = zip(*found, strict=True)
            yield sum(n_a), sum(n_b), sum(groups), np.frombuffer(b"".join(links), "<u4"), b"".join(written)


class Unaligned(ValueError):
    """The tokens' bytes are not those of the text."""


def segments(text: str) -> Iterator[str]:
    """Blank + text in parts that begin with a blank."""
    text, at = " " + text, 0
    while at < len(text):
        cut = _NEXT_CUT.search(text, at + _SEGMENT) if len(text) - at > _SEGMENT else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_made: dict[tuple[str, str], Aligner] = {}


def _aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _made:
        _made[first, second] = Aligner(first, second)
    return _made[first, second]


def _texts(aligner: Aligner, column: pa.Array) -> Iterator[tuple[str | None, list[str | tuple[str]] | None]]:
    """A column's texts, with their words where they are not long, after the words of the next few million characters were learned together."""
    held: list[tuple[str | None, list[str | tuple[str]] | None]] = []
    size = 0
    for text in column:
        text = text.as_py()
        held.append((text, aligner.words(" " + text) if text and len(text) <= _SEGMENT else None))
        size += len(text or "")
        if size > 4 * _SEGMENT:
            aligner.learn(w for _, words in held if words for w in words)
            yield from held
            held, size = [], 0
    aligner.learn(w for _, words in held if words for w in words)
    yield from held


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(0x51ED270B)) % np.uint64(shards)).astype(np.int64)


def _spots(keys: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(keys.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
    return (h % np.asarray(sizes).astype(np.uint64)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: sizes of its levels in bits, the bits, and the keys in order of their number.

    A key that falls alone on a bit of a level owns it, the others go to the next level; a key's number is how many bits
    are set before its own.
    """
    sizes, bits, ordered = [], [], []
    left = keys
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _spots(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        ordered.append(left[mine][np.argsort(at[mine])])
        sizes.append(size)
        bits.append(alone)
        left = left[~mine]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(ordered) if ordered else keys


class PairHash:
    """The hashes of some shards joined: numbers run through the shards in order; `of` gives -1 for keys of other shards."""

    def __init__(self, shards: int, parts: list[tuple[int, list[int], bytes]]):
        """parts: (shard, sizes of levels, packed bits), in order of shard."""
        self.shards = shards
        levels = max([len(s) for _, s, _ in parts], default=0)
        self.size, self.start = np.zeros((levels, shards), np.int64), np.zeros((levels, shards), np.int64)
        at = 0
        for shard, sizes, _ in parts:
            for level, size in enumerate(sizes):
                self.size[level, shard], self.start[level, shard] = size, at
                at += size
        self.words = np.frombuffer(b"".join(bits for _, _, bits in parts), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.n = int(self.before[-1])

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        shard, left = _shard_of(keys, self.shards), np.arange(len(keys))
        for level in range(len(self.size)):
            size = self.size[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            at = self.start[level, shard[left]] + _spots(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[at >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def aligned_texts(docs: DataFrame, first: str, second: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each (doc_id, text).

    pairs holds the distinct pairs linked in the text in order and times how often each is, 4 bytes a number. A pair is
    first id * size of the second vocabulary + second id. Texts without tokens have zeros, '' and no pairs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(first, second)
        for b in batches:
            rows: list[tuple] = []
            size = start = 0
            for k, (text, words) in enumerate(_texts(aligner, b.column(1))):
                rows.append(_row_of(aligner, text, words))
                size += len(rows[-1][-1]) // 4
                if size > _HELD_LINKS or k == b.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ALIGNED_ARROW, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(rows)), *columns], ["doc_id", *[c for c, _ in _ALIGNED]])
                    rows, size, start = [], 0, k + 1

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in _ALIGNED))


def _row_of(aligner: Aligner, text: str | None, words: list[str | tuple[str]] | None) -> tuple:
    """A row of aligned_texts() without its id."""
    sums, digest, late = np.zeros(4, np.int64), hashlib.sha256(), b""
    keys: list[np.ndarray] = []
    times: list[np.ndarray] = []
    n = 0
    try:
        for n_a, n_b, n_groups, links, written in aligner.aligned(text, words) if text else ():
            sums += n_a, n_b, n_groups, len(links)
            digest.update(late)
            digest.update(written[:-1])
            late = b";"
            found, often = np.unique(links, return_counts=True)
            keys.append(found)
            times.append(often)
            n += len(found)
            if n > _HELD_PAIRS:
                found, often = _merged(keys, times)
                keys, times, n = [found], [often], 0
    except Unaligned:
        keys = []
    if not keys:
        return 0, 0, 0, 0, "", b"", b""
    found, often = _merged(keys, times) if len(keys) > 1 else (keys[0], times[0])
    return *sums.tolist(), digest.hexdigest(), found.astype("<u4").tobytes(), often.astype("<u4").tobytes()


def _numbers(column: pa.Array) -> np.ndarray:
    """The numbers of a column of 4 bytes a number, joined."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4")


def pair_documents(aligned: DataFrame) -> DataFrame:
    """(pair, docs): documents of a task that hold a pair linked; a pair has a row for each task that met it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        n = 0
        for b in batches:
            pairs = _numbers(b.column(0))
            for at in range(0, len(pairs), _HELD_LINKS):
                held.append(pairs[at : at + _HELD_LINKS].astype(np.int64))
                counts.append(np.ones(len(held[-1]), np.int64))
                n += len(held[-1])
                if n > _HELD_PAIRS:
                    keys, sums = _merged(held, counts)
                    if len(keys) > _HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "docs"])
                        keys, sums = keys[:0], sums[:0]
                    held, counts, n = [keys], [sums], len(keys)
        if held:
            keys, sums = _merged(held, counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "docs"])

    return aligned.select("pairs").mapInArrow(work, "pair long, docs long")


def _hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, n, sizes, bits, keys): the hash of each shard's distinct pairs, a group of some 32,768 keys."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_shard_of(b.column(0).to_numpy(zero_copy_only=False), shards))], ["pair", "shard"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(table["pair"].to_numpy())
        sizes, bits, ordered = build_hash(keys)
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"shard": table["shard"][:1].combine_chunks(), "n": pa.array([len(keys)]), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([packed]), "keys": pa.array([ordered.astype("<i8").tobytes()])})

    return pairs.mapInArrow(named, "pair long, shard long").groupBy("shard").applyInArrow(build, "shard long, n long, sizes array<long>, bits binary, keys binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense vectors of the same shard and branch added."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for shard, branch, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            v = np.frombuffer(counts, "<i8")
            if (shard, branch) in sums:
                sums[shard, branch] += v
            else:
                sums[shard, branch] = v.copy()
    for (shard, branch), v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([branch]), pa.array([v.tobytes()])], ["shard", "branch", "counts"])


_VECTOR = "shard long, branch long, counts binary"


def _blocks(hashes: DataFrame, limit: int) -> list[list[int]]:
    """Shards in runs of at most `limit` keys (or a single shard)."""
    out: list[list[int]] = [[]]
    total = 0
    for r in hashes.select("shard", "n").orderBy("shard").toLocalIterator():
        if out[-1] and total + r.n > limit:
            out.append([])
            total = 0
        out[-1].append(r.shard)
        total += r.n
    return [b for b in out if b]


def _joined(hashes: DataFrame, block: list[int], shards: int) -> PairHash:
    rows = hashes.filter(F.col("shard").between(block[0], block[-1])).select("shard", "sizes", "bits").orderBy("shard").collect()
    return PairHash(shards, [(r.shard, list(r.sizes), bytes(r.bits)) for r in rows])


def pair_counts(partial: DataFrame, pass_keys: int = PASS_KEYS) -> tuple[DataFrame, int]:
    """The counted pairs as a table (shard, n, sizes, bits, keys, counts), and the number of shards.

    partial: rows of pair_documents. Its distinct pairs are hashed shard by shard; tasks add their counts to dense
    vectors indexed by the hash, and the vectors are summed by a tree of two levels. The key set is bounded by the two
    vocabularies, not by the documents.
    """
    spark = partial.sparkSession
    distinct = materialize(partial.select("pair").distinct(), "align-pairs")
    shards = max(1, -(-distinct.count() // _SHARD))
    hashes = materialize(_hashes(distinct, shards), "align-hash")
    sums = None
    for block in _blocks(hashes, pass_keys):
        sent = spark.sparkContext.broadcast((_joined(hashes, block, shards), {r.shard: r.n for r in hashes.filter(F.col("shard").between(block[0], block[-1])).select("shard", "n").collect()}))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            pairs, sizes = sent.value
            dense = np.zeros(pairs.n, np.int64)
            for b in batches:
                at = pairs.of(b.column(0).to_numpy(zero_copy_only=False))
                np.add.at(dense, at[at >= 0], b.column(1).to_numpy(zero_copy_only=False)[at >= 0])
            branch, at = TaskContext.get().partitionId() % 16, 0
            for shard in sorted(sizes):
                part = dense[at : at + sizes[shard]]
                at += sizes[shard]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([branch]), pa.array([part.tobytes()])], ["shard", "branch", "counts"])

        low = partial.mapInArrow(count, _VECTOR).repartition("shard", "branch").mapInArrow(_summed, _VECTOR)
        high = low.withColumn("branch", F.lit(0).cast("long")).repartition("shard").mapInArrow(_summed, _VECTOR).select("shard", "counts")
        sums = high if sums is None else sums.union(high)
    if sums is None:
        return hashes.withColumn("counts", F.lit(None).cast("binary")), shards
    return materialize(hashes.join(sums, "shard"), "align-counts"), shards


def counted_pairs(table: DataFrame, second_size: int) -> DataFrame:
    """(a, b, docs) of every pair of pair_counts()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = np.frombuffer(keys, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(k // second_size), pa.array(k % second_size), pa.array(np.frombuffer(counts, "<i8"))], ["a", "b", "docs"])

    return table.select("keys", "counts").mapInArrow(work, "a long, b long, docs long")


_ALIGNED = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), ("pairs", "binary"), ("times", "binary")]
_ALIGNED_ARROW = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for _, t in _ALIGNED]
_ROW = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align_documents(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", pass_keys: int = PASS_KEYS) -> DataFrame:
    """One row per document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first: a byte-level BPE file; second: a sentencepiece file; both readable on every executor. Texts null, empty or
    with tokens of other bytes than their own (as with the sign U+2581) have zeros and ''. Repeated rows count each and
    each have a row; ids of any type that Parquet holds, null too, are handed on. A very long text is aligned piece by
    piece, so only its parts and its distinct pairs are held. A link's count is the number of documents (rows) that hold
    its id pair linked.

    Texts are read and aligned once; a document's distinct pairs, and how often it links each, are written to the shared
    folder. From there pairs are counted (see pair_counts), and the counts looked up by the hash, whose stored keys
    verify each. Where the counts are more than pass_keys, that is done once for each part of them and its sums are added.
    """
    spark: SparkSession = docs.sparkSession
    rows = aligned_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), first, second)
    aligned = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "align-texts")
    partial = materialize(pair_documents(aligned), "align-partial")
    table, shards = pair_counts(partial, pass_keys)
    size = _aligner(first, second).n_b
    highest = {r.a: r.top for r in counted_pairs(table, size).groupBy("a").agg(F.max("docs").alias("top")).toLocalIterator()}
    tops = np.zeros(max(highest, default=0) + 1, np.int64)
    for a, top in highest.items():
        tops[a] = top
    own = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = f"doc_id {aligned.schema['doc_id'].dataType.simpleString()}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    parts = []
    for block in _blocks(table, pass_keys) or [[]]:
        found = table.filter(F.col("shard").between(block[0], block[-1])).orderBy("shard").collect() if block else []
        keys, counts = (np.frombuffer(b"".join(bytes(r[c]) for r in found), "<i8") for c in ("keys", "counts"))
        sent = spark.sparkContext.broadcast((PairHash(shards, [(r.shard, list(r.sizes), bytes(r.bits)) for r in found]), keys, counts, tops))
        parts.append(aligned.select("doc_id", "row", *own, "pairs", "times").mapInArrow(_look_up(size, sent), schema))
    if len(parts) == 1:
        return parts[0].select(*_ROW)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("row").agg(*[F.first(n).alias(n) for n in ("doc_id", *own)], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select(*_ROW)


def _look_up(second_size: int, sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of aligned_texts() with n_best and count_sum, by the counts that were sent, for their pairs and times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, keys, counts, tops = sent.value
        for b in batches:
            pairs, times = _numbers(b.column(7)), _numbers(b.column(8))
            row = np.repeat(np.arange(b.num_rows, dtype=np.int32), [n // 4 for n in pc.binary_length(b.column(7)).to_pylist()])
            n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for start in range(0, len(pairs), _HELD_LINKS):
                links = pairs[start : start + _HELD_LINKS].astype(np.int64)
                at = hashed.of(links)
                mine = at >= 0
                mine[mine] = keys[at[mine]] == links[mine]
                docs, held, often = counts[at[mine]], row[start : start + _HELD_LINKS][mine], times[start : start + _HELD_LINKS][mine].astype(np.int64)
                np.add.at(n_best, held, often * (docs == tops[links[mine] // second_size]))
                np.add.at(count_sum, held, often * docs)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(n_best), pa.array(count_sum)], [*b.schema.names[:7], "n_best", "count_sum"])

    return work
