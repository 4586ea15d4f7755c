"""Toxicity: embeddings of character n-grams averaged over a few words into a linear softmax, trained jointly; a document is as toxic as its windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: A text is scored in windows of this many words.
WINDOW = 3
_BUCKETS, _SIZE = 1 << 16, 10
_SHORTEST, _LONGEST = 3, 6
#: A word longer than this goes in pieces.
_WORD = 40
_CACHED_WORDS = 500_000
#: Documents of a training step.
_BATCH = 128
#: Windows less probable than this add nothing to a document, so that its length alone does not.
_FLOOR = 0.05
#: A text is read in pieces of this many characters.
_PIECE = 1 << 20
_SPACE = re.compile(r"\s+")
#: Signs that stand in for letters inside a word.
_LOOK_ALIKES = str.maketrans("013457@$!", "oieastasi")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’–—…¡¿"


def words_of(text: str) -> list[str]:
    """What stands between white space, in lower case, long ones in pieces."""
    found = text.lower().split()
    if max(map(len, found), default=0) <= _WORD:
        return found
    return [w[k : k + _WORD] for w in found for k in range(0, len(w), _WORD)]


def _plain(word: str) -> str:
    """A word without signs at its ends; digits and signs between letters count as the letters they look like."""
    word = word.strip(_EDGE)
    return word if word.isalpha() or word.isdigit() else word.translate(_LOOK_ALIKES)


def subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, each with marks at both ends, and the place of the word that each is of; none for words of signs alone."""
    plain = [_plain(w) for w in words]
    size = np.array([len(w) + 2 if w else 0 for w in plain], np.int64)
    signs = np.frombuffer("".join(f"<{w}>" for w in plain if w).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(plain)), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(signs))  # signs from here to the word's end
    buckets, owners = [], []
    hashed = signs
    for n in range(2, _LONGEST + 1):
        hashed = mix(hashed[:-1] * np.uint64(0x100000001B3) + signs[n - 1 :] + np.uint64(n))
        if n >= _SHORTEST:
            inside = room[: len(hashed)] >= n
            buckets.append((hashed[inside] % np.uint64(_BUCKETS)).astype(np.int64))
            owners.append(of[: len(hashed)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """pull: what each bucket adds to the softmax's log odds of toxic; bias: log odds of an empty window; leak: probability of a label without a reason in the text."""

    pull: np.ndarray
    bias: float
    leak: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _n_grams_of(docs: Iterable[tuple[list[str], int]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Documents as numbers of their words, their labels, and the n-grams of word k: grams[start[k] : start[k + 1]]. Words without n-grams are left out, and documents without words."""
    number: dict[str, int] = {}
    numbered, given = [], []
    for words, label in docs:
        numbered.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
        given.append(label)
    grams, of = subwords(list(number))
    grams = grams[np.argsort(of, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(number)))])
    real = np.diff(start) > 0
    found = [ids[real[ids]] for ids in numbered]
    labels = np.array([label for ids, label in zip(found, given, strict=True) if len(ids)], np.int64)
    return [ids for ids in found if len(ids)], labels, grams, start


def _ranges(start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of the given words, and which of the words each is of."""
    n = start[words + 1] - start[words]
    of = np.repeat(np.arange(len(words)), n)
    return np.arange(len(of)) + np.repeat(start[words] - np.cumsum(n) + n, n), of


def fit(rows: Iterable[tuple[list[str], int]], steps: int = 640, seed: int = 11, rate: float = 1.0, drop: float = 0.7, rarest: int = 5) -> Model:
    """Train on (words, label) of documents: embeddings and softmax together.

    A window's vector is the average of its words', a word's the average of its n-grams'; the softmax tells the window's
    probability p. A document is toxic with probability 1 - (1 - leak) * product(1 - p): which window is toxic is not
    labelled, and the leak, half the share of toxic labels, stands for labels without a reason in the text. In each step
    a part of a word's n-grams is left out of its average, as if they were unknown, so that a misspelt word is told by
    those it keeps. The documents are gone through until `steps` steps are made. N-grams of fewer than `rarest` documents stay unknown. Adagrad, one rate for each n-gram.

    Without toxic labels nothing is toxic (score 0), with no others everything (score 1).
    """
    docs, labels, grams, start = _n_grams_of(rows)
    if not labels.any() or labels.all():
        return Model(np.zeros(_BUCKETS), -60.0, float(len(labels) > 0 and labels.all()))
    rng = np.random.default_rng(seed)
    seen = np.zeros(_BUCKETS, np.int64)
    for ids in docs:
        seen[np.unique(grams[_ranges(start, np.unique(ids))[0]])] += 1
    usual = seen >= rarest
    embedding = rng.uniform(-0.5 / _SIZE, 0.5 / _SIZE, (_BUCKETS, _SIZE)) * usual[:, None]
    softmax = rng.standard_normal((_SIZE, 2)) / np.sqrt(_SIZE)
    windows = sum(-(-len(ids) // WINDOW) for ids in docs)
    bias, leak = np.array([0.0, np.log(labels.sum() / windows / 4)]), labels.mean() / 2
    g_emb, g_soft, g_bias = np.full(_BUCKETS, 1e-8), np.full((_SIZE, 2), 1e-8), np.full(2, 1e-8)
    epochs = -(-steps * _BATCH // len(docs))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        step = rate * (1 - epoch / epochs) + 0.02
        for at in range(0, len(docs), _BATCH):
            part = order[at : at + _BATCH]
            sizes, truth = np.array([len(docs[k]) for k in part]), labels[part]
            words, ids = np.unique(np.concatenate([docs[k] for k in part]), return_inverse=True)
            # windows begin anew in each document
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.flatnonzero(inside % WINDOW == 0)
            n_in = np.diff(np.append(first, len(ids)))
            doc_of = np.repeat(np.arange(len(part)), -(-sizes // WINDOW))
            places, w = _ranges(start, words)
            count = np.bincount(w, minlength=len(words))
            g = grams[places]
            kept = usual[g] & (rng.random(len(g)) >= drop)
            g, w = g[kept], w[kept]
            side = softmax[:, 1] - softmax[:, 0]
            pull = embedding @ side
            z = np.add.reduceat((np.bincount(w, pull[g], len(words)) / count)[ids], first) / n_in + bias[1] - bias[0]
            p = _sigmoid(z)
            clean = (1 - leak) * np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(part)))
            delta = np.where(truth[doc_of] == 1, -p * (clean / (1 - clean))[doc_of], p)
            # the gradient of a window's vector is delta times the softmax's direction: one number for each n-gram
            word_grad = np.bincount(ids, np.repeat(delta / n_in, n_in), len(words)) / count
            gram_grad = np.bincount(g, word_grad[w], _BUCKETS)
            side_grad = gram_grad @ embedding
            soft_grad = np.stack([-side_grad, side_grad], axis=1)
            bias_grad = np.array([-delta.sum(), delta.sum()])
            g_emb += gram_grad**2 * (side @ side)
            g_soft += soft_grad**2
            g_bias += bias_grad**2
            touched = np.flatnonzero(gram_grad)
            embedding[touched] -= step * (gram_grad[touched] / np.sqrt(g_emb[touched]))[:, None] * side
            softmax -= 0.1 * step * soft_grad / np.sqrt(g_soft)
            bias -= 0.3 * step * bias_grad / np.sqrt(g_bias)
    return Model(embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]), float(leak))


class _Pulls:
    """What words add to a window; a bounded number of them is remembered."""

    def __init__(self, model: Model):
        self.pull, self.known = model.pull, {}

    def learn(self, words: Iterable[str]) -> None:
        if len(self.known) > _CACHED_WORDS:
            self.known.clear()
        new = list(set(words) - self.known.keys())
        if new:
            grams, of = subwords(new)
            n = np.bincount(of, minlength=len(new))
            with np.errstate(invalid="ignore"):
                self.known.update(zip(new, (np.bincount(of, self.pull[grams], len(new)) / n).tolist(), strict=True))

    def of(self, words: list[str]) -> np.ndarray:
        """Their values, without words of signs alone."""
        try:
            value = np.fromiter(map(self.known.__getitem__, words), float, len(words))
        except KeyError:
            self.learn(words)
            value = np.fromiter(map(self.known.__getitem__, words), float, len(words))
        return value[~np.isnan(value)]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about a million characters, cut at white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def score_text(text: str, pulls: _Pulls, model: Model) -> float:
    """The probability that a text is labelled toxic; long ones are read piece by piece, with windows that begin anew in each."""
    clean = 1 - model.leak
    for piece in _pieces(text):
        value = pulls.of(words_of(piece))
        if len(value):
            first = np.arange(0, len(value), WINDOW)
            p = _sigmoid(np.add.reduceat(value, first) / np.diff(np.append(first, len(value))) + model.bias)
            clean *= np.prod(1 - p[p >= _FLOOR])
    return float(1 - clean)


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, most_words: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled documents: a sample of at most `sample` ids, the first by a hash, so at random, and of those texts as many as have `most_words` words (the last one counts whole).

    Null ids, labels and texts are not learned from. An id labelled twice has its highest label, an id with several texts
    the first of them in order; texts that are the same count once. Fitting is one task; only the model, half a megabyte,
    comes to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    # bounded: at most `sample` ids and labels
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(chosen), "id")
    one = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("id").alias("h"), "text", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[list[str], int]]:
            total, met = 0, set()
            for b in batches:
                for text, label in zip(b.column(1), b.column(2), strict=True):
                    text, label = text.as_py(), label.as_py()
                    digest = hashlib.blake2b(text.encode(), digest_size=16).digest()
                    if total < most_words and digest not in met:
                        met.add(digest)
                        words = words_of(text)
                        total += len(words)
                        yield words, int(label > 0)

        found = fit(rows())
        yield pa.RecordBatch.from_arrays([pa.array([found.pull.tobytes()]), pa.array([found.bias]), pa.array([found.leak])], ["pull", "bias", "leak"])

    row = one.repartition(1).sortWithinPartitions("h", "text").mapInArrow(work, "pull binary, bias double, leak double").first()
    return Model(np.frombuffer(row.pull, float), row.bias, row.leak) if row else fit([])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id (of any type, null too) and score, 0 to 1. Null and empty texts and those without words have the leak as score; repeated rows have a row each. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        pulls = _Pulls(model)
        for b in batches:
            found: list[float] = []
            for k in range(0, b.num_rows, 500):
                part = [t or "" for t in b.column(1).slice(k, 500).to_pylist()]
                # words of neighbouring texts are learned together
                pulls.learn(w for t in part if len(t) < _PIECE for w in words_of(t))
                found += [score_text(t, pulls, model) for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"`{id_col}` {kind}, score double")
