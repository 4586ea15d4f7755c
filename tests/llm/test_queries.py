"""The registered queries on a small set of tables, against plain versions that share no code with the operators."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import DOCS, corpus, rows
from tidemark.llm.queries import QUERIES

TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


@pytest.fixture(scope="module")
def texts():
    """Texts with distinct ids."""
    found = {}
    for i, t in corpus():
        if i is not None:
            found.setdefault(i, t)
    return found


@pytest.fixture(scope="module")
def tables(spark, texts, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(texts.items()), DOCS).repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def run(spark, tables, name):
    return QUERIES[name](spark, tables).collect()


def test_media(spark, tables, texts):
    by = {r.doc_id: r for r in run(spark, tables, "op6_media")}
    assert by.keys() == texts.keys()
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = {}
    for i, t in texts.items():
        r = (by[i].media_bytes, by[i].media_sha256, by[i].feature)
        assert same.setdefault(t or "", r) == r


def test_packing(spark, tables, texts):
    got = run(spark, tables, "op7_packing")
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    for i, t in texts.items():
        ids = [*TOKENS.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            piece = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
            assert (r.start, r.offset, r.doc_tokens, r.ids_crc32) == (at, 0, len(ids), zlib.crc32(piece)) and r.length.bit_count() == 1 and r.length <= 2048
            at += r.length
        assert at == len(ids)


def test_token_counts(spark, tables, texts):
    lengths = sorted(len(TOKENS.encode(t or "", add_special_tokens=False).ids) for t in texts.values())
    got = run(spark, tables, "op5_token_counts")
    want = {k: (lengths.count(k), sum(x > k for x in lengths), sum(x for x in lengths if x > k), len(lengths), sum(lengths), sum(min(x, k) for x in lengths)) for k in set(lengths)}
    assert {r.context_limit: (r.docs, r.docs_longer, r.tokens_longer, r.docs_total, r.tokens_total, r.truncated_total) for r in got} == want and len(got) == len(want)
    assert all(abs(r.quantile - sum(x <= r.context_limit for x in lengths) / len(lengths)) < 1e-12 for r in got)


def roots(ids, edges):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_set_join(spark, tables, texts):
    def shingles(t):
        w = words(t)
        k = min(5, len(w))
        return frozenset(tuple(w[s : s + k]) for s in range(len(w) - k + 1)) if w else ("no words", t or "")

    sets = {i: shingles(t) for i, t in texts.items()}
    alike = lambda x, y: x == y if isinstance(x, tuple) or isinstance(y, tuple) else len(x & y) >= 0.8 * len(x | y)
    edges = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    want = roots(sets, edges)
    by = {r.doc_id: r for r in run(spark, tables, "op9_set_join")}
    for i in sets:
        assert (by[i].class_id, by[i].n_links) == (want[i], sum(i in e for e in edges)), i


def test_passages(spark, tables, texts):
    """Nothing is removed that does not stand elsewhere, and nothing of more than 50 words that does is missed."""
    flat = {i: words(t) for i, t in texts.items()}
    at = {}
    for i, w in flat.items():
        for k in range(len(w) - 27):
            at.setdefault(tuple(w[k : k + 28]), set()).add((i, k))
    lines = []
    for i, t in texts.items():
        k = 0
        for line in (t or "").split("\n"):
            w = words(line)
            if len(w) >= 28:
                lines.append((i, k, len(w), {tuple(w[s : s + 5]) for s in range(len(w) - 4)}))
            k += len(w)
        k = 0
        for block in re.split(r"\n(?:[^\w]*\n)+", t or ""):
            w = words(block)
            if len(w) >= 28:
                lines.append((i, k, len(w), {tuple(w[s : s + 5]) for s in range(len(w) - 4)}))
            k += len(w)
    near = {a[:3]: {b[0] for b in lines if b[0] != a[0] and len(a[3] & b[3]) >= 0.8 * len(a[3] | b[3])} for a in lines}
    got = {r.doc_id: r for r in run(spark, tables, "op10_passages")}
    for i, w in flat.items():
        may = set()  # words of a 28-word run, or of a line, that another document has
        for k in range(len(w) - 27):
            if any(j != i for j, _ in at[tuple(w[k : k + 28])]):
                may |= set(range(k, k + 28))
        for a in lines:
            if a[0] == i and near[a[:3]]:
                may |= set(range(a[1], a[1] + a[2]))
        gone = {k for r in (got[i].removals if i in got else ()) for k in range(r.start, r.end)}
        assert gone <= may, i
        # of a run of 51 words that stands in an earlier document too, at least 28 go
        for k in range(len(w) - 50):
            holders = set.intersection(*({j for j, p in at[tuple(w[s : s + 28])] if j < i} for s in range(k, k + 24)))
            if any(any(flat[j][p : p + 51] == w[k : k + 51] for q, p in at[tuple(w[k : k + 28])] if q == j) for j in holders):
                assert len(gone & set(range(k, k + 51))) >= 28, (i, k)
        # lines that are alike are one class, and all but the first lose them
        for a in lines:
            if a[0] == i and near[a[:3]]:
                assert i in got
                if min(near[a[:3]]) < i:
                    assert set(range(a[1], a[1] + a[2])) <= gone
