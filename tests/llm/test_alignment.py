import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens_of(text):
    """Whole-text encodings with each token's bytes, by the libraries alone; None where they do not give blank + text."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    a = [(i, bytes(letter[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def brute(texts):
    out, links_of, held = [], [], Counter()
    for text in texts:
        found = tokens_of(text) if text else None
        if not found:
            out.append([0, 0, 0, 0, ""])
            links_of.append([])
            continue
        spans = []
        for side in found:
            at, s = 0, []
            for i, x in side:
                s.append((i, at, at + len(x)))
                at += len(x)
            spans.append(s)
        a, b = spans
        links, lo = [], 0
        for i, s, e in a:
            while b[lo][2] <= s:
                lo += 1
            j = lo
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for cut in cuts:
            sides = [",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in spans] if len(text) < 3000 else ["", ""]
            groups.append("|".join(sides))
            start = cut
        out.append([len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links_of.append(links)
        held.update(set(links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    return [(*o[:4], sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), o[4]) for o, links in zip(out, links_of, strict=True)]


TEXTS = [
    None, "", " ", "   ", "a", "a ", " a  b ", "x\n y", "x\n  y\t\tz\r\n", "<|endoftext|> and <s>hi</s>", "▁ab", "a\x00b", "é ﬁ é", "漢字とかな、混ぜ書き。", "don't we'll 12345 3.14", "—dash… “quotes” €5",
    "a\x1cb \x1d c", " nb  sp", "🙂🙂 emoji", "thre thre thre", "word" * 500, "the cat sat " * 40, "the cat sat", "the cat sat", "²³ ½ ª", "ǅ ȸ ɏ ɐ", "\n", "\nab", "ab\n", "a\nb", "a \nb\n c", "x\u00a0y \u2003 z\u2028w", "\tq\t r", "a  ", "aa\u0301 e\u0301\n\u0301x", "▁", "ok ▁x ok", "a\u200bb \u200b c\n\u200bd", "\x1f x\n\x1fy",
]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=lambda r: (r[0] is None, str(r[0])))


@pytest.mark.parametrize("pass_keys", [alignment.PASS_KEYS, 40_000])
def test_documents_against_brute_force(spark, pass_keys, monkeypatch):
    monkeypatch.setattr(alignment, "_SHARD", 16_384)
    docs = [(r.doc_id, r.text) for r in queries.read(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs = [d for d in docs if len(d[1] or "") < 3000] + [(10_000 + k, t) for k, t in enumerate(TEXTS)]
    got = rows_of(alignment.align_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), A, B, pass_keys=pass_keys))
    want = sorted(((i, *b) for (i, _), b in zip(docs, brute([t for _, t in docs]), strict=True)), key=lambda r: str(r[0]))
    assert got == want
    assert sum(r[4] for r in got) > 50_000


def test_repeats_nulls_ids_of_any_type_and_empty_tables(spark):
    docs = [("x", "the cat sat"), ("x", "the cat sat"), (None, "the cat"), (None, None)]
    df = spark.createDataFrame(docs, "id string, body string").selectExpr("id", "body", "1 as doc_id", "'t' as text", "2 as n_a")
    for limit in (alignment.PASS_KEYS, 1):
        got = rows_of(alignment.align_documents(df, A, B, "id", "body", pass_keys=limit))
        want = sorted(((i, *b) for (i, _), b in zip(docs, brute([t for _, t in docs]), strict=True)), key=lambda r: (r[0] is None, str(r[0])))
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert rows_of(alignment.align_documents(df.filter("false"), A, B, "id", "body")) == []


@pytest.mark.parametrize("pass_keys", [alignment.PASS_KEYS, 60])
def test_texts_are_read_once(spark, pass_keys, monkeypatch):
    """Each text goes to the tokenizers once, whatever the counts' number of parts; small batches give the same rows."""
    monkeypatch.setattr(alignment, "_HELD_LINKS", 3)
    monkeypatch.setattr(alignment, "_HELD_PAIRS", 5)
    monkeypatch.setattr(alignment, "_SHARD", 32)
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = [(k, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).mapInArrow(counting, "doc_id long, text string")
    got = rows_of(alignment.align_documents(df, A, B, pass_keys=pass_keys))
    assert read.value == len(docs)
    assert got == sorted(((i, *b) for (i, _), b in zip(docs, brute(TEXTS), strict=True)), key=lambda r: str(r[0]))


def test_long_texts_go_in_pieces_and_words_are_forgotten(monkeypatch):
    text = " ".join(f"w{k} längere  Wörter,\n und\n{k * 7919} <s>" for k in range(3000))
    [whole] = list(alignment.Aligner(A, B).aligned(text))
    a, b = tokens_of(text)
    assert (whole[0], whole[1]) == (len(a), len(b))
    monkeypatch.setattr(alignment, "_SEGMENT", 500)
    monkeypatch.setattr(alignment, "_REMEMBERED", 50)
    monkeypatch.setattr(alignment, "_TOGETHER", 20)
    parts = list(alignment.Aligner(A, B).aligned(text))
    assert len(parts) > 100 and [sum(p[k] for p in parts) for k in range(3)] == list(whole[:3])
    assert np.concatenate([p[3] for p in parts]).tolist() == whole[3].tolist() and b"".join(p[4] for p in parts) == whole[4]


def test_the_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 31, 50_000))
    shard = alignment._shard_of(keys, 7)
    parts, stored = [], []
    for s in range(7):
        sizes, bits, ordered = alignment.build_hash(keys[shard == s])
        parts.append((s, sizes, np.packbits(bits, bitorder="little").tobytes()))
        stored.append(ordered)
    h = alignment.PairHash(7, parts)
    at = h.of(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    assert np.concatenate(stored)[at].tolist() == keys.tolist()
    strangers = rng.integers(1 << 32, 1 << 33, 1000)
    found = h.of(strangers)
    assert not np.isin(np.concatenate(stored)[found[found >= 0]], strangers).any()
