import random
import re

import numpy as np
import pytest

from tests.llm.fixtures import DOCS, corpus, rows
from tidemark.llm.decontaminate import contamination, drop_contaminated
from tidemark.llm.fm_index import FMIndex, Wavelet, suffix_order

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(texts, items):
    out = []
    for i, t in texts:
        w = words(t)
        hit, names = set(), set()
        for item, text in items:
            b = words(text)
            n = min(10, len(b))
            for s in range(len(b) - n + 1 if b else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == b[s : s + n]:
                        hit |= set(range(k, k + n))
                        names.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=repr)


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 65, 300):
        text = rng.integers(1, 4, n)
        text[-1] = 0
        order = suffix_order(text)
        assert sorted(order.tolist(), key=lambda i: text[i:].tolist()) == order.tolist()
        w = Wavelet(text, 3)
        for symbol in range(4):
            got = w.rank(np.full(n + 1, symbol), np.arange(n + 1))
            assert got.tolist() == [int((text[:i] == symbol).sum()) for i in range(n + 1)]
        assert w.access(np.arange(n))[0].tolist() == text.tolist()


def test_fm_index_finds_all_occurrences():
    rng = random.Random(2)
    for _ in range(60):
        top = rng.randint(1, 4)
        text = [rng.randint(0, top) for _ in range(rng.randint(0, 200))]
        index = FMIndex(np.array(text, np.int64), top)
        for _ in range(10):
            p = [rng.randint(1, top) for _ in range(rng.randint(1, 6))]
            pattern = np.zeros((1, 6), np.int64)
            pattern[0, 6 - len(p) :] = p
            low, high = index.find(pattern)
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert got == [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]


def cases():
    texts = corpus()
    pick = words(texts[7][1])
    items = [(1, " ".join(pick[5:30])), (2, "amber, basin"), (10, "Word"), (3, None), (4, " ..!"), (1, " ".join(pick[5:30])), (None, " ".join(words(texts[9][1])[:12])), (5, "東京 ω"), (6, "none of these words stand in any of the documents at all")]
    return texts, items


@pytest.mark.parametrize(("block_bytes", "max_words", "pass_bytes"), [(8 << 20, 1_000_000, 1 << 20), (200, 1_000_000, 1 << 20), (200, 3, 1 << 20), (100, 1_000_000, 150)])
def test_against_brute_force(spark, block_bytes, max_words, pass_bytes):
    texts, items = cases()
    b = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(spark.createDataFrame(rows(texts), DOCS), b, block_bytes=block_bytes, max_words=max_words, pass_bytes=pass_bytes).collect()
    got = sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r.item_ids)) for r in out], key=repr)
    assert got == brute(texts, items)
    assert all(a.end < b.start for r in out for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_drop_and_empty_tables(spark):
    texts, items = cases()
    df, b = spark.createDataFrame(rows(texts), DOCS), spark.createDataFrame(items, "item_id long, text string")
    kept = drop_contaminated(df, b)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([t for t, x in zip(texts, [brute([t], items)[0] for t in texts], strict=True) if not x[2]], key=repr)
    assert contamination(df.limit(0), b).count() == 0
    assert contamination(df, b.limit(0)).filter("size(spans) > 0").count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("007", "one two three"), ("x", "other words")], "doc_id string, text string")
    b = spark.createDataFrame([("00", "two three"), ("b", "one two")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], list(r.item_ids)) for r in contamination(docs, b).collect()}
    assert got == {"007": (3, [(0, 3)], ["00", "b"]), "x": (2, [], [])}
