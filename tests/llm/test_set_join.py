import random
from collections import Counter

import numpy as np

from tests.llm.fixtures import DOCS, corpus, prose, rows
from tidemark.llm import near_sets
from tidemark.llm.common import WordHashes, fold_words, shingles
from tidemark.operators.graph import components
from tidemark.llm.set_join import keep_one, runs_for, similar_documents


def brute(texts):
    """Copy id, class id and links of each row, from all pairs."""
    h = WordHashes()
    sets = []
    for _, t in texts:
        s = frozenset(shingles(h.of(fold_words((t or "").encode())), 5).tolist())
        sets.append(s if s else t or "")
    linked = lambda a, b: a == b or (isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    n = len(texts)
    near = [[j for j in range(n) if j != i and linked(sets[i], sets[j])] for i in range(n)]
    label = list(range(n))
    while True:
        new = [min([label[i], *[label[j] for j in near[i]]]) for i in range(n)]
        if new == label:
            break
        label = new
    low = lambda rows: min((texts[j][0] for j in rows if texts[j][0] is not None), default=None)
    return [(texts[i][0], low([j for j in range(n) if sets[j] == sets[i]]), low([j for j in range(n) if label[j] == label[i]]), len(near[i])) for i in range(n)]


def run(spark, texts, **options):
    out = similar_documents(spark.createDataFrame(rows(texts), DOCS), **options).collect()
    return sorted([(r.doc_id, r.copy_id, r.class_id, r.n_links) for r in out], key=repr)


def test_against_brute_force(spark):
    texts = corpus()
    assert run(spark, texts) == sorted(brute(texts), key=repr)
    assert run(spark, []) == []


def test_keys_join_alike_by_shuffle_and_sent(spark, monkeypatch):
    texts = corpus(seed=9)
    for most in (0, 1 << 30):
        monkeypatch.setattr(near_sets, "_BROADCAST_BYTES", most)
        assert run(spark, texts) == sorted(brute(texts), key=repr)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies larger than a leaf and a block, beside texts that share a passage with it."""
    rng = random.Random(4)
    base = prose(rng, 150)
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(base[:20] + prose(rng, 80))) for i in range(30)]
    monkeypatch.setattr(near_sets, "BLOCK", 16)
    got, want = run(spark, texts, leaf=8), sorted(brute(texts), key=repr)
    assert sum(g[3] for g in got) >= 0.97 * sum(w[3] for w in want)
    assert [g[2] for g in got] == [w[2] for w in want]


def test_keep_one(spark):
    texts = corpus()
    df = spark.createDataFrame(rows(texts), DOCS)
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    want = {c for _, _, c, _ in brute(texts)}
    assert Counter(got) == Counter(dict.fromkeys(want, 1))


def test_runs():
    assert runs_for(0.8, 1, 0.99) == 5 and runs_for(0.8, 3, 0.995) == 12


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)]
    df = spark.createDataFrame([(str(a).zfill(4).encode(), str(b).zfill(4).encode()) for a, b in edges], "node binary, other binary")
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {int(r.node): int(r.root) for r in components(df).collect()}
    assert got == {x: v for x, v in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(df.limit(0)).count() == 0
    assert np.array_equal(near_sets._roots(5, np.array([3, 1]), np.array([4, 3])), [0, 1, 2, 1, 1])
