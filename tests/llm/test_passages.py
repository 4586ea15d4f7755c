import random
import re

from tests.llm.fixtures import DOCS, corpus, prose, rows
from tidemark.llm.passages import repeated_passages, tune_bands


def found(spark, texts):
    return {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows(texts), DOCS)).collect()}


def test_planted_passages(spark):
    """Every passage of 51 words in two documents is found, at any place, over line ends; clean documents are left alone."""
    rng = random.Random(8)
    texts, planted = [], set()
    for k in range(25):
        passage = prose(random.Random(1000 + k), 51)
        for c in range(2):
            w = [f"{x}{rng.randint(0, 10**6)}" for x in prose(rng, rng.randint(20, 200))]
            at = rng.randrange(len(w))
            words = w[:at] + passage + w[at:]
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "\n")
            texts.append((10 * k + c, " ".join(words)))
            planted.add(10 * k + c)
    clean = [(5000 + k, " ".join(f"{x}{rng.randint(0, 10**6)}" for x in prose(rng, 120))) for k in range(40)]
    got = found(spark, texts + clean)
    assert planted == set(got)
    for k in range(25):
        a, b = got[10 * k], got[10 * k + 1]
        assert 10 * k in a.class_ids and list(a.removals) == [] and list(b.partners) == [10 * k]
        assert 28 <= sum(r.end - r.start for r in b.removals) <= 51 and len(b.removals) == 1


def test_near_lines(spark):
    """Lines with a Jaccard similarity of 0.8 or more are one class, over a chain of links too."""
    rng = random.Random(3)
    base = prose(rng, 120)
    variants = [list(base) for _ in range(4)]
    for k in range(1, 4):
        variants[k] = list(variants[k - 1])
        variants[k][30 * k] = f"edit{k}"
    texts = [(i, "head line\n" + " ".join(w) + "\n" + " ".join(prose(random.Random(50 + i), 12))) for i, w in enumerate(variants)]
    got = found(spark, texts + [(9, " ".join(prose(random.Random(77), 150)))])
    assert set(got) == {0, 1, 2, 3} and all(0 in got[i].class_ids for i in range(4))


def test_near_blocks_however_wrapped(spark):
    """A paragraph of 60 words with one changed is found over other line ends, and between blank lines."""
    rng = random.Random(31)
    base = prose(rng, 60)
    other = list(base)
    other[29] = "edited"
    wrap = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    around = lambda s: " ".join(f"{x}{s}" for x in prose(random.Random(s), 90))
    texts = [(0, f"{around(1)}\n\n{wrap(base, 9)}\n \n{around(2)}"), (1, f"{around(3)}\n\n{wrap(other, 11)}"), (2, around(4))]
    got = found(spark, texts)
    at = len(re.findall(r"\w+", around(3)))
    assert set(got) == {0, 1} and [tuple(r) for r in got[1].removals] == [(at, at + 60)] and list(got[0].removals) == []


def test_edge_cases(spark):
    texts = corpus()
    got = repeated_passages(spark.createDataFrame(rows(texts), DOCS)).collect()
    ids = {r.doc_id for r in got}
    assert {0, 40, 41, 42, 43, 44} <= ids and not ids & {60, 61, 62, 63, 64}
    assert all(a.end < b.start for r in got for a, b in zip(r.removals, r.removals[1:], strict=False))
    assert repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_bands():
    bands, rows_ = tune_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.995 and bands * rows_ <= 42
