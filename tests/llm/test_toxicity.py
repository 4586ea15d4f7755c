import random
import zlib

import numpy as np

from tidemark.llm import queries, toxicity

from .fixtures import prose

BAD = ["blockhead", "nitwit", "dimwit", "scoundrel"]


def documents(n, seed, share=0.2, spoil=lambda w: w):
    rng, out = random.Random(seed), []
    for i in range(n):
        words, label = prose(rng, rng.randint(20, 120)), int(rng.random() < share)
        if label:
            for _ in range(max(1, len(words) // 30)):
                words.insert(rng.randrange(len(words)), spoil(rng.choice(BAD)))
        out.append((i, " ".join(words), label))
    return out


def plain_score(text, model):
    """The rule said once more, window by window."""
    kept, words = 1 - model.leak, [toxicity.subwords([w])[0].tolist() for w in text.lower().split()]
    words = [w for w in words if w]
    for k in range(0, len(words), toxicity.WINDOW):
        window = words[k : k + toxicity.WINDOW]
        z = sum(sum(model.pull[g] for g in w) / len(w) for w in window) / len(window) + model.bias
        p = 1 / (1 + np.exp(-z))
        kept *= 1 - p if p >= 0.05 else 1
    return 1 - kept


def test_n_grams_are_of_single_words():
    words = ["Abc", "--", "nitwit", "n1tw1t!", "a", "\U0001f642\U0001f642", "", "nit"]
    together = toxicity.subwords(words)
    assert len(together[0]) == sum(max(len(toxicity._plain(w)) + 2 - n + 1, 0) for w in words if toxicity._plain(w) for n in range(3, 7))
    for k, w in enumerate(words):
        assert toxicity.subwords([w])[0].tolist() == together[0][together[1] == k].tolist()
    of = lambda w: set(toxicity.subwords([w])[0].tolist())
    assert of("nitwit") == of("n1tw1t!") and len(of("nitwit") & of("nitwitt")) > 8 and not of("--")


def test_held_out_documents_and_unseen_misspellings(spark):
    rows = documents(900, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    fresh = documents(300, 2) + [(1000 + i, t, y) for i, t, y in documents(300, 3, spoil=lambda w: w[:2] + "x" + w[2:])]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string, label int"), model).collect()}
    plain = [(got[i], y) for i, _, y in fresh if i < 1000]
    assert all((s >= 0.3) == (y == 1) for s, y in plain)
    spelt = [got[i] >= 0.3 for i, _, y in fresh if i >= 1000 and y]
    assert sum(spelt) > 0.7 * len(spelt)
    for i, text, _ in fresh[:40]:
        assert got[i] == np.float64(plain_score(text, model)) or abs(got[i] - plain_score(text, model)) < 1e-9


def test_query_on_rows_it_has_not_learned_from(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, d).collect()}
    assert len(got) == 10_000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in queries.read(spark, d, "labels").collect()}
    pairs = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])
    assert len(yes) > 80 and auc > 0.93 and np.mean([s >= 0.3 for s in yes]) > 0.85 and np.mean([s >= 0.3 for s in no]) < 0.06


def test_labels_of_held_out_rows_count_for_nothing(spark, tmp_path):
    rows = documents(300, 4)
    frames = []
    for flip in (False, True):
        d = tmp_path / str(flip)
        spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
        labels = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
        spark.createDataFrame(labels, "doc_id long, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
        frames.append(sorted(map(tuple, queries.op12_toxicity(spark, str(d)).collect())))
    assert frames[0] == frames[1]


def test_odd_rows_and_empty_tables(spark):
    rows = documents(200, 5)
    docs = spark.createDataFrame([(i, t, 1.0, "p") for i, t, _ in rows] + [(3, rows[3][1], 1.0, "p"), (None, "nitwit", 1.0, "p"), (900, None, 1.0, "p"), (901, "", 1.0, "p"), (902, "!!! ??", 1.0, "p"), (903, "ab" * 200_000 + " nitwit " + "amber basin cedar " * 70_000, 1.0, "p")], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, y, "t") for i, _, y in rows] + [(0, 0, "t"), (None, 1, "t"), (1, None, "t"), (5000, 1, "t")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] == by[902] < 0.3 < by[None] and by[903] > 0.3 and abs(by[900] - model.leak) < 1e-12
    for nothing in (labels.filter("false"), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, nothing)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 1"))).collect()} == {1.0}
    assert toxicity.score(docs.filter("false"), toxicity.train(docs.filter("false"), labels)).collect() == []
    names = docs.select(docs.doc_id.cast("string").alias("name"), docs.text)
    assert toxicity.score(names, model, "name").columns == ["name", "score"]


def test_the_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = documents(300, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    a = toxicity.train(df, df, sample=100)
    b = toxicity.train(df.repartition(7), df.repartition(3), sample=100)
    assert np.array_equal(a.pull, b.pull) and (a.bias, a.leak) == (b.bias, b.leak)
    few = toxicity.train(df, df, sample=100, most_words=500)
    assert not np.array_equal(a.pull, few.pull)
