import random

from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, rows
from tidemark.llm.language import identify, identify_documents, identify_pages, keep_identified, train

LETTERS = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed"], "de": ["sch", "ei", "ung", "ver", "ge", "ich", "au", "ü"], "fr": ["eau", "que", "ou", "é", "le", "ent", "è", "aux"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def labelled(seed, n):
    rng = random.Random(seed)
    return [(i, text(lang, rng.randint(3, 60), rng), lang) for i in range(n) for lang in [rng.choice(list(LETTERS))]]


def frame(spark, data):
    return spark.createDataFrame(rows([(i, t) for i, t, _ in data], {i: lang for i, _, lang in data}), DOCS)


def test_held_out_accuracy(spark):
    model = train(frame(spark, labelled(1, 300)), rows=200)
    test = labelled(2, 300)
    got = {r.doc_id: r for r in identify(frame(spark, test), model, ["doc_id"], F.col("text"), F.col("source")).collect()}
    right = sum(got[i].lang == lang for i, _, lang in test)
    assert right >= 0.98 * len(test)
    assert sum(r.accepted for r in got.values()) >= 0.99 * len(test)


def test_rejects_and_edge_cases(spark):
    data = labelled(3, 120)
    odd = [(500, None, "en"), (501, "", "de"), (502, "12 %% !!", "en"), (503, "абвгд ежзий клмно прсту " * 20, None), (504, "x" * 200_000, "fr"), (None, data[0][1], "en"), data[0]]
    df = frame(spark, data + odd)
    got = identify_documents(df).collect()
    assert len(got) == len(data) + len(odd)
    by = {r.doc_id: r for r in got}
    for i in (500, 501, 502):
        assert by[i].lang == "und" and by[i].confidence == 0 and not by[i].accepted
    kept = keep_identified(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, _, _ in data} <= ids and not {500, 501, 502} & ids
    assert identify_documents(df.limit(0)).count() == 0


def test_evidence_decides_short_texts(spark):
    """A text that fits two languages follows its host's other texts, or what the page declares."""
    model = train(frame(spark, labelled(4, 300)))
    rng = random.Random(9)
    pages = [(i, f"http://www.h.example.de/{i}", f"<html><body>{text('de', 30, rng)}</body></html>") for i in range(30)]
    pages += [(100, "http://www.h.example.de/x", "<html>an</html>"), (101, "http://other.example.com/x", '<html lang="fr-CA"><script>the their</script>an</html>'), (102, None, None), (103, "x", "<html lang=fr>")]
    by = {r.page_id: r for r in identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert by[0].lang == "de" and by[102].lang == "und" and by[103].lang == "und"
    alone = {r.page_id: r for r in identify_pages(spark.createDataFrame([(100, "http://solo.example.com/x", "<html>an</html>")], "page_id long, url string, html string"), model).collect()}
    assert alone[100].lang == "en" and by[100].confidence != alone[100].confidence


def test_every_label_is_learnt(spark):
    """A label with few rows among many, and copies of one text, do not leave the sample without a language or past its bound."""
    rng = random.Random(12)
    data = [(i, text("en", 12, rng), "en") for i in range(600)] + [(1000 + i, text("fr", 12, rng), "fr") for i in range(3)]
    hot = text("de", 12, rng)
    data += [(2000 + i, hot, "de") for i in range(300)]
    df = frame(spark, data).repartition(7)
    assert train(df, rows=40).languages == ["de", "en", "fr"]
    by = {r.doc_id: r for r in identify_documents(df, train_rows=40).collect()}
    assert all(by[i].lang == lang for i, _, lang in data if lang != "en") and sum(by[i].lang == "en" for i in range(600)) >= 590
    from tidemark.llm.language import _bounds

    hashes = frame(spark, data).select("lang", F.xxhash64("text").alias("h")).distinct()
    bounds = _bounds(hashes, 40)
    took = {r.lang: r.n for r in hashes.groupBy("lang").agg(F.count_if(F.col("h") <= F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])[F.col("lang")]).alias("n")).collect()}
    assert took == {"de": 1, "fr": 3, "en": 36}


def test_without_labels_nothing_goes(spark):
    df = frame(spark, [(1, "some words here", None), (2, None, None)])
    assert keep_identified(df).count() == 2


def plain_language(train_rows, data, strength=8.0):
    """(lang, confidence) of (text, host, declared) rows, one at a time, from the texts and labels of train_rows."""
    import math

    def codes(t):
        kept = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (t or "").encode())
        a = b" " + b" ".join(kept.split()) + b"  "
        mask = (1 << 32) - 1
        return [((((a[k] * 0x01000193 + a[k + 1]) * 0x01000193 + a[k + 2]) * 0x9E3779B1) & mask) >> 16 for k in range(len(a) - 2) if a[k + 1] != 32]

    counts = {}
    for t, lang in {(t, lang) for t, lang in train_rows if t is not None and lang is not None}:
        c = counts.setdefault(lang, {})
        for x in codes(t):
            c[x] = c.get(x, 0) + 1
    names = sorted(counts)
    n = len(names)
    total = [sum(counts[x].values()) + 0.5 * 65536 for x in names]
    seen = [codes(t) for t, _, _ in data]
    ll = [[sum(math.log((counts[x].get(c, 0) + 0.5) / total[k]) for c in own) / 3 for k, x in enumerate(names)] for own in seen]
    share = [[math.exp(v - max(r)) / sum(math.exp(w - max(r)) for w in r) for v in r] for r in ll]
    told = [names.index(d.lower().split("-")[0]) if d and d.lower().split("-")[0] in names else None for _, _, d in data]
    live = [i for i, own in enumerate(seen) if own]
    host = [h or "" for _, h, _ in data]
    suffix = [h.rsplit(".", 1)[1] if "." in h else "" for h in host]
    sums = lambda key, value: [sum(share[i][k] for i in live if key[i] == value) for k in range(n)]
    top = [sum(share[i][k] for i in live) for k in range(n)]
    base = [(x + 1) / (sum(top) + n) for x in top]
    said = [i for i in live if told[i] is not None]
    trust = (sum(share[i][told[i]] >= max(share[i]) for i in said) + 9) / (len(said) + 10)
    out = []
    for i in range(len(data)):
        if not seen[i]:
            out.append(("und", 0.0))
            continue
        t, s = sums(suffix, suffix[i]), sums(host, host[i])
        prior = [(t[k] + strength * base[k]) / (sum(t) + strength) for k in range(n)]
        score = [ll[i][k] + math.log((max(s[k] - share[i][k], 0) + strength * prior[k]) / (max(sum(s) - 1, 0) + strength)) + (0 if told[i] is None else math.log(trust) if told[i] == k else math.log((1 - trust) / (n - 1))) for k in range(n)]
        best, unknown = max(score), len(seen[i]) * -math.log(65536) / 3 + math.log(1e-3)
        sure = 1 / (sum(math.exp(x - best) for x in score) + math.exp(min(unknown - best, 700)))
        out.append((names[score.index(best)], sure) if best >= unknown else ("und", 0.0))
    return out


def test_fused_scores_against_plain_version(spark):
    """Documents by text and source, pages by text, declaration, host and suffix: the same language and confidence as from a plain computation."""
    rng = random.Random(21)
    data = labelled(20, 60) + [(900, "an", "en"), (901, "", None), (902, "qqxzj", None), (903, text("de", 5, rng), None)]
    docs = identify_documents(frame(spark, data)).collect()
    by = {r.doc_id: r for r in docs}
    for (i, _, _), (lang, sure) in zip(data, plain_language([(t, lang) for _, t, lang in data], [(t, f"src{i % 3}", None) for i, t, _ in data]), strict=True):
        assert by[i].lang == lang and abs(by[i].confidence - sure) < 2e-4, i
    model = train(frame(spark, data))
    pages = [(i, f"http://{'abc'[i % 3]}.example.{'de' if i % 2 else 'fr'}/{i}", text(rng.choice(list(LETTERS)), rng.choice([1, 2, 8]), rng), rng.choice([None, "de", "fr-CA", "xx", "en"])) for i in range(50)]
    df = spark.createDataFrame([(i, u, f"<html{f' lang={d}' if d else ''}><body>{t}</body></html>") for i, u, t, d in pages], "page_id long, url string, html string")
    by = {r.page_id: r for r in identify_pages(df, model).collect()}
    want = plain_language([(t, lang) for _, t, lang in data], [(t, u.split("/")[2], d) for _, u, t, d in pages])
    for (i, _, _, _), (lang, sure) in zip(pages, want, strict=True):
        assert by[i].lang == lang and abs(by[i].confidence - sure) < 2e-4, i
