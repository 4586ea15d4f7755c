"""run() against the same stages said plainly, over a small corpus."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_decontaminate, test_line_dedup, test_set_join
from tests.llm.fixtures import DOCS, corpus, rows
from tests.llm.test_language import text
from tidemark.llm.packing import cut


def build(spark, tmp_path):
    rng = random.Random(6)
    texts = [(i, t) for i, t in corpus() if i is not None]
    texts = list({i: (i, t) for i, t in texts}.values())
    texts += [(400 + k, text("de", 40, rng)) for k in range(20)]
    langs = {i: "de" if i >= 400 else "en" for i, _ in texts}
    words = test_decontaminate.words(texts[7][1])
    items = [(1, " ".join(words[:14])), (2, "nothing of this stands in any document of the corpus here")]
    spark.createDataFrame(rows(texts, langs), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return texts, items


def test_run(spark, tmp_path):
    texts, items = build(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "set_join", "decontaminate", "pack"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # language: what has no letters, and the one text in letters no language of the corpus has
    left = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t) and i != 63]
    first = {r.doc_id for r in corpus_pipeline.identify_languages(spark, docs, str(tmp_path)).collect()}
    assert {i for i, _ in left} == first - {63}
    left = [(i, t) for i, t in texts if i in first]
    left = [(i, t) for i, t, _, gone in test_line_dedup.brute(left) if t or not gone]
    left = [x for x, (i, _, c, _) in zip(left, test_set_join.brute(left), strict=True) if c == i]
    left = [x for x in left if not test_decontaminate.brute([x], items)[0][2]]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, s, (tok.encode(t, add_special_tokens=False).ids + [1])[s : s + n]) for i, t in left for s, n in cut(len(tok.encode(t, add_special_tokens=False).ids) + 1, 2048)]
    assert sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(want)
