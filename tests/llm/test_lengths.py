import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.fixtures import DOCS, corpus, rows
from tidemark.llm.lengths import context_limits, length_histogram

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_against_brute_force(spark):
    texts = corpus()
    t = Tokenizer.from_file(PATH)
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in texts]
    got = {r.context_limit: r for r in context_limits(length_histogram(spark.createDataFrame(rows(texts), DOCS), PATH)).collect()}
    assert sorted(got) == sorted(set(lengths))
    for limit, r in got.items():
        longer = [n for n in lengths if n > limit]
        assert (r.docs, r.docs_longer, r.tokens_longer) == (lengths.count(limit), len(longer), sum(longer))
        assert (r.docs_total, r.tokens_total, r.truncated_total) == (len(lengths), sum(lengths), sum(min(n, limit) for n in lengths))
        assert abs(r.quantile - (1 - len(longer) / len(lengths))) < 1e-12


def test_lengths_over_many_blocks_and_empty(spark):
    h = spark.createDataFrame([(n * 700, n + 1) for n in range(12)], "length long, docs long")
    all_ = [n * 700 for n in range(12) for _ in range(n + 1)]
    for r in context_limits(h).collect():
        assert r.truncated_total == sum(min(n, r.context_limit) for n in all_)
    assert context_limits(h.limit(0)).count() == 0
    assert length_histogram(spark.createDataFrame([], DOCS), PATH).count() == 0
