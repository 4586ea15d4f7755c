import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import DOCS, corpus, rows
from tidemark.llm.packing import cut, pack_power_of_two, write_buckets
from tidemark.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
EXACT = Tokenizer.from_file(PATH)
FAST = encoder(PATH)


def ids(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=60) | st.text(alphabet="aBé ß'sİΣ3<|endoftext|>́\x1c\u0085 \n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_pieces_encode_like_the_whole(text):
    assert np.frombuffer(FAST(text), "<u4").tolist() == ids(text)


@given(st.integers(0, 20_000), st.integers(0, 12))
@settings(deadline=None)
def test_cut(n, k):
    pieces = cut(n, 1 << k)
    assert [s for s, _ in pieces] == list(np.cumsum([0, *[p[1] for p in pieces]])[: len(pieces)])
    assert sum(p[1] for p in pieces) == n and all(p[1] & (p[1] - 1) == 0 and p[1] <= 1 << k for p in pieces)
    assert len([p for p in pieces if p[1] < 1 << k]) <= k


def test_round_trip(spark, tmp_path):
    texts = corpus()
    packed = pack_power_of_two(spark.createDataFrame(rows(texts), DOCS), PATH, longest=64)
    write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b")).collect()
    assert len({r.sequence_id for r in back}) == len(back)
    assert all(r.length == 1 << r.bucket and len(r.ids) == 4 * r.length and r.offset == 0 for r in back)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens) for r in back)
    want = sorted((i if i is not None else -1, s, (ids(t) + [1])[s : s + n], len(ids(t)) + 1) for i, t in texts for s, n in cut(len(ids(t)) + 1, 64))
    assert got == want
    assert sorted(r.sequence_id for r in back) == list(range(len(back)))
    again = pack_power_of_two(spark.createDataFrame(rows(texts[::-1]), DOCS).repartition(7), PATH, longest=64).collect()
    assert sorted((r.sequence_id, r.ids) for r in again) == sorted((r.sequence_id, r.ids) for r in back)


def test_empty_and_bad(spark):
    assert pack_power_of_two(spark.createDataFrame([], DOCS), PATH).count() == 0
    with pytest.raises(ValueError):
        pack_power_of_two(spark.createDataFrame([], DOCS), PATH, longest=100)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_other_kinds(name):
    e = encoder(public_tokenizers.path(name))
    a, b = (np.frombuffer(e(t), "<u4").tolist() for t in ("Hello  wörld 12", ""))
    assert len(a) > 3 and b == []
