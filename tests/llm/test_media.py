import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import DOCS, corpus, rows
from tidemark.llm import flac
from tidemark.llm.media import from_media, padded, pcm_blocks, stored, to_media


@given(st.lists(st.binary(min_size=1, max_size=300) | st.integers(1, 9000).map(lambda n: bytes((k * k // 7) % 256 for k in range(n))) | st.integers(1, 9000).map(lambda n: b"ab c" * n), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_round_trip(payloads):
    streams = flac.encode(payloads)
    back = flac.decode(streams)
    assert [b[0] for b in back] == payloads
    for (_, blocks), p in zip(back, payloads, strict=True):
        assert blocks[0].first_sample == 0 and sum(b.samples for b in blocks) == len(p)


def test_each_kind_of_subframe():
    wave = (128 + 100 * np.sin(np.arange(20000) / 25)).astype(np.uint8).tobytes()
    noise = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    flat = b"\x07" * 9000
    streams = flac.encode([wave, noise, flat])
    assert [b[0] for b in flac.decode(streams)] == [wave, noise, flat]
    assert len(streams[0]) < 0.7 * len(wave) and len(streams[1]) < 1.03 * len(noise) and len(streams[2]) < 200
    assert streams == [flac.encode([p])[0] for p in (wave, noise, flat)]


def test_stream_without_seek_table():
    wave = (128 + 90 * np.sin(np.arange(10000) / 11)).astype(np.uint8).tobytes()
    stream = flac.encode([wave])[0]
    size = int.from_bytes(stream[43:46], "big")
    bare = stream[:4] + bytes([stream[4] | 0x80]) + stream[5:42] + stream[46 + size :]
    assert flac.decode([bare, stream])[0][0] == wave


def test_damage_is_found():
    stream = bytearray(flac.encode([b"some text that is long enough " * 40])[0])
    for at in (len(stream) - 1, len(stream) - 40, len(stream) // 2):
        broken = bytearray(stream)
        broken[at] ^= 0x10
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(broken)])


def test_crc16():
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        return c

    data = np.random.default_rng(2).integers(0, 256, 900, dtype=np.uint8)
    starts, ends = np.array([0, 5, 300]), np.array([5, 300, 900])
    assert flac.crc16(data, starts, ends).tolist() == [slow(data[a:b].tolist()) for a, b in zip(starts, ends, strict=True)]


def test_table(spark):
    texts = corpus()
    got = from_media(to_media(spark.createDataFrame(rows(texts), DOCS))).collect()
    assert len(got) == len(texts)
    want = sorted((i if i is not None else -1, hashlib.sha256(padded((t or "").encode())).hexdigest(), zlib.crc32(padded((t or "").encode())[-64:]), len((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256(r.pcm).hexdigest(), zlib.crc32(r.pcm[-64:]), r.n_bytes) for r in got) == want
    same = {}
    for r in got:
        assert same.setdefault(r.pcm, (r.media, r.feature)) == (r.media, r.feature)
    assert from_media(to_media(spark.createDataFrame([], DOCS))).count() == 0


def test_long_payloads_go_by_groups():
    """Frames of one payload over several groups, and several payloads in one: the streams are those of each payload alone."""
    rng = np.random.default_rng(5)
    long = rng.integers(97, 123, 2 * flac.GROUP + 5000, dtype=np.uint8).tobytes()
    short = b"a few words " * 50
    streams = flac.encode([short, long, short])
    assert streams[0] == streams[2] == flac.encode([short])[0]
    back = flac.decode(streams)
    assert [b[0] for b in back] == [short, long, short]
    blocks = back[1][1]
    assert [b.first_sample for b in blocks] == list(range(0, len(long), flac.BLOCK))
    begin = flac._metadata(streams[1])[0]
    one = flac._frames(streams[1][begin + blocks[-2].frame_offset : begin + blocks[-1].frame_offset], [0])[0][0]
    assert flac._unsigned(one) == long[blocks[-2].first_sample : blocks[-1].first_sample]


def test_pcm_blocks(spark):
    texts = {1: "word " * 3000, 2: None, 3: "ä" * 50}
    media = stored(to_media(spark.createDataFrame(rows(texts.items()), DOCS)))
    got = {}
    for r in pcm_blocks(media).orderBy("doc_id", "block").collect():
        assert r.first_sample == len(got.get(r.doc_id, b"")) and len(r.pcm) == r.samples <= flac.BLOCK
        got[r.doc_id] = got.get(r.doc_id, b"") + r.pcm
    assert got == {k: padded((t or "").encode()) for k, t in texts.items()}
