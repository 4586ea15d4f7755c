"""Encode texts with a public tokenizer file inside Spark tasks."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable

import numpy as np


class _Recent(dict):
    """Remembers what make(key) gave for at least the last `most` and at most twice as many keys it was asked for anew."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 64):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


#: The way from text to words of the one tokenizer kind whose words can be told apart before encoding.
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(spec: dict) -> bool:
    """True if white space only separates and words are encoded one by one: then a text's ids are those of its words, in order."""
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (spec.get("normalizer") or {}).get("normalizers") == _WORD_NORMALIZERS and first == {"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where that prints, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


#: Letters and numbers below U+0250, where no letter changes under NFC.
_LATIN = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"


def _word_encoder(tokenizer, encode: Callable[[str], list[int]], special: list[str]) -> Callable[[str], bytes]:
    """Encode by words; a word not met lately by the merges alone.

    A text of Latin letters and common signs is split to words as a whole. Any other is split at white space, its
    Latin pieces to words, and the rest is left to the tokenizer, whose tables of letters count.
    """
    merge, letters = tokenizer.model.tokenize, _byte_letters()

    def word_ids(word: str) -> bytes:
        plain = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in merge(plain)]).tobytes()

    words = _Recent(word_ids, 400_000)
    latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_NUMBERS}]|[^\\s{_LATIN}{_NUMBERS}]+").findall
    # dashes, quotes, the ellipsis and the euro sign are neither letters nor numbers nor changed by normalisation
    beyond = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]").search
    whole = lambda text: np.array(encode(text), "<u4").tobytes()
    known = lambda text: not any(s in text for s in special) and not beyond(text)
    by_words = lambda text: b"".join(map(words.__getitem__, latin(text.lower())))
    pieces = _Recent(lambda piece: by_words(piece) if known(piece) else whole(piece), 50_000)
    # str.split and \s also take U+001C to U+001F, which are no white space to the tokenizer
    odd = re.compile("[\x1c-\x1f]").search

    def text_ids(text: str) -> bytes:
        if odd(text):
            return whole(text)
        return by_words(text) if known(text) else b"".join(map(pieces.__getitem__, text.split()))

    return text_ids


def encoder(path: str) -> Callable[[str], bytes]:
    """A function text -> ids (little-endian unsigned 32-bit) for a file of the tokenizers (.json), tiktoken (.tiktoken) or sentencepiece (.model) library.

    No special tokens are added. path must be readable on every executor.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        encode = lambda text: made.encode(text, add_special_tokens=False).ids
        spec = json.loads(made.to_str())
        if _by_words(spec):
            return _word_encoder(made, encode, [t["content"] for t in spec["added_tokens"]])
    elif path.endswith(".tiktoken"):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    return lambda text: np.array(encode(text), "<u4").tobytes()


_made: dict[str, Callable[[str], bytes]] = {}


def cached_encoder(path: str) -> Callable[[str], bytes]:
    """encoder(path), made once in each Python worker."""
    if path not in _made:
        _made[path] = encoder(path)
    return _made[path]
