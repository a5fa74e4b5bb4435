"""Token ids by the tokenizers library, with a bounded cache of text units.

Both vocabularies split a text at white space before anything else, so a text
is cut into units that can be encoded alone: runs without white space
(``white``), or such runs with one leading space and the white space between
(``byte``, where spaces are part of tokens); a word is also cut from punctuation
after it. Units repeat, so each worker keeps
the ids of the first ``cache`` that came up twice (some 250 bytes each); the result never depends on the cache.
A text that holds the string of an added token, which the library finds before
it splits, is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

CACHE = 250_000
#: Unicode White_Space, which is what ``\s`` means to the tokenizers library.
_WS = "\t-\r \x85\xa0  -     　"
#: Latin letters and digits before ASCII punctuation; both vocabularies split
#: there. (Without U+0130, whose lower case ends in a combining mark.)
_WORD = "[0-9A-Za-zÀ-ÖØ-öø-įı-ɏ]++(?=[!-/:-@[-`{-~])"
_UNITS = {"white": re.compile(f"{_WORD}|[^{_WS}]+"), "byte": re.compile(f" ?{_WORD}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")}
_LOADED: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = _UNITS[kind].findall
        self.cache = cache
        self.known: dict[str, bytes] = {}
        self.once = bytearray(1 << 22)  # by hash: units that came up before

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        units = self.units(text)
        out = list(map(self.known.get, units))
        try:
            return b"".join(out)
        except TypeError:  # a unit not seen before
            new = list({u for u, x in zip(units, out, strict=True) if x is None})
            got = {u: array("I", e.ids).tobytes() for u, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
            if len(self.known) < self.cache:
                for u, x in got.items():
                    at = hash(u) & 0x3FFFFF
                    if self.once[at] and len(u) <= 48:
                        self.known[u] = x
                    self.once[at] = 1
            return b"".join([got[u] if x is None else x for u, x in zip(units, out, strict=True)])


def encoder(path: str, kind: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Encoder(path, kind, cache)
    return _LOADED[path, kind]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
