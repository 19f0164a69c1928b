"""Token ids by the tokenizers library, with the ids of pieces of text kept from one text to the next.

The byte-level and word vocabularies split a text into words before they merge anything. No word has white space
after its first other character, and a run of letters ends before ASCII punctuation, so cutting there and
encoding each piece by itself gives the ids of the whole text. Texts with other white space, or with the name of an added
token (which the library gives its own id), are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: Pieces kept by a worker at most; beyond that it starts anew.
KEPT = 800_000

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(rf"[ \n\t\r]*[{_LETTER}]+(?=[!-/:-@\[-`{{-~])|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space beyond blank, line feed, tab and carriage return, by any of the libraries.
_OTHER_SPACE = "[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff]"

_WORD = re.compile(rf" ?[{_LETTER}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


_LETTERS = _byte_letters()
#: Ways to hand a single word to the merges alone, tried on PROBES; a vocabulary that fits none encodes all by the library.
_PLAIN = (lambda w: w, lambda w: w.lstrip(" ").lower())
PROBES = [" the", "Ärger", " Straße", "x", " Zq", "ÉLAN", " naïveté", "aaaaaaaaaaaaa"]


class Kept(dict):
    """Ids of pieces, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to byte strings of little-endian ids of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        names = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        #: What of a text can't be cut into pieces: the names of added tokens, which the library finds before it splits.
        self.uncut = re.compile("|".join([_OTHER_SPACE, *names]))
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.merges = self.library.model.tokenize
        self.plain = next((p for p in _PLAIN if all(self._word(w, p) == self._whole(w) for w in PROBES)), None)
        self.pieces = Kept(self._piece)

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, plain: Callable[[str], str]) -> bytes:
        word = plain(word)
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return self._bytes([t.id for t in self.merges(word.replace(" ", _LETTERS[32]))])

    def _piece(self, piece: str) -> bytes:
        if self.plain and _WORD.fullmatch(piece):
            return self._word(piece, self.plain)
        return self._whole(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > KEPT:
            self.pieces.clear()
        get = self.pieces.__getitem__
        return [self._whole(t) if self.uncut.search(t) else b"".join(map(get, _PIECE.findall(t))) for t in texts]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
