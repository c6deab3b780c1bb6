"""Exact ids of public byte-level BPE tokenizers, with repeated pieces of text encoded once per worker.

Byte-level BPE never merges over the borders of its pre-tokens, so a text may be cut at borders that every pre-tokenizer
used here respects, and the ids of the cuts joined. Cuts are made only in texts where such borders are plain to see
(no doubled or unusual white space); any other text goes to the tokenizer whole. Words of Latin letters are one
pre-token and go to the BPE model itself; other pieces go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable
from functools import lru_cache

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNUSUAL = re.compile(r"\s\s|[^\S \n]|^\s|\s$").search
#: Bytes of Latin-1 texts that are cut without a closer look, and white space that would need one.
_PLAIN_BYTES = bytes(b for b in range(256) if re.match(rf"[{_LATIN}\n -~]", chr(b)) and chr(b) not in "'<")
_DOUBLED = ("  ", "\n ", " \n", "\n\n")
_MARKS = 1 << 22
_WORD = re.compile(rf" ?[{_LATIN}]+").fullmatch
_PLAIN_PIECES = re.compile(rf" ?[{_LATIN}]+| ?[^{_LATIN} ]+| ").findall
_SPACED_PIECES = re.compile(r" ?[^ ]+| ").findall


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _little(ids: Iterable[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _is_plain(text: str) -> bool:
    """Whether text is of Latin letters and printable ASCII with single spaces and line feeds within it only."""
    try:
        if text.encode("latin-1").translate(None, _PLAIN_BYTES):
            return False
    except UnicodeEncodeError:
        return False
    return not (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _DOUBLED))


class PieceEncoder(dict):
    """text -> ids; as a dict: piece -> its ids as little-endian unsigned 32-bit bytes.

    Most pieces of a corpus occur once, so a piece is kept from its second occurrence on (by a table of marks, in which
    unlike pieces can coincide). The memo has two generations of at most max_pieces each: a full one becomes the old one,
    in place of the last, and pieces that are met again move on from there: frequent pieces stay and memory is bounded."""

    def __init__(self, path: str, max_pieces: int = 200_000):
        super().__init__()
        self._old: dict[str, bytes] = {}
        self._met = bytearray(_MARKS)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._letters = _byte_letters()
        self._max = max_pieces
        normalizer = repr(self._whole.normalizer)
        self._lower = "Lowercase" in normalizer
        self._keeps_space = self._whole.normalizer is None
        self.vocab_size = self._whole.get_vocab_size()
        self._piecewise = self._agrees()

    def _agrees(self) -> bool:
        """Whether pieces give this tokenizer's ids on a text that shows how it cuts; if not, texts are encoded whole."""
        text = "The quick, brown fox: Élan vital! x2 3.14 (a)b\nNew line.\nüber straße don't <|x|> 'quoted' end"
        return all(self._pieces(t, _is_plain(t)) == self._full(t) for t in (text, text.replace("'", "").replace("<", ""), "ÀÉ word", "a.b,c 12 ab12"))

    def _full(self, text: str) -> bytes:
        return _little(self._whole.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self._max:
            self._old, self._met = dict(self), bytearray(_MARKS)
            self.clear()
        ids = self._old.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        if _WORD(piece):
            word = piece if self._keeps_space else piece.lstrip(" ")
            word = (word.lower() if self._lower else word).encode().decode("latin-1").translate(self._letters)
            ids = _little(t.id for t in self._model.tokenize(word))
        else:
            ids = self._full(piece)
        mark = hash(piece) % _MARKS
        if self._met[mark] and len(piece) <= 64:
            self[piece] = ids
        self._met[mark] = 1
        return ids

    def _pieces(self, text: str, plain: bool) -> bytes:
        return b"".join(map(self.__getitem__, (_PLAIN_PIECES if plain else _SPACED_PIECES)(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids of text (null: none) as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        plain = _is_plain(text)
        if self._piecewise and (plain or not _UNUSUAL(text)):
            return self._pieces(text, plain)
        return self._full(text)

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str, max_pieces: int = 200_000) -> PieceEncoder:
    """One encoder for each file, bound and Python worker."""
    return PieceEncoder(path, max_pieces)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
