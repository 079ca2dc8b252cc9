"""Token ids of texts by a public tokenizer file, inside tasks.

A tokenizer that drops white space, lower-cases, cuts a text into pieces by a pattern
and marks piece ends gives a text the ids of its pieces in a row. Texts are cut
by the same pattern, and each distinct piece is merged once per worker and kept in a
table of bounded size. Words with characters whose treatment is not as plain (see
``_plain``) go to the tokenizer whole; so do texts that hold its special tokens.
Other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np

from .common import release

CACHED_PIECES = 300_000
#: White space for Python, but not for the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Begins the table's keys of words that go to the tokenizer whole; no piece holds it.
_WORD = "\x1d"
#: Fixed value: the pattern by which such a tokenizer cuts lower-case text, letters and digits as classes.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LOADED: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    """``encode(texts)`` gives, per text, its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        cuts = [s.get("pattern", {}).get("Regex") for s in ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [])]
        self.by_piece = spec["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and cuts == [_SPLIT, None]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or ()) or r"(?!)")
        self.vocab_size = max(self.tok.get_vocab().values()) + 1
        self.letters = _byte_letters()
        self.pieces: dict[str, bytes] = {}

    def rest(self) -> None:
        """Forget the pieces at the end of a task; the worker may run other operators next."""
        self.pieces.clear()
        release()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._whole(texts)
        out: list[bytes] = []
        for k in range(0, len(texts), 256):
            out += self._by_piece(texts[k : k + 256])
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        apart = [bool(_ODD_SPACE.search(t) or self.special.search(t)) for t in texts]
        cut = [[] if a else _cut(t) for t, a in zip(texts, apart)]
        self._learn(set().union(*cut))
        get = self.pieces.__getitem__
        return [self._whole([t])[0] if a else b"".join(map(get, c)) for t, a, c in zip(texts, apart, cut)]

    def _learn(self, wanted: set[str]) -> None:
        known = self.pieces
        new = wanted.difference(known)
        if len(known) + len(new) > CACHED_PIECES:
            known = self.pieces = {p: known[p] for p in wanted.difference(new)}
        words = [p for p in new if p[0] == _WORD]
        known.update(zip(words, self._whole([w[1:] for w in words])))
        merges, letters, pack = self.tok.model.tokenize, self.letters, struct.pack
        for p in new.difference(words):
            ids = [t.id for t in merges(p if p.isascii() and p.isprintable() else p.translate(letters))]
            known[p] = pack(f"<{len(ids)}I", *ids)


def _plain(c: str) -> bool:
    """Characters that lower-case one to one and compose with nothing: up to U+024F, if the lower case is there too."""
    low = c.lower()
    return len(low) == 1 and low < "ɐ"


def _class(test) -> str:
    """Characters up to U+024F that pass, as ranges of a character class."""
    fits = [c for c in range(0x250) if test(chr(c))]
    first = [c for c in fits if c - 1 not in fits]
    last = [c for c in fits if c + 1 not in fits]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


_LETTERS, _DIGITS = (_class(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
# The same choices, the most frequent first: no letter or digit begins any of the others.
_PIECE = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}{_DIGITS}]+")
_NOT_PLAIN = f"[^{_class(_plain)}]"
_OTHER = re.compile(_NOT_PLAIN)
_OTHER_WORD = re.compile(rf"(\S*{_NOT_PLAIN}\S*)")


def _cut(text: str) -> list[str]:
    """Pieces of a text; words that are not plain stay whole, as keys of the table."""
    if text.isascii() or not _OTHER.search(text):
        return _PIECE.findall(text.lower())
    out: list[str] = []
    for k, part in enumerate(_OTHER_WORD.split(text)):
        if k % 2:
            out.append(_WORD + part)
        else:
            out += _PIECE.findall(part.lower())
    return out


def _byte_letters() -> dict[int, str]:
    """Characters up to U+024F as the byte-level alphabet writes their UTF-8 bytes.

    Fixed rule: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x250)}
