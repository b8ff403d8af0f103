"""Byte-level BPE ids of whole texts, through the tokenizers library, with a bounded cache of pieces.

The library's own ``encode`` costs about a microsecond a byte.  Its pre-tokenizer never lets a piece cross the boundary before a
single space, so a text is cut there, each unit is looked up, and only units that were not seen lately reach the library.
"""

from __future__ import annotations

import json
import re
from itertools import islice

import numpy as np

_L, _N, _S = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9", " \t\n\r\x0b\x0c"
#: The pre-tokenizer's pattern for texts of ASCII and Latin-1 letters only, where its classes are these.
_PLAIN = re.compile(rf"[\x00-\x7fÀ-ÖØ-öø-ÿ]*\Z")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Encoder:
    """``encode(text)`` gives the ids as bytes of ``dtype``; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, cached: int = 800_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        pre = spec.get("pre_tokenizer") or {}
        #: Other kinds of tokenizer get whole texts.
        self.by_piece = not spec.get("normalizer") and spec["model"]["type"] == "BPE" and (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.model, self.pre = self.whole.model, self.whole.pre_tokenizer
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.id_bytes = [np.array(i, self.dtype).tobytes() for i in range(self.whole.get_vocab_size())]
        self.cached = cached
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        #: Characters of plain texts as the model's letters for their bytes.
        self.mapped = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.space = self.mapped[32]

    def _ids(self, mapped: str) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(mapped)])

    def _keep(self, cache: dict[str, bytes], key: str, found: bytes) -> bytes:
        if len(cache) >= self.cached:  # the older half goes; what is common in it soon comes back
            for old in list(islice(cache, self.cached // 2)):
                del cache[old]
        if len(key) <= 64:
            cache[key] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pattern.  A piece with its space is also a unit, and is kept as one."""
        cache, key = (self.units, piece[1:]) if piece[0] == " " and not piece[-1].isspace() else (self.pieces, piece)
        found = cache.get(key)
        return self._keep(cache, key, self._ids(piece.translate(self.mapped))) if found is None else found

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if not text:
            return b""
        units = text.split(" ")
        first, last = units[0], len(units) - 1
        if last and first and first[-1].isspace():
            return self._runs(text)
        found = list(map(self.units.get, units))
        found[0] = self._bare(first) if first else b""
        for at in [i for i, ids in enumerate(found) if ids is None]:
            unit = units[at]
            if at < last and (not unit or unit[-1].isspace()):
                return self._runs(text)
            found[at] = self._after_space(unit)
        return b"".join(found)

    def _runs(self, text: str) -> bytes:
        """A text with white space before some space, which belongs to no unit of its own."""
        return b"".join(map(self._bare, re.split(r"(?= \S)", text)))

    def _after_space(self, unit: str) -> bytes:
        """Kept under the unit without its space, unless it ends in white space: so a unit that is known ends in none."""
        found = self.units.get(unit)
        if found is not None:
            return found
        if unit.isascii() and unit.isalpha():
            found = self._ids(self.space + unit)
        elif unit.isascii() and unit[:-1].isalpha() and unit[-1] in ",.":
            found = self._after_space(unit[:-1]) + self._piece(unit[-1])
        else:
            found = self._bare(" " + unit)
        return self._keep(self.units, unit, found) if unit and not unit[-1].isspace() else found

    def _bare(self, unit: str) -> bytes:
        if not _PLAIN.match(unit):
            return b"".join([self._ids(p) for p, _ in self.pre.pre_tokenize_str(unit)])
        pieces = _PIECES.findall(unit)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in each Python worker, which serves many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
