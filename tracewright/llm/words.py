"""Word-level byte-pair encoding of whole texts with a vocabulary file, for Python workers.

The vocabulary lower-cases, drops white space and merges inside words only, so the runs between spaces and line feeds are encoded apart: no pre-token,
composition or case rule reaches over white space, and every other kind of white space stays inside its run for the library to treat.
"""

from __future__ import annotations

import array
import os
import re

from tokenizers import Tokenizer

#: Runs in each of the two tables that a worker keeps, about 200 bytes each; a full table becomes the older one, and the one before it goes.
KEPT_UNITS = 300_000
#: Longer runs are encoded, but not kept.
KEPT_LENGTH = 64
#: Letters of Latin-1, which are composed and have lower-case forms of one letter, and a mark that is neither letter, digit, apostrophe nor part of a special token.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?-@\[-`{}~]?)")
#: How byte-level vocabularies write bytes: printable ones as their Latin-1 characters, others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_NAMES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


class WordEncoder:
    """Encode texts to little-endian unsigned 32-bit ids, reusing the ids of known runs."""

    def __init__(self, vocabulary: str) -> None:
        """``vocabulary``: path of a ``tokenizers`` file whose pre-tokens never hold white space."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._library = Tokenizer.from_file(vocabulary)
        self._library.no_truncation()
        self._library.no_padding()
        self._model = self._library.model
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as bytes, without added special tokens; special strings inside it count as such."""
        units = text.replace("\n", " ").split(" ")
        ids = list(map(self._known.get, units))
        k = -1
        for _ in range(ids.count(None)):
            k = ids.index(None, k + 1)
            ids[k] = self._missing(units[k])
        return b"".join(ids)

    def _missing(self, unit: str) -> bytes:
        ids = self._known.get(unit) or self._older.get(unit)
        if ids is None:
            found = _PLAIN.fullmatch(unit)
            if found is None:
                ids = self._whole(unit)
            else:  # letters, and perhaps a mark behind them, which is a pre-token of its own
                word, mark = found.groups()
                folded = word.lower()
                ids = self._known.get(folded) or self._letters(folded)
                if mark:
                    ids += self._known.get(mark) or self._missing(mark)
        if len(unit) <= KEPT_LENGTH:
            if len(self._known) >= KEPT_UNITS:  # what is still in use comes back from the older table
                self._known, self._older = {}, self._known
            self._known[unit] = ids
        return ids

    def _whole(self, unit: str) -> bytes:
        return array.array("I", self._library.encode(unit, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of one pre-token of lower-case letters, by the library's model without its other steps, which leave such a word as it is."""
        name = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array.array("I", [t.id for t in self._model.tokenize(name)]).tobytes()


_encoders: dict[str, WordEncoder] = {}


def word_encoder(vocabulary: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]
