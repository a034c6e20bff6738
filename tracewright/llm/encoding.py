"""Byte-pair encoding of whole texts with a byte-level vocabulary file, for Python workers.

Byte-level BPE splits a text into pre-tokens and merges bytes inside each of them only. A cut
before a single space that stands between two characters other than white space is always a
boundary of pre-tokens, whatever stands farther off: a space can only begin a pre-token there,
and no pattern looks back. Between such cuts lie *units* whose ids do not depend on the rest of
the text, so each worker encodes a unit once and keeps its ids in a table of bounded size.
"""

from __future__ import annotations

import array
import base64
import json
import os
import re

import public_tokenizers
import tiktoken

#: A place where no pre-token of any text goes on.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A space beside other white space or at an end: then splitting at every space is not safe.
_LOOSE_SPACE = re.compile(r"[^\S ] | [^\S ]")
#: Units in each of the two tables that a worker keeps, about 200 bytes each; a full table
#: becomes the older one, and the one before it goes.
KEPT_UNITS = 300_000
#: Longer units are encoded, but not kept.
KEPT_LENGTH = 64


class UnitEncoder:
    """Encode texts to little-endian unsigned 32-bit ids, reusing the ids of known units."""

    def __init__(self, vocabulary: str) -> None:
        """``vocabulary``: path of a ``tokenizers`` file; its ranks lie beside it as ``.tiktoken``."""
        ranks = {}
        with open(os.path.splitext(vocabulary)[0] + ".tiktoken", "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        with open(vocabulary, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self._ranks = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self.tokens = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        for token, rank in self.special.items():
            self.tokens[rank] = token.encode()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as bytes, without added special tokens; special strings inside it count as such."""
        if self._special and self._special.search(text):
            parts = self._special.split(text)
            return b"".join(array.array("I", [self.special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0] == " " or text[-1] == " " or _LOOSE_SPACE.search(text):
            first, *rest = SAFE_CUT.split(text)
            rest = [u[1:] for u in rest]
        else:
            first, *rest = text.split(" ")
        # All units but the first begin with a space, which is left out of their keys.
        ids = list(map(self._known.get, rest))
        if None in ids:
            k = -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                ids[k] = self._missing(rest[k])
        return array.array("I", self._ranks.encode_ordinary(first)).tobytes() + b"".join(ids)

    def _missing(self, unit: str) -> bytes:
        ids = self._known.get(unit) or self._older.get(unit)
        if ids is None:
            ids = array.array("I", self._ranks.encode_ordinary(" " + unit)).tobytes()
        if len(unit) <= KEPT_LENGTH:
            if len(self._known) >= KEPT_UNITS:  # what is still in use comes back from the older table
                self._known, self._older = {}, self._known
            self._known[unit] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in array.array("I", ids)]).decode("utf-8", "replace")


_encoders: dict[str, UnitEncoder] = {}


def encoder(vocabulary: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = UnitEncoder(vocabulary)
    return _encoders[vocabulary]


def worker_path(vocabulary: str) -> str:
    """A path is used as it is; a bare file name is looked up among this worker's public tokenizers."""
    return vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary)
