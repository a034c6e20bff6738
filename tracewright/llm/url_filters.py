"""URL filters: all wildcard rules run at once over each canonical URL, bit-parallel.

A canonical URL is ``.host/path``: a dot, the host with A-Z lower-cased, a slash, and the
path (which is empty or starts with a slash of its own). The first slash therefore always
ends the host, and a rule for ``example.net`` fits it and its subdomains as the glob
``*.example.net/`` + path + ``*`` whose leading star stays inside the host.

The globs are packed end to end into 64-bit words, one bit for each state (Shift-And with
self-loops for stars). A step over one character of every URL of a batch is a table look-up,
a shift with carry between the words, and two masks; rows never meet, so the operator needs
no shuffle and the state is (URLs in the batch) x (words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the (URLs x characters) matrix that one step of the scan holds.
CELLS = 1 << 22


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` may hold ``*`` (any run, within its part) and ``?`` (one character)."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Automaton:
    """All rules as one nondeterministic automaton over multiword bit masks."""

    def __init__(self, rules: list[Rule]) -> None:
        # Longest rule first, then by name: the first accepting rule decides.
        self.rules = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))
        states: list[tuple[str, str]] = []  # (what enters the state, what loops on it)
        starts, ends = [], []
        for rule in self.rules:
            starts.append(len(states))
            states.append(("", "host"))
            for part, text in (("host", "." + rule.host), ("sep", "/"), ("any", rule.path)):
                for char in text:
                    if char == "*" and part != "sep":
                        states[-1] = (states[-1][0], part)
                    elif char == "?" and part != "sep":
                        states.append((f"one-{part}", ""))
                    else:
                        states.append((char, ""))
            states[-1] = (states[-1][0], "any")
            ends.append(len(states) - 1)
        letters = sorted({enter for enter, _ in states if len(enter) == 1} | {"/"})
        self.codes = np.array([ord(c) for c in letters], dtype=np.uint32)
        other, pad = len(letters), len(letters) + 1
        self.other, self.pad = other, pad
        self.words = max(1, -(-len(states) // 64))
        self.enter = np.zeros((pad + 1, self.words), dtype=np.uint64)
        self.stay = np.zeros((pad + 1, self.words), dtype=np.uint64)
        self.stay[pad] = np.uint64(0xFFFFFFFFFFFFFFFF)
        for k, (enter, loop) in enumerate(states):
            word, bit = k // 64, np.uint64(1) << np.uint64(k % 64)
            for c in range(other + 1):
                char = letters[c] if c < other else ""
                if enter == char != "" or enter == "one-any" or enter == "one-host" and char != "/":
                    self.enter[c, word] |= bit
                if loop == "any" or loop == "host" and char != "/":
                    self.stay[c, word] |= bit
        self.start = np.zeros(self.words, dtype=np.uint64)
        for k in starts:
            self.start[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        self.ends = ends

    def classes(self, urls: list[str]) -> np.ndarray:
        width = max(map(len, urls), default=0)
        flat = np.frombuffer("".join(u.ljust(width, "\0") for u in urls).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.searchsorted(self.codes, flat)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == flat
        out = np.where(known, at, self.other).astype(np.uint16).reshape(len(urls), width)
        out[np.arange(width)[None, :] >= np.array([len(u) for u in urls])[:, None]] = self.pad
        return out

    def first_fits(self, urls: list[str]) -> np.ndarray:
        """For each URL the position of the first rule that fits, or -1."""
        found = np.full(len(urls), -1, dtype=np.int64)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        a = 0
        while a < len(order):
            # Alike lengths go together, as many as fit into CELLS; a longer URL goes alone.
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(urls[order[b]]) <= CELLS:
                b += 1
            found[order[a:b]] = self._scan([urls[i] for i in order[a:b]])
            a = b
        return found

    def _scan(self, urls: list[str]) -> np.ndarray:
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        for column in self.classes(urls).T:
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.enter[column]) | (state & self.stay[column])
        fits = np.full(len(urls), -1, dtype=np.int64)
        for k in range(len(self.ends) - 1, -1, -1):
            hit = (state[:, self.ends[k] // 64] >> np.uint64(self.ends[k] % 64)) & one
            fits[hit == one] = k
        return fits


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
    path: what follows up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has
    both empty, and fits no rule. Among the rules that fit, the longest (host and path
    together) decides, and the first by name among equally long ones; with none, ``rule`` is
    null and ``verdict`` is ``default``. Repeated rows each get their row, an empty table
    gives an empty result, and columns of the input named like a new one are replaced.
    """
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    low = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = pages.select(*[F.col(f"`{c}`") for c in kept], low.alias("host"), F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2).alias("path"))
    machine = Automaton(rules)

    @F.pandas_udf("int")
    def fits(hosts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in hosts:
            yield pd.Series(machine.first_fits(list("." + host + "/" + path)), dtype="int32")

    names = F.array(*[F.lit(r.name) for r in machine.rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in machine.rules])
    # A longer name than any column's, so that none can clash with it.
    at = max(["path", *kept], key=len) + "_"
    judged = split.withColumn(at, fits("host", "path"))
    place, none = F.col(f"`{at}`"), F.col(f"`{at}`") < 0
    if not rules:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return judged.withColumns(
        {"rule": F.when(~none, F.element_at(names, F.greatest(place, F.lit(0)) + 1)), "verdict": F.when(none, F.lit(default)).otherwise(F.element_at(verdicts, F.greatest(place, F.lit(0)) + 1))}
    ).drop(at)
