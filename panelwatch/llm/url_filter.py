"""URL filters: all glob rules run at once as bits of a Shift-And automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = 64


@dataclass
class GlobAutomaton:
    """Globs packed one behind the other into 64-bit words, matched against whole strings.

    ``*`` stands for any characters but ``/``, ``**`` for any characters, ``?`` for one character but ``/``. Each glob
    owns one bit for each prefix of its symbols; a star is a loop on the bit before it. One step of all globs is a shift,
    a mask for the character read, and the loops.
    """

    globs: list[str]
    words: int = field(init=False)

    def __post_init__(self):
        symbols, starts, finals, loops = [], [], [], []
        for glob in self.globs:
            starts.append(len(symbols))
            symbols.append(None)
            i = 0
            while i < len(glob):
                if glob.startswith("**", i):
                    loops.append((len(symbols) - 1, True))
                    i += 1
                elif glob[i] == "*":
                    loops.append((len(symbols) - 1, False))
                else:
                    symbols.append(glob[i])
                i += 1
            finals.append(len(symbols) - 1)
        self.words = max(1, -(-len(symbols) // _WORD))
        self._finals = np.array(finals, dtype=np.int64)
        chars = sorted({s for s in symbols if s} - {"?"} | {"/"})
        self._chars = np.array([ord(c) for c in chars], dtype=np.uint32)
        self._start = self._packed(starts)
        self._step = np.zeros((len(chars) + 1, self.words), dtype=np.uint64)  # row 0: any character no glob names
        self._loop = np.zeros_like(self._step)
        for row, c in enumerate(["", *chars]):
            self._step[row] = self._packed([i for i, s in enumerate(symbols) if s and (s == c or s == "?" and c != "/")])
            self._loop[row] = self._packed([i for i, every in loops if every or c != "/"])

    def _packed(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            out[b // _WORD] |= np.uint64(1 << (b % _WORD))
        return out

    def matches(self, strings: list[str]) -> np.ndarray:
        """Which string matches which glob: booleans, strings by globs. Strings of equal length step together."""
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.repeat(self._start[None, :], len(strings), axis=0)
        ends = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.searchsorted(self._chars, points)
        known = self._chars[np.minimum(place, len(self._chars) - 1)] == points
        rows = np.where(known, place + 1, 0)
        sorted_lengths = lengths[order]
        for at in range(int(sorted_lengths[0]) if len(strings) else 0):
            active = order[: np.searchsorted(-sorted_lengths, -at, side="left")]
            row = rows[ends[active] + at]
            now = state[active]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(_WORD - 1)
            state[active] = (shifted & self._step[row]) | (now & self._loop[row])
        bit = np.uint64(1) << (self._finals % _WORD).astype(np.uint64)
        return (state[:, self._finals // _WORD] & bit) != 0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path behind it; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return host, path


def filter_urls(df: DataFrame, url: str, rules: dict[str, str], globs: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``host``, ``path``, ``rule`` and ``verdict`` of each url.

    ``rules`` maps ``host/path`` to allow or block: it fits its host and all subdomains when the path starts with its
    own. The longest fitting rule decides. Where none fits, a url that matches one of ``globs`` is blocked and any other
    allowed. Nulls and urls without ``://`` have empty host and path and match no rule.
    """
    taken = {"host", "path", "rule", "verdict"} & set(keep)
    if taken:
        raise ValueError(f"columns {sorted(taken)} clash with the result")
    named = sorted(rules, key=lambda r: (-len(r), r))
    patterns = [p for r in named for p in (f"{r}**", f"*.{r}**")] + list(globs)
    host, path = host_and_path(F.col(f"`{url}`"))
    ready = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = GlobAutomaton(patterns)
        for batch in batches:
            hit = automaton.matches((batch["host"] + batch["path"]).tolist())
            fits = hit[:, : 2 * len(named)].reshape(len(batch), len(named), 2).any(axis=2)
            found = fits.any(axis=1)
            first = fits.argmax(axis=1) if named else np.zeros(len(batch), dtype=int)
            blocked = hit[:, 2 * len(named) :].any(axis=1)
            batch["rule"] = [named[i] if f else None for i, f in zip(first, found)]
            batch["verdict"] = [
                rules[named[i]] if f else "block" if b else "allow" for i, f, b in zip(first, found, blocked)
            ]
            yield batch

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema] + ["rule string", "verdict string"])
    return ready.mapInPandas(judged, schema)
