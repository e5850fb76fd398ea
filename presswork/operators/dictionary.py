"""Entities of a dictionary in texts: one pass of an automaton over each text.

All aliases are in one Aho-Corasick automaton over case-folded characters, built once in
each worker, so the work for a text grows with its length and its hits, not with the
dictionary. Borders of words are checked at the hits, then the aliases claim their spans.
"""

from __future__ import annotations

import hashlib
import pickle
import unicodedata
from functools import lru_cache

import ahocorasick


class Folding(dict):
    """For str.translate: each character as one character without its case."""

    def __missing__(self, code: int) -> int:
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        self[code] = ord(lower) if len(lower) == 1 else code
        return self[code]


FOLDING = Folding()


def folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(FOLDING)


@lru_cache(maxsize=1 << 16)
def in_word(char: str) -> bool:
    """Letters, marks, decimal digits, letter numbers, connectors and joiners."""
    kind = unicodedata.category(char)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or char in "‌‍"


class Matcher:
    """entries: (alias, entity), in the order in which they claim."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.entries = entries
        self.sizes = [len(alias) for alias, _ in entries]
        places: dict[str, list[int]] = {}
        for i, (alias, _) in enumerate(entries):
            places.setdefault(folded(alias), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for alias, listed in places.items():
            self.automaton.add_word(alias, listed)
        if places:
            self.automaton.make_automaton()

    def firsts(self, text: str) -> dict[int, int]:
        """{entry: start} of the first occurrence of each alias between borders of words."""
        out: dict[int, int] = {}
        if not self.entries:
            return out
        whole = len(text)
        for end, listed in self.automaton.iter(folded(text)):
            if listed[0] in out:
                continue
            start = end + 1 - self.sizes[listed[0]]
            if (start > 0 and in_word(text[start - 1])) == in_word(text[start]):
                continue
            if (end + 1 < whole and in_word(text[end + 1])) == in_word(text[end]):
                continue
            for i in listed:
                out[i] = start
        return out

    def claims(self, text: str | None) -> list[tuple[int, str]]:
        """(entity, what the text says), in the order of claims: an alias that overlaps a
        claimed span, or whose entity has claimed already, is passed over."""
        found, out, spans, taken = self.firsts(text or ""), [], [], set()
        for i in sorted(found):
            entity, start, end = self.entries[i][1], found[i], found[i] + self.sizes[i]
            if entity not in taken and all(end <= a or b <= start for a, b in spans):
                taken.add(entity)
                spans.append((start, end))
                out.append((entity, text[start:end]))
        return out


_made: dict[str, Matcher] = {}


def packed(entries: list[tuple[str, int]]) -> tuple[str, bytes]:
    """(name, bytes) of a dictionary to send to the workers."""
    data = pickle.dumps(entries)
    return hashlib.sha256(data).hexdigest(), data


def matcher(name: str, data: bytes) -> Matcher:
    """The worker's automaton of the dictionary, made at its first use."""
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(pickle.loads(data))
    return _made[name]
