"""Substring dedup: a compressed FM-index for each shard, searched backward.

A shard is a hash part of repeats.repeated_windows: the word strings around anchors
that occur in two places or more. Its distinct strings are indexed: the Burrows-Wheeler
transform in a wavelet matrix of packed bits, common prefixes of neighbouring suffixes in
one byte each, and the smallest document of each distinct window, found by a bit vector
of the windows' first suffixes. Neither the text nor the suffix array stays. Every
document's strings are streamed through the index from their last words to their first.
The matching statistics of a position (longest match that starts there, cut off at the
window length) come with the suffix interval of the match; an interval of the
full length tells whether an earlier document has the window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .repeats import REMOVED, Words, as_bytes, covered, flagged_runs, repeated_windows, with_removals

U64 = np.uint64
SPLIT_WORDS = bytes(range(9, 14)) + b" "
_to_space = bytes(32 if i in SPLIT_WORDS else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The runs of bytes other than 0x09-0x0D and space."""
    return [w for w in text.translate(_to_space).split(b" ") if w]


class Bits:
    """A packed bit vector with the count of ones before each 64-bit word."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.uint32, out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((U64(1) << (i & 63).astype(U64)) - U64(1))).astype(np.int64)


class WaveletMatrix:
    """rank(c, i): occurrences of c in the first i symbols. One bit vector for each bit
    of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(n_symbols)
        self.floor = self._descend(every, np.zeros(n_symbols, np.int64))  # where each symbol's copies begin below the last level

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (vector, zeros) in enumerate(self.levels):
            ones = vector.rank(i)
            i = np.where((c >> (self.bits - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(c, i) - self.floor[c]


class FMIndex:
    """Index over strings of symbols 1..n_symbols-1; 0 ends each string. `doc`: the
    document of each symbol.

    Suffixes are sorted by their first `depth` symbols (at most 255) or more, which is
    enough for patterns up to that length.
    """

    def __init__(self, strings: np.ndarray, n_symbols: int, depth: int, doc: np.ndarray | None = None):
        n = len(strings)
        self.n, self.depth = n, depth
        rank, span = strings.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while span < depth:
            shifted = np.full(n, -1, np.int64)
            shifted[: max(n - span, 0)] = rank[span:]
            key = rank * (n + n_symbols + 1) + shifted + 1
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            span *= 2
        self.first = np.searchsorted(np.sort(strings), np.arange(n_symbols + 1))  # suffixes that begin with a smaller symbol
        self.bwt = WaveletMatrix(strings[order - 1], n_symbols)
        self.shared = self._neighbours(strings, order, depth)
        self.heads = Bits(self.shared < depth)  # the first suffix of each distinct window
        starts = np.flatnonzero(self.shared < depth)
        self.smallest = np.minimum.reduceat(doc[order], starts) if doc is not None and n else None

    @staticmethod
    def _neighbours(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
        """Length, up to depth, of the common prefix of each suffix and the one before it."""
        n = len(text)
        shared = np.zeros(n, np.uint8)
        active = np.arange(1, n)
        for d in range(depth):
            a, b = order[active] + d, order[active - 1] + d
            inside = (a < n) & (b < n)
            same = inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
            active = active[same]
            shared[active] = d + 1
            if not len(active):
                break
        return shared

    def around(self, i: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes with the same first `depth` symbols as suffix i."""
        starts = np.flatnonzero(self.shared < depth) if depth else np.zeros(1, np.int64)
        k = np.searchsorted(starts, i, "right") - 1
        return starts[k], np.append(starts, self.n)[k + 1]

    def first_doc(self, i: np.ndarray) -> np.ndarray:
        """The smallest document with the window (of `depth` symbols) of suffix i."""
        return self.smallest[self.heads.rank(i + 1) - 1]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: from the interval of P to that of cP."""
        both = np.tile(self.first[c], 2) + self.bwt.rank(np.tile(c, 2), np.concatenate([lo, hi]))
        return both[: len(c)], both[len(c) :]

    def matching_statistics(self, strings: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int):
        """For every position of the strings: the longest match, up to `most` symbols, of
        the string from there on, and its suffix interval (length, lo, hi).

        All strings move in step, from their ends. A match that has reached `most` drops
        its last symbol before the next is put in front; one that can't be extended
        drops symbols until it can.
        """
        length = np.zeros(len(strings), np.int64)
        low, high = length.copy(), length.copy()
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        m, lo, hi = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)

        def cut(who, to):
            for depth in np.unique(to):
                k = who[to == depth]
                begin, end = self.around(np.minimum(lo[k], self.n - 1), int(depth))
                hi[k] = np.where(hi[k] > lo[k], end, hi[k])
                lo[k] = begin
                m[k] = depth

        for step in range(1, int(sizes.max(initial=0)) + 1):
            on = int(np.searchsorted(-sizes, -step, "right"))  # strings of at least `step` symbols
            at = starts[:on] + sizes[:on] - step
            if len(full := np.flatnonzero(m[:on] == most)):
                cut(full, np.full(len(full), most - 1))
            c = strings[at]
            todo = np.arange(on)
            while len(todo):
                a, b = self.extend(c[todo], lo[todo], hi[todo])
                good = a < b
                done = todo[good]
                lo[done], hi[done] = a[good], b[good]
                m[done] += 1
                todo = todo[~good]
                gone = todo[m[todo] == 0]  # the symbol occurs nowhere
                lo[gone], hi[gone] = 0, self.n
                todo = todo[m[todo] > 0]
                if len(todo):
                    cut(todo, m[todo] - 1)
            length[at], low[at], high[at] = m[:on], lo[:on], hi[:on]
        return length, low, high


def windows_seen_before(rows: np.ndarray, strings: list[bytes], window: int) -> np.ndarray:
    """REMOVED windows of word fragments (FRAGMENT rows): those whose words also start in a
    smaller doc. Each distinct string is indexed once, with its smallest doc, and what the
    index says of its windows is held against every document that has it."""
    if not len(rows):
        return np.zeros(0, REMOVED)
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(s, len(place)) for s in strings])
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, which, rows["doc"])
    number: dict[bytes, int] = {}
    ids, sizes = [], []
    for string in place:
        words = words_of(string)
        ids += [number.setdefault(w, len(number) + 1) for w in words]
        ids.append(0)
        sizes.append(len(words))
    symbols, sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    index = FMIndex(symbols, len(number) + 1, window, np.repeat(least, sizes + 1))
    length, low, _ = index.matching_statistics(symbols, starts, sizes, window)
    never = np.iinfo(np.int64).max
    seen = np.where(length >= window, index.first_doc(np.minimum(low, index.n - 1)), never)
    return flagged_runs(rows, [seen[starts[k] : starts[k] + int(row["windows"])] < row["doc"] for k, row in zip(which, rows)])


def remove_repeated_windows(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    """Removes each word covered by a window of `window` words whose word sequence also
    starts in a document with a smaller doc_id; windows are judged on the input.

    Words are maximal runs of anything but ASCII white space, unchanged. Returns doc_id,
    kept (the words left, joined by one space), n_words, n_removed, kept_sha256, one row
    for each input row; without with_text, kept is null. A null text has no words. Rows
    with the same doc_id don't remove each other's words. A null doc_id counts as the
    smallest. Texts are searched whole, in chunks of whole texts. No rows give none, and
    other columns play no part.
    """
    texts = common.keyed_texts(docs)
    found = repeated_windows(texts, Words(), window, lambda rows, strings: windows_seen_before(rows, strings, window), common.parts_for(docs), merged=False)

    def finish(batches):
        for batch in batches:
            doc, text, packed, copied = (batch.column(c) for c in ("doc", "text", "packed", "copied"))
            out = []
            for text, packed, copied in zip(as_bytes(text), packed.to_pylist(), copied.to_pylist()):
                words = words_of(text)
                n = len(words)
                if copied and n >= window:
                    words = []
                elif packed:
                    gone = covered(packed, n, window)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                out.append((kept if with_text else None, n, n - len(words), hashlib.sha256(kept).hexdigest()))
            kept, n, removed, digest = zip(*out) if out else ([],) * 4
            text = pa.array(kept, pa.binary()).cast(pa.string())
            columns = [doc, text, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "kept", "n_words", "n_removed", "kept_sha256"])

    out = with_removals(texts, found).mapInArrow(finish, "doc long, kept string, n_words long, n_removed long, kept_sha256 string")
    return out.select(common.doc_id_of().alias("doc_id"), "kept", "n_words", "n_removed", "kept_sha256")
