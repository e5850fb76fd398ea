"""Suffix-array dedup: hash-compared suffix sort over the fragments of a hash part.

A *sparse* suffix array: one suffix for each fragment, starting at its anchor, and one
reading left from it. Prefix polynomial hashes (modulo 2**64, random byte values, odd
base) give the hash of any substring in O(1); binary search on the length finds the
common extension of two suffixes in O(log n); a bottom-up mergesort uses it to compare.
Neighbours' common extensions are checked byte for byte, and a group with a collision
is sorted again by plain comparison. Two windows at offset `o` before the anchor are
equal if the left extensions reach `o` and the right ones the rest.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .repeats import BASE, U64, Bytes, REMOVED, as_bytes, covered, flagged_runs, repeated_windows, with_removals

_values = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=U64)


class SuffixSorter:
    """Suffixes of a byte buffer, each ended by its own length."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, value=_values):
        self.data, self.start, self.length = data, start.astype(np.int64), length.astype(np.int64)
        self.power = np.full(len(data) + 1, BASE, U64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.prefix = np.concatenate([np.zeros(1, U64), np.cumsum(value[data] * self.power[:-1], dtype=U64)])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j, by hash."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        prefix, pa_, pb = self.prefix, self.power[a], self.power[b]
        ha, hb = prefix[a], prefix[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = (prefix[a + mid] - ha) * pb == (prefix[b + mid] - hb) * pa_
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before j (or is equal, where or_equal says so)."""
        n = self.common(i, j)
        ends_i, ends_j = n == self.length[i], n == self.length[j]
        last = len(self.data) - 1
        x = self.data[np.minimum(self.start[i] + n, last)].astype(np.int16)
        y = self.data[np.minimum(self.start[j] + n, last)].astype(np.int16)
        x[ends_i] = -1
        y[ends_j] = -1
        return (x < y) | ((x == y) & or_equal)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes by group, then suffix; the common prefix of each with
        the one before it in its group (0 for the first)."""
        order = np.argsort(group, kind="stable")
        sorted_group = group[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_group[1:] != sorted_group[:-1]
        base = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(order) else base
        within = np.arange(len(order)) - base
        width, most = 1, int(size.max(initial=0))
        while width < most:
            half = within // width
            sibling = (half ^ 1) * width
            has = np.flatnonzero(sibling < size)
            right = (half[has] & 1) == 1
            lo = base[has] + sibling[has]
            first = lo.copy()
            hi = np.minimum(lo + width, base[has] + size[has])
            me = order[has]
            for _ in range(width.bit_length()):
                open_ = lo < hi
                if not open_.any():
                    break
                k = np.flatnonzero(open_)
                mid = (lo[k] + hi[k]) >> 1
                # how many of the sibling run stand before me: equal ones do if they are on the left
                less = self.before(order[mid], me[k], right[k])
                lo[k] = np.where(less, mid + 1, lo[k])
                hi[k] = np.where(less, hi[k], mid)
            target = np.arange(len(order))
            block = base[has] + (half[has] // 2) * 2 * width
            target[has] = block + (within[has] - half[has] * width) + (lo - first)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        shared = np.zeros(len(order), np.int64)
        rest = np.flatnonzero(~new)
        shared[rest] = self.common(order[rest - 1], order[rest])
        return self.verified(order, shared, sorted_group, rest)

    def verified(self, order, shared, sorted_group, rest):
        """Compares neighbours byte for byte: the prefix they share, and that the next byte
        puts them in this order. If all are, the order is right; groups in which a hash
        collision misled the sort are sorted anew."""
        n = shared[rest]
        left, right = order[rest - 1], order[rest]
        ends = np.cumsum(n)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        same = self.data[np.repeat(self.start[left], n) + step] == self.data[np.repeat(self.start[right], n) + step]
        wrong = np.zeros(len(rest), bool)
        wrong[np.repeat(np.arange(len(rest)), n)[~same]] = True
        last = len(self.data) - 1
        x = np.where(n == self.length[left], -1, self.data[np.minimum(self.start[left] + n, last)].astype(np.int16))
        y = np.where(n == self.length[right], -1, self.data[np.minimum(self.start[right] + n, last)].astype(np.int16))
        wrong |= (x > y) | ((x == y) & (x >= 0))
        if not wrong.any():
            return order, shared
        bad = np.unique(sorted_group[rest[wrong]])
        text = self.data.tobytes()
        string = lambda i: text[self.start[i] : self.start[i] + self.length[i]]
        for g in bad:
            at = np.flatnonzero(sorted_group == g)
            order[at] = sorted(order[at], key=cmp_to_key(lambda i, j: (string(i) > string(j)) - (string(i) < string(j))))
            for k in at[1:]:
                x, y = string(order[k - 1]), string(order[k])
                shared[k] = next((m for m in range(min(len(x), len(y))) if x[m] != y[m]), min(len(x), len(y)))
        return order, shared


def earlier_windows(rows: np.ndarray, strings: list[bytes], window: int) -> np.ndarray:
    """REMOVED windows of byte fragments (FRAGMENT rows): those whose string starts in
    a smaller doc, or earlier in the same text."""
    if not len(rows):
        return np.zeros(0, REMOVED)
    order = np.lexsort((rows["first"], rows["tid"], rows["doc"]))  # from here on a lower number is an earlier place
    rows, strings = rows[order], [strings[i] for i in order]
    data = np.frombuffer(b"".join(strings), np.uint8)
    size = rows["size"].astype(np.int64)
    offset = np.cumsum(size) - size
    anchor, windows = rows["anchor"].astype(np.int64), rows["windows"].astype(np.int64)
    group = np.unique(rows["hash"], return_inverse=True)[1]
    right_order, right = SuffixSorter(data, offset + anchor, size - anchor).sort(group)
    left_order, left = SuffixSorter(data[::-1].copy(), len(data) - offset - anchor, anchor).sort(group)
    flags = np.zeros(int(windows.sum()), bool)
    at = np.cumsum(windows) - windows
    uid = np.unique(np.stack([rows["doc"], rows["tid"]]), axis=1, return_inverse=True)[1].ravel()
    doc, place = rows["doc"], rows["first"].astype(np.int64)
    n = len(rows)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for reach in range(int(anchor.max()) + 1):
        # the windows that begin `reach` bytes before their anchor
        has = np.flatnonzero((reach <= anchor) & (reach > anchor - windows))
        if len(has) < 2:
            continue
        right_class[right_order] = np.cumsum(right < window - reach)
        left_class[left_order] = np.cumsum(left < reach) if reach else 0
        key = right_class[has] * (n + 1) + left_class[has]
        by = np.argsort(key, kind="stable")
        who, key = has[by], key[by]
        new = np.ones(len(who), bool)
        new[1:] = key[1:] != key[:-1]
        lead = who[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        new_own = new.copy()
        new_own[1:] |= uid[who[1:]] != uid[who[:-1]]
        own = who[np.maximum.accumulate(np.where(new_own, np.arange(len(who)), 0))]
        start = place + anchor - reach
        gone = who[(doc[lead] < doc[who]) | (start[own] < start[who])]
        flags[at[gone] + anchor[gone] - reach] = True
    return flagged_runs(rows, np.split(flags, at[1:]))


def remove_repeats(docs: DataFrame, window: int = 100, with_text: bool = True) -> DataFrame:
    """Removes every byte covered by a `window`-byte string that also starts earlier
    (smaller doc_id, or same document, earlier start); overlaps count, and strings are
    judged on the input.

    Returns doc_id, kept (binary: the rest of the text's bytes), n_bytes, n_removed,
    n_spans, kept_sha256, one row for each input row; without with_text, kept is null. A
    null text counts as empty. Rows with the same doc_id and different texts are
    different documents of which neither is earlier; equal rows are one document and fare
    alike. A null doc_id comes before all others. Texts are searched whole, in chunks of
    whole texts. No rows give none, and other columns play no part.
    """
    texts = common.keyed_texts(docs)
    found = repeated_windows(texts, Bytes(), window, lambda rows, strings: earlier_windows(rows, strings, window), common.parts_for(docs))

    def finish(batches):
        for batch in batches:
            doc, text, packed, copied = (batch.column(c) for c in ("doc", "text", "packed", "copied"))
            out = []
            for text, packed, copied in zip(as_bytes(text), packed.to_pylist(), copied.to_pylist()):
                gone = covered(packed, len(text), window)
                if copied and len(text) >= window:
                    gone[:] = True
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
                out.append((kept, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            kept, n, removed, spans, digest = zip(*out) if out else ([],) * 5
            kept = kept if with_text else [None] * len(out)
            numbers = [pa.array(x, pa.int64()) for x in (n, removed, spans)]
            columns = [doc, pa.array(kept, pa.binary()), *numbers, pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = with_removals(texts, found).mapInArrow(finish, "doc long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(common.doc_id_of().alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
