"""Distribution of the search for repeated windows (fixed-length token strings).

A window's smallest gram (by hash, the first of equals) is its anchor: equal windows
have equal anchors at equal offsets, so all copies of a window meet in the hash part
of their anchor. Neighbouring windows with the same anchor form one run, and only
runs whose anchor occurs in at least two different places travel with their tokens:

1. ``copies``    equal texts are one text: only the first document goes on;
2. ``anchors``   texts -> packed (hash, doc, tid, position) by part. Anchors with two
   places in one batch are known to be repeated and send one row for all of them;
3. ``repeated``  part -> positions of anchors seen in two places or more;
4. ``fragments`` texts with such positions -> packed token strings by part. Copies of
   a fragment inside one batch that the first of them already covers are settled on
   the spot, so a passage that many documents share sends one fragment a batch;
5. a solver for each part (suffix sort or FM-index) -> windows to remove;
6. a join of these with the texts. All joins use the same exchange of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
#: Bits of a token's place in a text; the other bits of an anchor's hash decide which is smallest.
POSITION_BITS = 31
CHUNK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15

ANCHOR = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tid", "<i8"), ("at", "<u4")])
FRAGMENT = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("tid", "<i8"), ("first", "<u4"), ("windows", "<u4"), ("anchor", "<u4"), ("size", "<u4")])
REMOVED = np.dtype([("doc", "<i8"), ("tid", "<i8"), ("first", "<u4"), ("windows", "<u4")])

PART_SCHEMA = "part int, meta binary, data binary"
REPLY_SCHEMA = "doc long, tid long, packed binary"
_part = pa.schema([("part", pa.int32()), ("meta", pa.binary()), ("data", pa.binary())])
_reply = pa.schema([("doc", pa.int64()), ("tid", pa.int64()), ("packed", pa.binary())])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(29))


class Bytes:
    """Every byte of the UTF-8 text is a token."""

    gram = 24

    def tokens(self, data: np.ndarray, ends: np.ndarray):
        """(hash of the gram at each token, token count up to the end of each text,
        first byte of each token, byte after each token)."""
        x = data.astype(U64)
        for width in (1, 2, 4):
            x = x[:-width] | (x[width:] << U64(8 * width)) if len(x) > width else x[:0]
        h = x[:0]
        if len(data) >= self.gram:
            h = mix(x[:-16] * U64(0xD6E8FEB86659FD93) + mix(x[8:-8] * U64(0xA0761D6478BD642F) + mix(x[16:])))
        at = np.arange(len(data) + 1)
        return h, ends, at[:-1], at[1:]


def word_hashes(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after) of each run of `inside` bytes; `ends` closes texts."""
    cut = np.zeros(len(data) + 1, bool)  # a text ends where the next begins
    cut[ends[ends < len(data)]] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    first, after = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power = np.full(len(data) + 1, BASE, U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(0x51ED27)) * power[:-1])])
    # B**(n - first) and then B**-n (B is odd, so it has an inverse) leave the word's own polynomial
    word = (sums[after] - sums[first]) * power[len(data) - first] * U64(pow(pow(BASE, -1, 2**64), len(data), 2**64))
    return mix(word + (after - first).astype(U64)), first, after


class Words:
    """Every run of bytes other than ASCII white space is a token."""

    gram = 8

    def tokens(self, data: np.ndarray, ends: np.ndarray):
        word, first, after = word_hashes(data, ends, (data != 32) & ((data < 9) | (data > 13)))
        h = word[:0]
        if len(word) >= self.gram:
            n = len(word) - self.gram + 1
            h = np.zeros(n, U64)
            for k in range(self.gram):
                h = h * U64(0xD6E8FEB86659FD93) + word[k : k + n]
            h = mix(h)
        return h, np.searchsorted(first, ends, "left"), first, after


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive keys, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    if rest := width - span:
        keys = np.minimum(keys[:-rest], keys[rest:])
    return keys


class Batch:
    """The anchor runs of some texts: arrays of equal length, one item a run; first and
    anchor count tokens from the start of the text."""

    def __init__(self, texts: list[bytes], tokens, window: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        h, self.upto, self.begin, self.after = tokens.tokens(self.data, np.cumsum(sizes))
        self.start = np.concatenate([[0], self.upto[:-1]]).astype(np.int64)
        self.window = window
        width = window - tokens.gram + 1
        self.text = self.first = self.windows = self.anchor = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U64)
        if len(h) < width:
            return
        if len(h) >= 1 << POSITION_BITS:
            raise ValueError("a text has too many tokens")  # more than a Spark string can hold
        low = U64((1 << POSITION_BITS) - 1)
        at = (window_minimum((h & ~low) | np.arange(len(h), dtype=U64), width) & low).astype(np.int64)
        n = len(at)
        owner = np.repeat(np.arange(len(texts)), self.upto - self.start)[:n]
        whole = np.arange(n) + window <= self.upto[owner]
        cut = np.flatnonzero((at[1:] != at[:-1]) | (whole[1:] != whole[:-1])) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [n]])
        keep = whole[first]
        first, last = first[keep], last[keep]
        self.text = owner[first]
        self.hash = h[at[first]]
        self.windows = last - first
        self.anchor = at[first] - self.start[self.text]
        self.first = first - self.start[self.text]

    def cut(self, k: int) -> bytes:
        """The bytes of run k, from its first token to the end of its last window."""
        a = self.start[self.text[k]] + self.first[k]
        return self.data[self.begin[a] : self.after[a + self.windows[k] + self.window - 2]].tobytes()


def chunks(texts: list[bytes]) -> Iterator[slice]:
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > CHUNK_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += len(text)
    if total:
        yield slice(start, len(texts))


def as_bytes(column) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose items are consecutive slices of an array."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def by_part(part: np.ndarray, meta: np.ndarray, data: list[bytes] | None = None) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    part, meta = part[order], meta[order]
    names, counts = np.unique(part, return_counts=True)
    if data is None:
        packed = pa.nulls(len(names), pa.binary())
    else:
        cuts = np.concatenate([[0], np.cumsum(counts)])
        packed = pa.array([b"".join(data[i] for i in order[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), binary_rows(meta, counts), packed], schema=_part)


def by_document(rows: np.ndarray, fields: list[str]) -> pa.Table:
    """Packs `fields` of rows (which have doc and tid) into one binary a document."""
    rows = rows[np.lexsort((rows[fields[0]], rows["tid"], rows["doc"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tid"][1:] != rows["tid"][:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(rows)]]))
    packed = np.zeros(len(rows), np.dtype([(f, "<u4") for f in fields]))
    for f in fields:
        packed[f] = rows[f]
    return pa.Table.from_arrays([pa.array(rows["doc"][at]), pa.array(rows["tid"][at]), binary_rows(packed, counts)], schema=_reply)


def by_place(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ANCHOR rows by hash and place (text and position), each place once; whether a row
    is the first of its hash; how many places its hash has."""
    rows = rows[np.lexsort((rows["doc"], rows["at"], rows["tid"], rows["hash"]))]
    new = np.ones(len(rows), bool)
    new[1:] = rows["hash"][1:] != rows["hash"][:-1]
    place = new.copy()
    place[1:] |= (rows["tid"][1:] != rows["tid"][:-1]) | (rows["at"][1:] != rows["at"][:-1])
    rows, number = rows[place], np.cumsum(new)[place] - 1
    return rows, new[place], np.bincount(number)[number]


def split_strings(rows: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(rows["size"], dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def repeated_windows(texts: DataFrame, tokens, window: int, solve: Callable, parts: int, merged: bool = True) -> DataFrame:
    """(doc, tid, packed REMOVED windows: first, windows), several rows a document.

    `texts` is common.keyed_texts(). solve(fragments, strings) gets the FRAGMENT rows and
    strings of whole hash parts and returns REMOVED rows; with `merged`, only one row for
    each distinct string, the others being settled. Only the first document (by doc) of
    exact copies of a text is looked at; see copies() for the others.
    """
    firsts = texts.join(copies(texts).select("doc", "tid").hint("shuffle_hash"), ["doc", "tid"], "left_anti")

    def anchors(batches):
        for batch in batches:
            doc, tid, text = (batch.column(c) for c in ("doc", "tid", "text"))
            doc, tid, text = doc.to_numpy(), tid.to_numpy(), as_bytes(text)
            found = []
            for piece in chunks(text):
                runs = Batch(text[piece], tokens, window)
                rows = np.zeros(len(runs.hash), ANCHOR)
                rows["hash"], rows["at"] = runs.hash, runs.anchor
                rows["doc"], rows["tid"] = doc[piece][runs.text], tid[piece][runs.text]
                found.append(rows)
            if found and len(rows := np.concatenate(found)):
                rows, first, places = by_place(rows)
                several = places >= 2
                asked = rows[first | ~several]
                yield by_part((asked["hash"] % U64(parts)).astype(np.int32), asked)
                if len(known := rows[several]):
                    yield by_part((known["tid"] % parts).astype(np.int32), known, [b""] * len(known))

    def repeated(group: pa.Table) -> pa.Table:
        meta, data = group.column("meta").to_pylist(), group.column("data").to_pylist()
        known = [np.frombuffer(m, ANCHOR) for m, d in zip(meta, data) if d is not None]
        asked = [np.frombuffer(m, ANCHOR) for m, d in zip(meta, data) if d is None]
        if asked:
            rows, _, places = by_place(np.concatenate(asked))
            known.append(rows[places >= 2])
        return by_document(np.concatenate(known), ["at"])

    def fragments(batches):
        for batch in batches:
            doc, tid, text, lists = (batch.column(c) for c in ("doc", "tid", "text", "packed"))
            doc, tid, text = doc.to_numpy(), tid.to_numpy(), as_bytes(text)
            wanted = [np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in lists.to_pylist()]
            sent: dict[tuple, int] = {}
            rows, strings, settled = [], [], []
            for piece in chunks(text):
                runs = Batch(text[piece], tokens, window)
                mine = np.concatenate([(i << POSITION_BITS) | x for i, x in enumerate(wanted[piece])])
                for k in np.flatnonzero(np.isin((runs.text << POSITION_BITS) | runs.anchor, mine)):
                    at = piece.start + int(runs.text[k])
                    row = (int(runs.hash[k]), int(doc[at]), int(tid[at]), int(runs.first[k]), int(runs.windows[k]), int(runs.anchor[k] - runs.first[k]), 0)
                    string = runs.cut(k)
                    i = sent.setdefault((row[0], row[5], string), len(rows))
                    if i == len(rows):
                        rows.append(row)
                        strings.append(string)
                        continue
                    if row[1] < rows[i][1]:
                        rows[i], row = row, rows[i]
                    if row[1] > rows[i][1]:
                        settled.append(row[1:5])
                    else:  # the same document again, or another text under the same doc_id
                        rows.append(row)
                        strings.append(string)
            if rows:
                meta = np.array(rows, FRAGMENT)
                meta["size"] = [len(x) for x in strings]
                yield by_part((meta["hash"] % U64(parts)).astype(np.int32), meta, strings)
            if settled:
                meta = np.array(settled, REMOVED)
                yield by_part((meta["tid"] % parts).astype(np.int32), meta)

    def solved(group: pa.Table) -> pa.Table:
        meta, data = group.column("meta").to_pylist(), group.column("data").to_pylist()
        out = [np.frombuffer(m, REMOVED) for m, d in zip(meta, data) if d is None]
        frag = [(np.frombuffer(m, FRAGMENT), d) for m, d in zip(meta, data) if d is not None]
        if frag:
            rows, data = np.concatenate([m for m, _ in frag]), b"".join(d for _, d in frag)
            out.append(solve_distinct(rows, data, solve) if merged else solve(rows, split_strings(rows, data)))
        rows = np.concatenate(out)
        return by_document(rows, ["first", "windows"])

    flags = firsts.mapInArrow(anchors, PART_SCHEMA).groupBy("part").applyInArrow(repeated, REPLY_SCHEMA)
    flags = flags.groupBy("doc", "tid").agg(F.collect_list("packed").alias("packed"))
    flagged = texts.join(flags.hint("shuffle_hash"), ["doc", "tid"])
    return flagged.mapInArrow(fragments, PART_SCHEMA).groupBy("part").applyInArrow(solved, REPLY_SCHEMA)


def solve_distinct(rows: np.ndarray, data: bytes, solve: Callable) -> np.ndarray:
    """Settles equal fragments of different documents, then solves the distinct ones."""
    order = np.lexsort((rows["first"], rows["tid"], rows["doc"]))
    ends = np.cumsum(rows["size"], dtype=np.int64)
    seen: dict[tuple, int] = {}
    keep, strings, removed = [], [], []
    for i in order.tolist():
        row = rows[i]
        string = data[ends[i] - int(row["size"]) : ends[i]]
        if rows["doc"][seen.setdefault((int(row["hash"]), int(row["anchor"]), string), i)] < row["doc"]:
            removed.append(i)
        else:
            keep.append(i)
            strings.append(string)
    done = np.zeros(len(removed), REMOVED)
    for f in REMOVED.names:
        done[f] = rows[f][removed]
    return np.concatenate([done, solve(rows[keep], strings)])


def flagged_runs(rows: np.ndarray, flags: list[np.ndarray]) -> np.ndarray:
    """REMOVED rows from one boolean array a row (one item a window)."""
    if not len(rows):
        return np.zeros(0, REMOVED)
    flat = np.concatenate(flags).astype(np.int8)
    counts = rows["windows"].astype(np.int64)
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(rows)), counts)
    before = np.concatenate([[0], flat[:-1]]).astype(np.int8)
    before[starts] = 0
    begins = np.flatnonzero((flat == 1) & (before == 0))
    after = np.concatenate([flat[1:], [0]]).astype(np.int8)
    after[starts + counts - 1] = 0
    stops = np.flatnonzero((flat == 1) & (after == 0)) + 1
    who = owner[begins]
    out = np.zeros(len(begins), REMOVED)
    out["doc"], out["tid"] = rows["doc"][who], rows["tid"][who]
    out["first"] = rows["first"][who] + (begins - starts[who])
    out["windows"] = stops - begins
    return out


def copies(texts: DataFrame) -> DataFrame:
    """(doc, tid) of the documents that repeat the whole text of an earlier one. Texts are
    told apart by their length and 128 bits of SHA-256. Only these travel, and equal ones
    are counted before the shuffle."""
    name = [F.octet_length("text").alias("length"), F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("sha")]
    names = texts.select("doc", "tid", *name).distinct()
    firsts = names.groupBy("length", "sha").agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return names.join(firsts, ["length", "sha"]).filter("doc > first_doc").select("doc", "tid")


def with_removals(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """texts with columns packed (list of packed windows) and copied (true for a copy of an earlier text)."""
    again = copies(texts).select("doc", "tid", F.lit(None).cast("binary").alias("packed"), F.lit(True).alias("copied"))
    replies = windows.withColumn("copied", F.lit(False)).unionByName(again)
    replies = replies.groupBy("doc", "tid").agg(F.collect_list("packed").alias("packed"), F.max("copied").alias("copied"))
    return texts.join(replies.hint("shuffle_hash"), ["doc", "tid"], "left")


def covered(packed: list[bytes] | None, n_tokens: int, window: int) -> np.ndarray:
    """Boolean array: tokens covered by the removed windows."""
    change = np.zeros(n_tokens + 1, np.int64)
    if packed:
        runs = np.frombuffer(b"".join(packed), np.dtype([("first", "<u4"), ("windows", "<u4")]))
        first = runs["first"].astype(np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + runs["windows"] + window - 1, -1)
    return np.cumsum(change[:-1]) > 0
