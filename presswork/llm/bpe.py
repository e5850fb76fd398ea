"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is one token that its encoding ends with. It is
the token whose predecessor (the last token of what stands before it) forms a valid pair
with it: a pair that BPE, run on the two tokens' bytes alone, leaves as it is. A table
of these last tokens is an encoding of all prefixes at once: text is appended by adding
to the table, and an edit costs only the entries up to where the old ones hold again.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .piece_bpe import pieces_of
from .repeats import as_bytes

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Bounds of the encoder's memory (of words, twice as many are held); they change no result.
CACHED_WORDS, CACHED_PAIRS, LONGEST_CACHED, LEARN_CHARS = 1 << 17, 1 << 18, 64, 1 << 20


def utf8(piece: str) -> bytes:
    return piece.encode("utf-8", "surrogatepass")


class Vocabulary:
    """Tokens by rank, and which pairs of them are valid neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = dict(map(reversed, ranks.items()))
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token})

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition: join the neighbours of lowest rank until none can be."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand at one edge of this token while BPE builds it, smallest
        first, each with the rank of the merge that uses it up."""
        known = self.spines.get((token, right))
        if known is None:
            data, grown = self.token[token], 1 << 40
            known = [(data, grown)]
            while len(data) > 1:
                grown = self.ranks[data]
                parts = self._halves(data)
                data = parts[1] if right else parts[0]
                if len(data) > 1 and self.ranks[data] >= grown:
                    raise ValueError("a token of the vocabulary ranks before its parts")
                known.append((data, grown))
            known = self.spines[token, right] = known[::-1]
        return known

    def _halves(self, data: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge gives this one."""
        found = self.halves.get(data)
        if found is None:
            rank = self.ranks.pop(data)  # without the token itself, BPE stops one merge before
            parts = [self.token[t] for t in self.merged(data)]
            self.ranks[data] = rank
            if len(parts) != 2:
                raise ValueError("a token of the vocabulary is not the merge of two others")
            found = self.halves[data] = (parts[0], parts[1])
        return found

    def valid(self, before: int, after: int) -> bool:
        """Whether BPE leaves these two tokens side by side; before is -1 at the start.

        BPE merges in the order of ranks. Of the tokens that meet at the border at any
        time, none may have a common merge that comes before both are used up.
        """
        if before < 0:
            return True
        known = self.pairs.get((before, after))
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[before, after] = self._stay_apart(self.spine(before, True), self.spine(after, False))
        return known

    def _stay_apart(self, left, right) -> bool:
        i = j = 0
        rank_of = self.ranks.get
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            rank = rank_of(x + y)
            if rank is not None and rank < x_used and rank <= y_used:  # of equal merges the left one comes first
                return False
            if x_used == y_used == 1 << 40:
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1


class PrefixEncoding:
    """The encoding of every prefix of a byte string (one piece of the split pattern)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []  # last token of data[:i + 1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._fill(len(self.data))

    def rewind(self, size: int) -> None:
        """Keeps the first `size` bytes; their entries are right as they are."""
        self.data = self.data[:size]
        del self.last[size:]

    def _fill(self, stop: int) -> None:
        """Adds the last tokens of the prefixes up to data[:stop]."""
        v, data, last = self.vocabulary, self.data, self.last
        rank_of, pair, longest = v.ranks.get, v.pairs.get, v.longest
        for end in range(len(last) + 1, stop + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = rank_of(data[start:end])
                if token is not None:
                    if not start:
                        break
                    before = last[start - 1]
                    fits = pair((before, token))
                    if fits or fits is None and v.valid(before, token):
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """data[start:stop] = new. Returns the number of entries computed: entries before
        the edit stay, and so do those after a stretch, as long as the longest token, in
        which new and old entries agree."""
        old, shift = self.last, start + len(new) - stop
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        agreed = 0
        while len(self.last) < len(self.data):
            end = len(self.last) + 1
            self._fill(end)
            token = self.last[-1]
            agreed = agreed + 1 if end - 1 >= start + len(new) and old[end - 1 - shift] == token else 0
            if agreed >= self.vocabulary.longest:
                self.last += old[end - shift :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocabulary.token[token])
        return out[::-1]


class Encoder(dict):
    """Text to packed little-endian 32-bit ids. As a dict it holds the ids of the pieces
    met lately; `older` holds those of the time before. When the dict is full it becomes
    the older one, so that pieces in use stay, in bounded number."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}
        self.split = regex.compile(pattern).findall
        self.tokens = [vocabulary.token.get(i, b"") for i in range(max(vocabulary.token) + 1)]
        self.column = pa.array(self.tokens, pa.large_binary())

    def _make_room(self, more: int) -> None:
        if len(self) + more > CACHED_WORDS:
            self.older = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._packed(PrefixEncoding(self.vocabulary, utf8(piece)))
        if len(piece) <= LONGEST_CACHED:
            self._make_room(1)
            self[piece] = ids
        return ids

    @staticmethod
    def _packed(table: PrefixEncoding) -> bytes:
        ids = table.ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces in sorted order, each from where it parts from the one before."""
        missing = {p for p in pieces.difference(self) if len(p) <= LONGEST_CACHED}
        self._make_room(len(missing))
        known = missing.intersection(self.older)
        self.update((p, self.older[p]) for p in known)
        new = sorted(map(utf8, missing - known))
        table, before = PrefixEncoding(self.vocabulary), b""
        for piece in new:
            shared = 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                shared += 1
            table.rewind(shared)
            table.append(piece[shared:])
            self[piece.decode("utf-8", "surrogatepass")] = self._packed(table)
            before = piece

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode() of each text; null has no tokens."""
        out, start, size = [], 0, 0
        for stop, text in enumerate(texts, 1):
            size += len(text) if text else 0
            if size >= LEARN_CHARS or stop == len(texts):
                split = [self.split(t) if t else [] for t in texts[start:stop]]
                self.learn(set().union(*split))
                out += [b"".join(map(self.__getitem__, pieces)) for pieces in split]
                start, size = stop, 0
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """decode() of each row, null as empty. The bytes of all tokens are laid side by
        side, and a row's are what lies between two ends."""
        rows = [x or b"" for x in as_bytes(ids)]
        if any(len(x) % 4 for x in rows):
            raise ValueError("ids are 32 bits each")
        ends = np.cumsum([0, *map(len, rows)]) // 4
        if not ends[-1]:
            return pa.array(rows, pa.binary())
        laid = self.column.take(pa.array(np.frombuffer(b"".join(rows), "<u4")))
        cuts = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset :][ends]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cuts), laid.buffers()[2]]).cast(pa.binary())


@lru_cache(maxsize=4)
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One for each process; by default the rank file and pattern of public_tokenizers."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN
    return Encoder(Vocabulary.load(path), pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_text: bool = True, with_bytes: bool = False) -> DataFrame:
    """docs (with_text=False: without their text) with a column `ids`: the text's token
    ids as little-endian unsigned 32-bit integers. Null and empty texts have none (an
    empty binary). Each match of the pattern is encoded by itself; there are no special
    tokens. with_bytes: also a column `decoded`, as decode() makes it of the ids, without
    sending them to a second set of workers. Other columns stay, and those named like a
    new one are replaced. Rows are encoded one by one and whole, so repeated rows have the
    same ids and no rows give none."""
    common.ship(docs.sparkSession)
    made = ["ids", "decoded"] if with_bytes else ["ids"]
    rest = [c for c in docs.columns if c not in made]
    kept = [c for c in rest if with_text or c != "text"]
    schema = docs.select(*kept).withColumns({c: F.lit(b"") for c in made}).schema
    return docs.select(*rest).mapInArrow(lambda batches: coded(batches, encoder(path, pattern), kept, with_bytes), schema)


def coded(batches, coder: Encoder, kept: list[str], with_bytes: bool = False):
    """The kept columns with ids and, if asked for, decoded. Batches are cut by their texts'
    size, so that a worker holds no more than a small one besides what it was sent."""
    for whole in batches:
        for batch in pieces_of([whole], whole.schema.get_field_index("text")):
            ids = pa.array(coder.encode_all(batch.column("text").to_pylist()), pa.binary())
            made = {"ids": ids} | ({"decoded": coder.decode_all(ids)} if with_bytes else {})
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *made.values()], [*kept, *made])


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens with a column `decoded`: the bytes of the tokens in `ids` (null or empty:
    none). Other columns stay, and one named `decoded` is replaced."""
    common.ship(tokens.sparkSession)
    rest = [c for c in tokens.columns if c != "decoded"]
    schema = tokens.select(*rest).withColumn("decoded", F.lit(b"")).schema

    def run(batches):
        coder = encoder(path)
        for whole in batches:
            step = max(1, len(whole) * LEARN_CHARS // max(1, whole.column("ids").nbytes))
            for batch in (whole.slice(at, step) for at in range(0, len(whole), step)):
                yield pa.RecordBatch.from_arrays([*batch.columns, coder.decode_all(batch.column("ids"))], [*batch.schema.names, "decoded"])

    return tokens.select(*rest).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return encode(docs.select("doc_id", text), path, pattern, with_text=False, with_bytes=True).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
