"""SentencePiece's merge encoding without merging: longest matches, and steps back.

BPE with scores joins, again and again, the neighbours whose union has the best score, the
leftmost first among equals. A row of pieces is its result if and only if every two
neighbours of it are the result of their own two texts, and there is exactly one such row
for every text, and for every beginning of it. So an encoder can take the longest piece
that stands at a place and fits the one before, try shorter ones, and step back where none
does. It never comes twice to a place from which there was no way on: those are marked
in a bitfield, so the steps grow with the text's length.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from . import common

MODEL_FILE = "piece_bpe_32k.model"
#: Stands for a space in pieces.
SPACE = "▁"
#: Bounds of the encoder's memory (of words, twice as many are held); they change no result.
CACHED_WORDS, CACHED_PAIRS, LONGEST_CACHED = 1 << 17, 1 << 17, 64
#: Characters of the texts whose ids go back to Spark together.
SENT_CHARS = 1 << 21
#: Places of a long word that are looked at together.
WINDOW = 4096
#: Fixed values of the model file's format: kinds of pieces, and of models.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: What an unknown piece reads as.
UNKNOWN_TEXT = " ⁇ "

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(data: bytes):
    """(number, value) of a protocol-buffer message: integers, 32-bit floats and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value = struct.unpack("<d" if kind == 1 else "<f", data[at : at + size])[0]
            at += size
        elif kind == 2:
            size = varint()
            value = data[at : at + size]
            at += size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(pieces with score and kind, whether texts get a space at the front) of a model file.
    Models that change texts in other ways before they are split are refused."""
    pieces, kind, prefix = [], BPE, True
    with open(path, "rb") as file:
        for number, value in fields(file.read()):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
            elif number == 3:
                rules = dict(fields(value))
                prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model normalises texts")
    if kind != BPE:
        raise ValueError("not a model of merges")
    return pieces, prefix


class Model:
    """The pieces of a model file, and which of them are valid neighbours."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        self.pieces, self.dummy_prefix = pieces, dummy_prefix
        if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {piece: pieces[i][1] for piece, i in self.ids.items()}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
        self.bytes = {int(p[0][1:-1], 16): i for i, p in enumerate(pieces) if p[2] == BYTE}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.fits: dict[tuple[str, str], str | None] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.spines: dict[tuple[str, bool], list[tuple[str, float]] | None] = {}
        # a piece that merging doesn't make of its own text never comes up
        found = sorted(p for p in self.ids if len(p) == 1 or self.merged(p) == [p])
        self.automaton = ahocorasick.Automaton()
        for piece in found:
            if len(piece) > 1:
                self.automaton.add_word(piece[::-1], piece)
        if len(self.automaton):
            self.automaton.make_automaton()
        known = set(found)
        #: The next shorter choice at a place; a character can always stand alone.
        self.shorter = {p: next(p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in known) for p in found if len(p) > 1}
        self.most = max(map(len, found), default=0)
        longer = [p for p in self.ids if len(p) > 1]
        #: Whether no merge reaches from another character to a space.
        self.spaces_part = not any(a != SPACE and b == SPACE for p in longer for a, b in zip(p, p[1:]))
        self.cut = self._cutter(longer)

    @classmethod
    def load(cls, path: str) -> Model:
        return cls(*read_model(path))

    def merged(self, text: str) -> list[str]:
        """Merging by its definition."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max((score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == -np.inf:
                break
            if len(parts) == 2:
                self.halves[text] = parts[0], parts[1]
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def compatible(self, before: str, after: str) -> bool:
        """Whether merging the two pieces' text gives the two pieces again."""
        known = self.pairs.get((before, after))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            left, right = self.spine(before, True), self.spine(after, False)
            if left is None or right is None:
                known = self.merged(before + after) == [before, after]
            else:
                known = self._stay_apart(left, right)
            self.pairs[before, after] = known
        return known

    def first_fit(self, before: str, piece: str) -> str | None:
        """The piece, or the longest shorter choice, that is compatible with the one before."""
        key = before, piece
        while piece is not None and not self.compatible(before, piece):
            piece = self.shorter.get(piece)
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[key] = piece
        return piece

    def spine(self, piece: str, right: bool) -> list[tuple[str, float]] | None:
        """What stands at one edge of the piece while it is merged, smallest first, each with
        the score of the merge that uses it up. None if these scores don't fall: then time
        doesn't follow them, as with runs of spaces, whose scores are equal."""
        if (piece, right) in self.spines:
            return self.spines[piece, right]
        out, used, inner = [], -np.inf, [piece]
        while inner:  # all merges within, not the edge's alone
            part = inner.pop()
            if len(part) > 1:
                inner += self.halves[part]
                if any(len(h) > 1 and self.score[h] <= self.score[part] for h in self.halves[part]):
                    self.spines[piece, right] = None
                    return None
        part = piece
        while True:
            out.append((part, used))
            if len(part) == 1:
                break
            used = self.score[part]
            part = self.halves[part][1 if right else 0]
        self.spines[piece, right] = out[::-1]
        return self.spines[piece, right]

    def _stay_apart(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        """Merges again what happens at the border: of the parts that meet there at any time,
        none may have a common merge that comes before both are used up."""
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = left[i], right[j]
            score = self.score.get(x + y)
            if score is not None and score > x_used and score >= y_used:  # of equal merges the left one comes first
                return False
            if x_used == y_used == -np.inf:
                return True
            if x_used >= y_used:
                i += 1
            else:
                j += 1

    def _cutter(self, longer: list[str]):
        """Cuts a text where no merge can reach across: before spaces and between letters
        and others, if no piece goes across there, and around characters that stand in no
        longer piece."""
        joined = sorted(set("".join(longer)) - {SPACE})
        kinds = [[c for c in joined if c.isalpha()], [c for c in joined if not c.isalpha()]]
        self.letters_part = not any(a.isalpha() != b.isalpha() and SPACE not in (a, b) for p in longer for a, b in zip(p, p[1:]))
        if not self.letters_part:
            kinds = [joined]
        classes = ["".join(map(re.escape, kind)) for kind in kinds if kind]
        alone = f"[^{SPACE}{''.join(classes)}]"
        if not self.spaces_part:
            return re.compile(f"[{SPACE}{''.join(classes)}]+|{alone}", re.DOTALL).findall
        return re.compile("|".join([*(f"{SPACE}*[{c}]+" for c in classes), f"{SPACE}+", alone]), re.DOTALL).findall

    def longest(self, word: str, start: int) -> dict[int, str]:
        """The longest piece of two characters or more at the places of a window, by the
        distance from the window's end. One pass of the automaton over the reversed text meets
        all pieces that begin at a place together, longest first."""
        if not len(self.automaton):
            return {}
        return dict(list(self.automaton.iter(word[start : start + WINDOW + self.most][::-1]))[::-1])

    def split(self, word: str) -> list[str]:
        """The pieces of a word, characters without a piece among them."""
        out: list[str] = []
        at, size, shorter, known = 0, len(word), self.shorter.get, self.fits.get
        failed = bytearray((size >> 3) + 1)
        window, found = 0, self.longest(word, 0)
        last = min(size, WINDOW + self.most) - 1
        piece = found.get(last) or word[:1]
        while at < size:
            before = out[-1] if out else None
            while piece is not None:
                if before is not None:
                    fit = known((before, piece), "")
                    piece = self.first_fit(before, piece) if fit == "" else fit
                    if piece is None:
                        break
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    break
                piece = shorter(piece)
            if piece is not None:
                out.append(piece)
                at = end
                if at < size:
                    if not window <= at < window + WINDOW:
                        window, found = at, self.longest(word, at)
                        last = min(size, at + WINDOW + self.most) - 1
                    piece = found.get(last - at) or word[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = shorter(piece)
        return out

    def packed(self, piece: str) -> bytes:
        """The ids of a piece, or of a character without one."""
        i = self.ids.get(piece)
        if i is not None:
            ids = [i]
        elif self.bytes:
            ids = [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        else:
            ids = [self.unknown]
        return struct.pack(f"<{len(ids)}I", *ids)


class Cache(dict):
    """Packed ids by string. When it is full it becomes the older one, so that strings in
    use stay, in bounded number."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class SpacedWords(Cache):
    """Words that follow a single space. A sign after a word is looked up by itself, if no
    piece joins letters and others."""

    def __init__(self, encoder: Encoder):
        super().__init__(lambda word: encoder.packed(SPACE + word) if word.isalpha() else encoder.joined(SPACE + word))
        self.signs, self.parted = encoder.cuts, encoder.model.letters_part

    def __missing__(self, word: str) -> bytes:
        if self.parted and (stem := word[:-1]).isalpha() and not word[-1].isalpha():
            return self[stem] + self.signs[word[-1]]
        return super().__missing__(word)


class Encoder:
    """Text to packed little-endian 32-bit ids."""

    def __init__(self, model: Model):
        self.model = model
        self.pieces = Cache(model.packed)
        self.cuts = Cache(self.packed)
        self.spaced = SpacedWords(self)

    def packed(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.model.split(word)))

    def joined(self, escaped: str) -> bytes:
        return b"".join(map(self.cuts.__getitem__, self.model.cut(escaped)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        escaped = text.replace(" ", SPACE)
        if self.model.spaces_part and self.model.dummy_prefix and escaped[0] != SPACE and escaped[-1] != SPACE and SPACE * 2 not in escaped:
            return b"".join(map(self.spaced.__getitem__, escaped.split(SPACE)))
        return self.joined(SPACE + escaped if self.model.dummy_prefix else escaped)


class Decoder:
    """Ids to text. Controls are nothing; of spaces at the front, the one that encoding
    puts there goes; bytes that are no UTF-8 become U+FFFD each."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        plain = lambda piece: piece.replace(SPACE, " ").encode()
        by_kind = {BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_TEXT.encode()}
        self.texts = [by_kind.get(kind, plain)(piece) for piece, _, kind in pieces]
        self.kinds = np.array([kind for _, _, kind in pieces])
        self.controls = {i for i, p in enumerate(pieces) if p[2] == CONTROL}
        self.dummy_prefix = dummy_prefix
        self.column = pa.array(self.texts, pa.large_binary())

    def decode(self, ids: list[int]) -> str:
        if ids and not 0 <= min(ids) <= max(ids) < len(self.texts):
            raise ValueError("an id beyond the model's pieces")
        text = "".join(b"".join(map(self.texts.__getitem__, run)).decode("utf-8", "each-byte") for run in self._runs(ids))
        first = next((x for x in ids if x not in self.controls), None)
        drop = self.dummy_prefix and text.startswith(" ") and self.kinds[first] == NORMAL
        return text[1:] if drop else text

    def decode_all(self, ids: pa.ListArray) -> list[str]:
        """decode() of each row, null as empty. The texts of all ids are laid side by side,
        so that a row's text is cut from them; rows with controls, or whose bytes are no
        UTF-8, are decoded by themselves."""
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        flat = ids.flatten()
        numbers = flat.to_numpy()
        if len(numbers) and not 0 <= numbers.min() <= numbers.max() < len(self.texts):
            raise ValueError("an id beyond the model's pieces")
        laid = self.column.take(flat)
        offsets = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset :] if len(numbers) else np.zeros(1, np.int64)
        data = memoryview(laid.buffers()[2] or b"") if len(numbers) else memoryview(b"")
        kinds = self.kinds[numbers]
        odd = np.concatenate([[0], np.cumsum(kinds == CONTROL)])
        out = []
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            if odd[a] == odd[b]:
                raw = bytes(data[offsets[a] : offsets[b]])
                if self.dummy_prefix and raw[:1] == b" " and kinds[a] == NORMAL:
                    raw = raw[1:]
                try:
                    out.append(raw.decode())
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.decode(numbers[a:b].tolist()))
        return out

    def _runs(self, ids: list[int]) -> list[list[int]]:
        """Cut at controls, which end a run of bytes."""
        if self.controls.isdisjoint(ids):
            return [ids]
        cuts = [-1, *(i for i, x in enumerate(ids) if x in self.controls), len(ids)]
        return [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:])]


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL_FILE)
    return path


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Encoder:
    """One for each process; by default of the model of public_tokenizers."""
    return Encoder(Model.load(_path(path)))


@lru_cache(maxsize=4)
def decoder(path: str | None = None) -> Decoder:
    return Decoder(*read_model(_path(path)))


def pieces_of(batches, column: int = 0):
    """The batches, cut where the texts of the column pass SENT_CHARS."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // SENT_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str | None = None, with_text: bool = True) -> DataFrame:
    """docs (with_text=False: without their text) with a column `ids`, array<int>: the text's piece ids, without begin or end.
    Null and empty texts have none (an empty array). Rows are encoded one by one and whole,
    so repeated rows have the same ids and no rows give none. Other columns stay, and one
    named `ids` is replaced. path: a model file that all executors have."""
    common.ship(docs.sparkSession)

    def added(text: pa.Array) -> pa.Array:
        packed = [encoder(path).encode(t) if t else b"" for t in text.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    return _with(docs, "text", "ids", ArrayType(IntegerType()), added, pieces_of, with_text)


def _with(df: DataFrame, given: str, name: str, kind: DataType, make: Callable[[pa.Array], pa.Array], cut: Callable = lambda batches, _: batches, with_given: bool = True) -> DataFrame:
    """df with the column `name` made of `given`, in place of one of that name. Columns go
    to Python by their numbers, so they may have any names."""
    dropped = {name} if with_given else {name, given}
    rest = [c for c in df.columns if c.lower() not in dropped]
    source = next(i for i, c in enumerate(df.columns) if c.lower() == given)
    numbered = df.toDF(*map(str, range(len(df.columns))))
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in dropped]
    schema = StructType([*(numbered.schema[i] for i in keep), StructField("made", kind)])

    def run(batches):
        for batch in cut(batches, source):
            columns = [*(batch.column(i) for i in keep), make(batch.column(source))]
            yield pa.RecordBatch.from_arrays(columns, [*map(str, keep), "made"])

    return numbered.mapInArrow(run, schema).toDF(*rest, name)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens with a column `decoded`: the text of `ids` (null or empty: empty). An id that
    the model lacks is an error. Other columns stay, and one named `decoded` is replaced."""
    common.ship(tokens.sparkSession)
    def texts(ids: pa.ListArray) -> pa.Array:
        step = max(1, len(ids) * SENT_CHARS // max(1, len(ids.values)))
        return pa.array([t for at in range(0, len(ids), step) for t in decoder(path).decode_all(ids.slice(at, step))], pa.string())

    return _with(tokens, "ids", "decoded", StringType(), texts)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    both = decode(encode(docs.select("doc_id", text), path, with_text=False), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
