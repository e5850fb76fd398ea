"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the set of a text's words (64-bit hashes). Confirmed toxic texts
are the positives; the unlabelled texts are drawn from all documents of the training fold,
labelled or not, and labels are not looked at. With the class prior p, the risk is p R+(positive) + max(0, R-(unlabelled) - p R-(positive)):
the negative part is corrected for the positives hidden among the unlabelled texts, and
where the correction goes below zero the step goes back on it instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .repeats import U64, as_bytes, chunks, word_hashes

#: The training sample by default: at most so many positives and unlabelled texts, the first by hash of doc_id.
MOST_POSITIVE, MOST_UNLABELLED = 4096, 12288
#: Words carry weight if at least so many positives have them, and more of the positives
#: than of the unlabelled texts by so many standard errors: with some hundred thousand
#: words and few positives, others would be learned by heart.
LEAST_TEXTS, LEAST_ERRORS = 4, 8.0

_letters = np.zeros(256, bool)
_letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct words of each text, in order of text and hash:
    runs of ASCII letters and digits and of other than ASCII characters."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    h, first, _ = word_hashes(data, ends, _letters[data])
    owner = np.searchsorted(ends, first, "right")
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, words: packed word hashes) of every row."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            text = as_bytes(pc.utf8_lower(batch.column("text")))
            out = [b""] * len(text)
            for piece in chunks(text):
                word, owner = word_sets(text[piece])
                cuts = np.searchsorted(owner, np.arange(piece.stop - piece.start + 1))
                for i in range(piece.stop - piece.start):
                    out[piece.start + i] = word[cuts[i] : cuts[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "words"])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, words binary")


class Texts:
    """Sparse 0/1 rows for the trainer, from packed words; they are read in pieces."""

    def __init__(self, rows: list[bytes]):
        self.rows, self.n = rows, len(rows)

    def pieces(self, size: int = 512):
        for i in range(0, self.n, size):
            part = self.rows[i : i + size]
            yield np.frombuffer(b"".join(part), U64), np.repeat(np.arange(i, i + len(part)), [len(r) // 8 for r in part])

    def counts(self, known: np.ndarray) -> np.ndarray:
        """How many texts have each of the words in the sorted `known`."""
        total = np.zeros(len(known), np.int64)
        for words, _ in self.pieces():
            at, has = places(words, known)
            total += np.bincount(at[has], minlength=len(known))
        return total

    def number(self, known: np.ndarray) -> None:
        """Keeps the words in `known`, by their places there."""
        found = [(at[has], owner[has]) for words, owner in self.pieces() for at, has in [places(words, known)]]
        self.words, self.owner = (np.concatenate(x) for x in zip(*found))

    def margin(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.owner, w[self.words], self.n) + b

    def pull(self, slope: np.ndarray, n_words: int) -> np.ndarray:
        return np.bincount(self.words, slope[self.owner], n_words)


def places(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word in the sorted `known` (not empty), and whether it is there."""
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return at, known[at] == words


NO_MODEL = (np.zeros(1, U64), np.zeros(1), -np.inf)


def train(positive: list[bytes], unlabelled: list[bytes], prior: float, steps: int = 300, rate: float = 0.1, shrink: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes in order, their weights, bias) by full-batch Adam on the non-negative risk of the logistic loss,
    with decay of the weights. Deterministic."""
    if not positive or not unlabelled:
        return NO_MODEL
    p, u = Texts(positive), Texts(unlabelled)
    words, in_p = np.unique(np.concatenate([w for w, _ in p.pieces()]), return_counts=True)
    if not len(words):
        return NO_MODEL
    in_u = u.counts(words)
    expected = (in_u + 1) * (p.n / u.n)
    known = words[(in_p >= LEAST_TEXTS) & (in_p - expected >= LEAST_ERRORS * np.sqrt(expected))]
    if not len(known):
        known = words[np.argmax(in_p - expected)][None]
    p.number(known), u.number(known)
    w, b = np.zeros(len(known)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        fp, fu = p.margin(w, b), u.margin(w, b)
        np_, nu = len(fp), len(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        slope_u, slope_p = sigmoid(fu) / nu, -prior * sigmoid(fp) / np_
        if negative < 0:  # more was taken off than there is: undo
            slope_u, slope_p = -slope_u, -slope_p
        else:
            slope_p = slope_p - prior * sigmoid(-fp) / np_
        g = np.append(p.pull(slope_p, len(w)) + u.pull(slope_u, len(w)), slope_p.sum() + slope_u.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-5)
        w = (w - step[:-1]) * (1 - rate * shrink)
        b -= step[-1]
    return known, w, float(b)


def in_training_fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5, is not 0. A null doc_id is not in the fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from the training fold: the texts that labels call toxic, and documents of any kind.

    prior: the share of toxic documents; by default that among the fold's labels. Of
    several rows of one doc_id the text with the smallest name is taken; of several
    labels the largest; null ids and labels teach nothing. Without positives there is no
    model. The driver holds at most most_positive + most_unlabelled texts' words.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(in_training_fold(F.col("doc_id")))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("cast(toxic = 1 as int)")).alias("positive")).first()
    if not counts["n"] or not counts["positive"]:
        return NO_MODEL
    prior = counts["positive"] / counts["n"] if prior is None else prior
    by_hash = lambda df, salt, most: df.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)
    anyone = docs.filter(in_training_fold(F.col("doc_id")))
    chosen = by_hash(known.filter("toxic = 1"), 1, most_positive).withColumn("set", F.lit(1)).unionByName(by_hash(anyone, 2, most_unlabelled).withColumn("set", F.lit(0)))
    # bounded: at most most_positive + most_unlabelled ids and texts
    ids = chosen.groupBy("doc_id").agg(F.max(F.expr("set = 1")).alias("p"), F.max(F.expr("set = 0")).alias("u"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = features(one).join(F.broadcast(ids), "doc_id").toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["words"] for r in rows if r["p"]], [r["words"] for r in rows if r["u"]], prior)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with columns score (0 to 1; 0 without a model) and predicted (1 from 0.5 on),
    or with other names; columns of these names are replaced, others stay. A null text
    scores as an empty one. Each row is scored by itself and whole, so repeated rows have
    one score; no rows give none."""
    common.ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in names]
    schema = docs.select(*rest).withColumn(names[0], F.lit(0.0)).withColumn(names[1], F.lit(0)).schema
    known, weights, bias = model

    def run(batches):
        for batch in batches:
            text = [t or b"" for t in as_bytes(pc.utf8_lower(batch.column("text").cast(pa.string())))]
            margin = np.full(len(text), bias)
            for piece in chunks(text):
                word, owner = word_sets(text[piece])
                at, has = places(word, known)
                margin[piece] += np.bincount(owner[has], weights[at[has]], piece.stop - piece.start)
            value = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            value[np.isneginf(margin)] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*batch.schema.names, *names])

    return docs.select(*rest).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. A null doc_id is held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (~in_training_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")
