"""Which sources of a language use its words differently, and which words do it.

Terms become integers: a sorted array of kept terms is a dictionary whose ids, the places
in it, keep the order of the terms. The dictionary is far larger than one task's memory, so
it is cut into chunks of neighbouring terms. A chunk has the counts of its terms in every
group, as dense vectors, and that is all that a task needs to compare groups: sums over the
chunks give whole divergences, and of equal values the smaller id is the smaller term.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts_for, small
from .repeats import as_bytes

#: Bytes of a term, A-Z lower-cased; all else of ASCII parts terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What one task holds at most: counted terms, terms of a chunk, rows of a chunk, sources compared at once.
COUNTED, CHUNK_TERMS, CHUNK_ROWS, BLOCK = 1 << 20, 4096, 1 << 17, 256
#: Sums under this are exact in 64 bits through all steps of scaled().
EXACT_TOTAL = 1 << 52

COUNTS = "lang string, source string, term string, docs bigint, n bigint"
CHUNKS = "lang string, terms array<string>, sources array<string>, sums array<bigint>, source array<int>, id array<int>, n array<bigint>"
FOUND = "lang string, source string, part string, item string, value bigint"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of ASCII letters and other characters
    beyond ASCII."""
    return text.translate(LETTERS).split()


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents and occurrences of every term in every
    group. Each task counts first; what it holds is bounded, not what it counts."""

    def run(batches):
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for name, text in zip(names, as_bytes(batch.column("text"))):
                if (pair := counts.get(name)) is None:
                    pair = counts[name] = Counter(), Counter()
                held -= len(pair[0])
                words = terms_of(text)
                pair[0].update(words)
                pair[1].update(set(words))
                held += len(pair[0])
                if held > COUNTED:
                    yield from _counted(counts)
                    counts, held = {}, 0
        yield from _counted(counts)

    merged = _groups(docs).mapInArrow(run, COUNTS).groupBy("lang", "source", "term")
    return merged.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _counted(counts: dict[tuple, tuple[Counter, Counter]]):
    for (lang, source), (n, docs) in counts.items():
        if n:
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            same = [pa.repeat(pa.scalar(x), len(n)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(list(map(docs.__getitem__, n)), pa.int64()), pa.array(list(n.values()), pa.int64())], ["lang", "source", "term", "docs", "n"])


def encode(counts: DataFrame, least_docs: int = 10) -> DataFrame:
    """The dictionary with the counts, a row a chunk: neighbouring kept terms of a language
    in order, and (source, id, n) of the chunk's groups; `source` is a place in `sources`,
    `id` one in `terms`. All rows of a term meet in one task, one a group, so a term's
    documents are summed there too."""
    dealt = counts.repartitionByRange(parts_for(counts), "lang", "term").sortWithinPartitions("lang", "term")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while len(rest) >= CHUNK_ROWS:
                end = _last_border(rest)
                if not end:
                    break  # one term's groups alone
                yield from _chunks(rest.slice(0, end), least_docs)
                rest = rest.slice(end)
        if rest is not None and len(rest):
            yield from _chunks(rest, least_docs)

    return dealt.mapInArrow(run, CHUNKS)


def _starts(table: pa.Table) -> np.ndarray:
    """Where a new (lang, term) starts."""
    new = np.ones(len(table), bool)
    if len(table) > 1:
        lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
        new[1:] = np.logical_or(*[pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (lang, term)])
    return np.flatnonzero(new)


def _last_border(table: pa.Table) -> int:
    return int(_starts(table)[-1])


def _chunks(table: pa.Table, least_docs: int):
    """Chunks of rows that are sorted by language and term."""
    starts = _starts(table)
    kept = starts[np.add.reduceat(table.column("docs").to_numpy(), starts) >= least_docs]
    langs = table.column("lang").combine_chunks()
    firsts = langs.take(pa.array(kept)).to_pylist()
    at = 0
    while at < len(kept):
        stop = at + 1
        while stop < len(kept) and stop - at < CHUNK_TERMS and firsts[stop] == firsts[at]:
            stop += 1
        begin = int(kept[at])
        after = starts[np.searchsorted(starts, kept[stop - 1]) + 1 :]
        rows = table.slice(begin, (int(after[0]) if len(after) else len(table)) - begin)
        yield _chunk(firsts[at], table.column("term").combine_chunks().take(pa.array(kept[at:stop])), rows)
        at = stop


def _chunk(lang: str, terms: pa.Array, rows: pa.Table) -> pa.RecordBatch:
    dictionary = np.array(as_bytes(terms) + [None], object)[:-1]
    words = np.array(as_bytes(rows.column("term")) + [None], object)[:-1]
    ids = np.searchsorted(dictionary, words)
    known = dictionary[np.minimum(ids, len(dictionary) - 1)] == words
    ids, n = ids[known], rows.column("n").to_numpy()[known]
    coded = rows.column("source").combine_chunks().dictionary_encode()
    places = coded.indices.to_numpy()[known]
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, places, n)
    lists = [terms.to_pylist(), coded.dictionary.to_pylist(), sums, places.astype(np.int32), ids.astype(np.int32), n]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(lists, kinds)]
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *columns], ["lang", "terms", "sources", "sums", "source", "id", "n"])


def scaled(count: np.ndarray, total, size: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 size)), exact: long division, three digits a
    step, in 64 bits where they suffice and in Python's integers beyond."""
    below = np.asarray(total) + 2 * size
    rest = count + 2
    if np.max(below, initial=0) >= EXACT_TOTAL:
        below, rest = below.astype(object), rest.astype(object)
    share, rest = rest // below, rest % below
    for _ in range(3):
        rest = rest * 1000
        share, rest = share * 1000 + rest // below, rest % below
    return (share + 1).astype(np.int64)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    away = p - q
    return away * away // (p + q)  # at most 10^18 before the division


def source_blocks(groups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(lang, block, sources, totals, lang_total, size): the groups of each language, at
    most BLOCK a row, with their counts of kept terms, and the language's."""
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("total"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("size"))
    whole = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    named = groups.join(sums, ["lang", "source"], "left").withColumn("block", ((order - 1) / BLOCK).cast("int"))
    lists = named.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("s"))
    return lists.join(sizes, "lang").join(whole, "lang").select("lang", "block", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), "lang_total", "size")


def compare(chunks: DataFrame, blocks: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value): partial sums of the divergences of pairs, and of
    each chunk the `top` terms of each group."""
    blocks = small(blocks)
    left = blocks.toDF("lang", "left_block", "left", "left_totals", "lang_total", "size")
    right = blocks.select("lang", "block", "sources", "totals").toDF("lang", "right_block", "right", "right_totals")
    met = chunks.drop("sums").join(left, "lang").join(right, "lang").filter("left_block <= right_block")

    def run(batches):
        sums: dict[tuple, tuple] = {}
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("id", "n", "source")}
                ids, n, places = (batch.column(c)[k].values.to_numpy() for c in ("id", "n", "source"))
                width = len(row["terms"])

                def dense(sources):
                    at = {s: i for i, s in enumerate(sources)}
                    to = np.array([at.get(s, -1) for s in row["sources"]], np.int64)[places]  # of each count
                    out = np.zeros((len(sources), width), np.int64)
                    np.add.at(out, (to[to >= 0], ids[to >= 0]), n[to >= 0])
                    return out

                mine = dense(row["left"])
                p = scaled(mine, np.array(row["left_totals"], np.int64)[:, None], row["size"])
                same = row["left_block"] == row["right_block"]
                other = p if same else scaled(dense(row["right"]), np.array(row["right_totals"], np.int64)[:, None], row["size"])
                key = row["lang"], row["left_block"], row["right_block"]
                if key not in sums:
                    if len(sums) >= 64:
                        yield from _pairs(sums)
                        sums = {}
                    sums[key] = row["left"], row["right"], np.zeros((len(p), len(other)), np.int64)
                total = sums[key][2]
                for i in range(len(p)):
                    start = i + 1 if same else 0
                    total[i, start:] += _divergence(p[i], other[start:]).sum(axis=1)
                if same:
                    yield _top_terms(row, mine, p, ids, n, top)
        yield from _pairs(sums)

    return met.mapInArrow(run, FOUND)


def _rows(lang: str, part: str, sources: list, items: list, values) -> pa.RecordBatch:
    same = [pa.repeat(pa.scalar(x), len(sources)) for x in (lang, part)]
    return pa.RecordBatch.from_arrays([same[0], pa.array(sources, pa.string()), same[1], pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def _pairs(sums: dict):
    for (lang, a, b), (left, right, total) in sums.items():
        i, j = np.triu_indices(len(left), 1, len(right)) if a == b else np.indices(total.shape).reshape(2, -1)
        one, two, values = [left[x] for x in i], [right[x] for x in j], total[i, j]
        yield _rows(lang, "pair", one + two, two + one, np.concatenate([values, values]))


def _top_terms(row: dict, counts: np.ndarray, p: np.ndarray, ids: np.ndarray, n: np.ndarray, top: int) -> pa.RecordBatch:
    everywhere = np.zeros(len(row["terms"]), np.int64)
    np.add.at(everywhere, ids, n)
    q = scaled(everywhere, row["lang_total"], row["size"])
    sources, items, values = [], [], []
    for i, source in enumerate(row["left"]):
        above = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        value = _divergence(p[i][above], q[above])
        best = np.lexsort((above, -value))[:top]  # ids are in the order of the terms
        sources += [source] * len(best)
        items += [row["terms"][k] for k in above[best]]
        values += value[best].tolist()
    return _rows(row["lang"], "term", sources, items, values)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for every group (lang, source), part `pair`
    has the divergence from each other source of the language, part `term` the `top` terms
    that the group uses more than the language does.

    docs: lang, source, text; other columns don't matter. A null is an empty string, in
    each of the three. Texts are read whole. A group without terms, and a language in
    which no term has `least_docs` documents, have pairs too (in the latter of value 0);
    a source alone in its language has none. Repeated rows count as often as they stand
    there. Of equal values the smaller item in UTF-8 order comes first. No rows give none.
    """
    from ..shipping import ship

    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    chunks = scratch.save(encode(term_counts(docs), least_docs))
    groups = scratch.save(_groups(docs).select("lang", "source").distinct())
    blocks = scratch.save(source_blocks(groups, chunks))
    found = scratch.save(compare(chunks, blocks, top))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.unionByName(found.filter("part = 'term'")).withColumn("rank", rank)
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
