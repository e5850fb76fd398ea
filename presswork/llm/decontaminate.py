"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. An item's sketch is its k
smallest shingle hashes (bottom-k MinHash); k depends on the partition and is the least
number that a document with the wanted containment can't miss altogether: if at most
(1 - threshold) of n shingles are missing, more than that many sketch entries leave at
least one. Documents that hold a sketch entry are candidates, and these are verified on
the words of the item's whole shingle set. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch, small

N_WORDS, THRESHOLD = 5, 0.8


def normal_words(text: Column) -> Column:
    """Words in lower case, without punctuation. Null and wordless texts have none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles(df: DataFrame, text: str, n_words: int, said: bool = False) -> DataFrame:
    """df with `shingles`: all n_words-word shingles of the text, in order of place, repeats
    included, as hashes or (said) as structs of hash h and words s; fewer words have
    none. The text column is dropped."""
    words = df.withColumn("words", normal_words(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    parts = ", ".join(f"words[i + {k}]" for k in range(n_words))
    each = f"named_struct('h', xxhash64({parts}), 's', concat_ws(' ', {parts}))" if said else f"xxhash64({parts})"
    none = "array<struct<h:bigint,s:string>>" if said else "array<bigint>"
    made = F.expr(f"if(size(words) < {n_words}, cast(array() as {none}), transform(sequence(0, size(words) - {n_words}), i -> {each}))")
    return words.withColumn("shingles", made).drop("words", text)


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """One row a shingle. explode_outer: for explode, the optimizer infers a filter on the
    shingles and, pushing it down, works out the words anew for every shingle."""
    rows = df.select(*keys, F.explode_outer("shingles").alias("x"))
    return rows.filter("x is not null")


def sketch_size(n: Column, threshold: float) -> Column:
    """Enough for the largest size of the partition [2**p, 2**(p + 1)) that n is in."""
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1
    return F.least((F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int"), n)


def contained_items(docs: DataFrame, items: DataFrame, n_words: int = N_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_shingles, found, containment) of all pairs of which the
    document has at least `threshold` of the item's distinct shingles; also doc and tid,
    the keys of the text.

    An item of fewer than n_words words is one shingle of all its words; items without
    words, or null, are never found. Repeated item_ids are searched as one item with all
    their shingles. A null doc_id or item_id is a value like others. Documents are
    searched whole, however long; those without words, or null, hold nothing. Equal rows
    of docs give one row. Empty tables give no rows, and other columns play no part.
    """
    scratch = Scratch(docs.sparkSession)
    texts = common.keyed_texts(docs)
    given = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(common.NO_ID)).alias("item_id"), "text")
    words = F.size(normal_words(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    given = scratch.save(given.withColumn("width", F.least(words, F.lit(n_words))).filter("width > 0"))
    widths = [r.width for r in given.select("width").distinct().collect()]  # at most n_words numbers
    parts = [exploded(shingles(given.filter(F.col("width") == w).select("item_id", "text"), "text", w, said=True), "item_id").select("item_id", F.lit(w).alias("width"), "x.h", "x.s").distinct() for w in sorted(widths)]
    if not parts:
        parts = [given.select("item_id", "width", F.lit(0).cast("long").alias("h"), F.lit("").alias("s"))]
    whole = scratch.save(reduce(DataFrame.unionByName, parts))
    sets = scratch.save(whole.groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("n")))
    # bottom-k by item; the few of one item are sorted in its row
    lists = whole.join(small(sets), "item_id").groupBy("item_id", "n").agg(F.sort_array(F.collect_list(F.struct("h", "width"))).alias("all"))
    sketch = scratch.save(lists.select("item_id", F.explode_outer(F.slice("all", 1, sketch_size(F.col("n"), threshold))).alias("x")).select("item_id", "x.*"))
    candidates, held = [], []
    for w in sorted(widths):
        made = exploded(shingles(texts, "text", w), "doc", "tid").select("doc", "tid", F.col("x").alias("h"))
        candidates.append(made.join(small(sketch.filter(F.col("width") == w).select("item_id", "h")), "h").select("doc", "tid", "item_id").distinct())
    if not candidates:
        candidates = [texts.select("doc", "tid", F.lit(0).cast("long").alias("item_id")).limit(0)]
    pairs = scratch.save(reduce(DataFrame.unionByName, candidates).distinct())
    again = texts.join(small(pairs.select("doc", "tid").distinct()), ["doc", "tid"], "left_semi")
    for w in sorted(widths):
        made = exploded(shingles(again, "text", w, said=True), "doc", "tid").select("doc", "tid", "x.h", "x.s")
        # compared by their words; only shingles that some item has go on
        held.append(made.join(small(whole.filter(F.col("width") == w).drop("width")), ["h", "s"]).select("doc", "tid", "item_id", "s"))
    if not held:
        held = [pairs.withColumn("s", F.lit(""))]
    found = reduce(DataFrame.unionByName, held).distinct().groupBy("doc", "tid", "item_id").agg(F.count(F.lit(1)).alias("found"))
    found = found.join(small(pairs), ["doc", "tid", "item_id"], "left_semi").join(small(sets), "item_id")
    return found.filter(F.col("found") >= F.col("n") * threshold - 1e-9).select(
        common.doc_id_of().alias("doc_id"),
        common.doc_id_of("item_id").alias("item_id"),
        F.col("n").cast("long").alias("item_shingles"),
        F.col("found").cast("long").alias("found"),
        F.round(F.col("found") / F.col("n"), 6).alias("containment"),
        "doc",
        "tid",
    )


SQL = r"""
with i as (select item_id, string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w from benchmark),
d as (select doc_id, string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') w from documents),
iw as (select item_id, w, least(len(w), 5) n from i where w <> ['']),
si as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') s from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) k from iw)),
ni as (select item_id, count(*) c from si group by 1),
sd as (select distinct doc_id, n, array_to_string(w[k:k + n - 1], ' ') s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from iw) where len(w) >= n)),
f as (select doc_id, item_id, count(*) found from sd join si using (n, s) group by 1, 2)
select doc_id, item_id, c::bigint item_shingles, found::bigint found, round(found / c, 6) containment
from f join ni using (item_id) where found >= 0.8 * c - 1e-9
"""
