"""Dictionary entities and their co-occurrence graph."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import dedup
from .dictionary import matcher, packed
from .storage import small, stored

#: Fixed values: (unordered types) -> the predicate from the first to the second, and back.
PREDICATES = [
    ("company", "drug", "develops", "developed_by"),
    ("company", "disease", "researches", "researched_by"),
    ("drug", "disease", "targets", "targeted_by"),
    ("drug", "gene", "targets", "targeted_by"),
    ("company", "gene", "researches", "researched_by"),
    ("company", "trial", "sponsors", "sponsored_by"),
    ("drug", "trial", "evaluated_in", "evaluates"),
    ("disease", "trial", "studied_in", "studies"),
]
DEFAULT_PREDICATE = "co_mentioned_with"


def entity_id(external_id: Column, name: Column, entity_type: Column) -> Column:
    """A stable id: of the external id, or of name and type where there is none."""
    return F.when(external_id.isNotNull(), F.xxhash64(external_id)).otherwise(F.xxhash64(name, entity_type))


def aliases(gazetteer: list[dict]) -> list[tuple[str, int]]:
    """(alias, place of its entity), longest first; of equal length in the given order."""
    listed = [(alias, i) for i, entity in enumerate(gazetteer) for alias in entity["aliases"]]
    return sorted(listed, key=lambda pair: -len(pair[0]))


def mentions(articles: DataFrame, gazetteer: list[dict], text: str = "text", key: str = "id") -> DataFrame:
    """(article_id, pos, entity, mention_text): entity is the place in the gazetteer.

    Aliases claim their first occurrence as whole words in any case, longest alias first:
    one that overlaps a claimed span, or names an entity that has claimed already, is
    passed over, and later occurrences aren't tried. pos is the order of claims.
    gazetteer: dicts of name, type, external_source, external_id, aliases. Null and empty
    texts have no mentions.
    """
    entries = aliases(gazetteer)
    for alias, _ in entries:
        if not re.search(r"[^\W_]", alias):
            raise ValueError(f"an alias needs a letter or digit: {alias!r}")
    spark = articles.sparkSession
    ship(spark)
    name, data = packed(entries)
    sent = spark.sparkContext.broadcast(data)  # as large as the list that the caller holds

    def run(batches):
        found = matcher(name, sent.value)
        for batch in batches:
            rows = [(i, n, e, m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, (e, m) in enumerate(found.claims(t))]
            yield pa.RecordBatch.from_pylist([dict(zip(MENTION.names, r)) for r in rows], MENTION)

    asked = articles.select(F.col(key).cast("bigint").alias("article_id"), F.col(text).cast("string").alias("text"))
    return asked.mapInArrow(run, "article_id bigint, pos int, entity int, mention_text string")


MENTION = pa.schema([("article_id", pa.int64()), ("pos", pa.int32()), ("entity", pa.int32()), ("mention_text", pa.string())])


def gazetteer_table(spark, gazetteer: list[dict]) -> DataFrame:
    rows = [(i, g["name"], g["type"], g.get("external_source"), g.get("external_id"), list(g["aliases"])) for i, g in enumerate(gazetteer)]
    df = spark.createDataFrame(rows, "entity int, name string, entity_type string, external_source string, external_id string, aliases array<string>")
    return df.withColumn("entity_id", entity_id(F.col("external_id"), F.col("name"), F.col("entity_type")))


def trial_mentions(articles: DataFrame, trials: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(article_id, pos, name, external_id): trial numbers of the text whose title is
    known in `trials` (nct_id, title); others leave no entity. pos is the order of first mention."""
    from ..functions.text import nct_ids

    ids = articles.select(F.col(key).alias("article_id"), F.posexplode(nct_ids(F.col(text))).alias("pos", "nct_id"))
    known = trials.filter("title is not null").dropDuplicates(["nct_id"])
    return ids.join(known, "nct_id").select("article_id", "pos", F.col("title").alias("name"), F.col("nct_id").alias("external_id"))


def article_entities(found: DataFrame, entities: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """(article_id, pos, entity_id, name, entity_type, mention_text): dictionary entities
    in the order of claims, then trials."""
    out = found.join(small(entities), "entity").select("article_id", "pos", "entity_id", "name", "entity_type", "mention_text")
    if trials is not None:
        kind = F.lit("trial")
        ids = entity_id(F.col("external_id"), F.col("name"), kind).alias("entity_id")
        more = trials.select("article_id", (F.col("pos") + 1_000_000).alias("pos"), ids, "name", kind.alias("entity_type"), F.col("external_id").alias("mention_text"))
        out = out.unionByName(more)
    first = Window.partitionBy("article_id", "entity_id").orderBy("pos")
    return out.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def relations(entities: DataFrame, directed: bool = True) -> DataFrame:
    """(subject_entity_id, predicate, object_entity_id, evidence_article_id), distinct,
    from article_entities(). A pair of types has a predicate each way; other pairs are
    only mentioned together, in the order of claims. directed=False reads the predicate
    in the order of claims too, whatever the types."""
    spark = entities.sparkSession
    table = spark.createDataFrame([(*p, *sorted(p[:2])) for p in PREDICATES], "a_type string, b_type string, there string, back string, low string, high string")
    a = entities.select("article_id", F.col("pos").alias("ap"), F.col("entity_id").alias("ai"), F.col("entity_type").alias("at"))
    b = entities.select("article_id", F.col("pos").alias("bp"), F.col("entity_id").alias("bi"), F.col("entity_type").alias("bt"))
    pairs = a.join(b, (a.article_id == b.article_id) & (a.ap < b.bp)).drop(b.article_id)
    pairs = pairs.withColumn("low", F.least("at", "bt")).withColumn("high", F.greatest("at", "bt")).join(F.broadcast(table), ["low", "high"], "left")
    swap = (F.col("at") == F.col("b_type")) & (F.col("at") != F.col("bt")) if directed else F.lit(False)
    s, o = F.when(swap, F.col("bi")).otherwise(F.col("ai")), F.when(swap, F.col("ai")).otherwise(F.col("bi"))
    there, back = F.coalesce("there", F.lit(DEFAULT_PREDICATE)), F.coalesce("back", F.lit(DEFAULT_PREDICATE))
    edge = lambda x, p, y: F.struct(x.alias("subject_entity_id"), p.alias("predicate"), y.alias("object_entity_id"))
    both = F.when(there == back, F.array(edge(s, there, o))).otherwise(F.array(edge(s, there, o), edge(o, back, s)))
    out = pairs.select(F.col("article_id").alias("evidence_article_id"), F.explode(both).alias("e")).select("e.*", "evidence_article_id")
    return out.distinct()


def strength(edges: DataFrame) -> DataFrame:
    return edges.groupBy("subject_entity_id", "predicate", "object_entity_id").agg(F.count(F.lit(1)).alias("strength"))


def find(entities: DataFrame, entity_type: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
    """Entities by type and part of the name in any case; % and _ in q are wildcards."""
    df = entities if entity_type is None else entities.filter(F.col("entity_type") == entity_type)
    df = df if q is None else df.filter(F.col("name").ilike(f"%{q}%"))
    return df.orderBy("name", "entity_id").limit(limit)


def neighbourhood(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(entity_id, neighbour_id, n): for every entity the ones it has relations with."""
    way = lambda a, b: F.struct(F.col(f"{a}_entity_id").alias("entity_id"), F.col(f"{b}_entity_id").alias("neighbour_id"))
    ends = F.explode(F.array(way("subject", "object"), way("object", "subject"))).alias("x")
    counts = edges.select(ends).select("x.*").groupBy("entity_id", "neighbour_id").agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        return counts
    order = Window.partitionBy("entity_id").orderBy(F.desc("n"), "neighbour_id")
    return counts.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit).drop("_rn")


def relations_of(edges: DataFrame, entity: int, limit: int = 50) -> DataFrame:
    """An entity's relations, the newest first where edges have created_at."""
    mine = edges.filter((F.col("subject_entity_id") == entity) | (F.col("object_entity_id") == entity))
    newest = [F.desc_nulls_last("created_at")] if "created_at" in edges.columns else []
    return mine.orderBy(*newest, "evidence_article_id", "predicate", "subject_entity_id", "object_entity_id").limit(limit)


def unprocessed(articles: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles without a mark in `done` (article_id): what a stage has looked at, whether
    it found something or not."""
    todo = articles.join(done.select(F.col("article_id").alias("id")).distinct(), "id", "left_anti")
    return todo if limit is None else todo.orderBy("id").limit(limit)


def resolve(requests: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with entity_id, new rows of the registry), as if each request in turn had
    asked for the entity with its external id, else for the one with its name and type, and
    made a new one where there is neither.

    requests: arrival (unique), name, entity_type, external_source, external_id, and what
    else they have; registry: entity_id, name, entity_type, external_source, external_id.
    An empty external id is none. A request that makes an entity is one that shares neither
    key with an entity made before, so the makers are those that deduplication by the two
    keys keeps; all others find an entity that is stored or made before their arrival.
    """
    keyed = lambda df: df.withColumns({"_ext": F.when(F.col("external_id") != "", F.col("external_id")), "_named": F.to_json(F.struct("name", "entity_type"))})
    known = keyed(registry)
    asked = stored(keyed(requests))
    # of equal requests only the first can make an entity
    distinct = asked.groupBy("_ext", "_named").agg(F.min("arrival").alias("arrival"))
    makers = dedup.three_tier(distinct, keys=("_ext", "_named"), order="arrival", history=known).select("arrival")
    made = asked.join(makers, "arrival", "left_semi")
    made = stored(made.withColumn("entity_id", entity_id(F.col("_ext"), F.col("name"), F.col("entity_type"))))
    columns = ["entity_id", "name", "entity_type", "external_source", "external_id"]
    found = known.select(*columns, "_ext", "_named", F.lit(None).cast("bigint").alias("since")).unionByName(made.select(*columns, "_ext", "_named", F.col("arrival").cast("bigint").alias("since")))
    out = asked
    for key in ("_ext", "_named"):
        side = found.filter(F.col(key).isNotNull()).select(key, F.col("entity_id").alias(f"{key}_id"), F.col("since").alias(f"{key}_since"))
        out = out.join(small(side), key, "left")
        early = F.col(f"{key}_since").isNull() | (F.col(f"{key}_since") <= F.col("arrival"))
        out = out.withColumn(f"{key}_id", F.when(early, F.col(f"{key}_id"))).drop(f"{key}_since")
    resolved = out.select(*requests.columns, F.coalesce("_ext_id", "_named_id").alias("entity_id"))
    return resolved, made.select(*columns)


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new that old doesn't have by these keys, each once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
