"""One object for the service's calls: each method is a plan over stored tables.

Tables are Parquet folders under one root; reading calls return DataFrames, writing ones
append or, for vectors and deletions, replace a table. `processed` marks what embedding
and extraction have looked at, found or not.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import anomaly, dedup, embed, explain, feed, ingest, kg, knn, listing, ranking, users
from ..operators.storage import stored

ENTITY_ROWS = "article_id bigint, pos int, entity_id bigint, name string, entity_type string, mention_text string"
EVENT_ROWS = (
    "article_id bigint, kind string, score double, related_article_ids array<bigint>, related_sources array<string>, "
    "mean_similarity double, window_hours int, similarity_threshold double, detected_at timestamp_ntz"
)
ARTICLE_ROWS = (
    "id bigint, title string, url string, source string, summary string, authors string, doi string, external_id string, "
    "content_hash string, published_at timestamp_ntz, fetched_at timestamp_ntz"
)
TABLES = {
    "articles": ARTICLE_ROWS,
    "embeddings": "id bigint, dims array<int>, ws array<double>",
    "processed": "article_id bigint, stage string, processed_at timestamp_ntz",
    "interactions": schemas.INTERACTIONS,
    "users": schemas.USERS,
    "user_vectors": "user_id bigint, dim int, w double, interaction_count bigint, updated_at timestamp_ntz",
    "mentions": ENTITY_ROWS,
    "relations": "subject_entity_id bigint, predicate string, object_entity_id bigint, evidence_article_id bigint, created_at timestamp_ntz",
    "events": EVENT_ROWS,
    "runs": schemas.INGESTION_RUNS,
}
EDGE = ["subject_entity_id", "predicate", "object_entity_id", "evidence_article_id"]


class Engine:
    """as_of is the present for all calls; nothing reads the clock. An engine of a user
    (as_user) answers for that user only."""

    def __init__(self, spark: SparkSession, root: str, gazetteer: list[dict], as_of: datetime, user: int | None = None):
        self.spark, self.root, self.gazetteer, self.as_of, self.user = spark, root.rstrip("/"), list(gazetteer), as_of, user

    def as_user(self, user_id: int) -> Engine:
        """The same tables for one caller: calls about another user's data are refused."""
        return Engine(self.spark, self.root, self.gazetteer, self.as_of, user_id)

    def _self(self, user_id: int) -> int:
        if self.user is not None and user_id != self.user:
            raise PermissionError("not authorized for this user")
        return user_id

    # storage

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        files, where = self._files(path)
        return files.exists(where)

    def table(self, name: str) -> DataFrame:
        schema, path = TABLES[name], f"{self.root}/{name}"
        if not self._exists(path):
            for end in (".new", ".old"):  # _replace() was broken off; without _SUCCESS while it wrote
                if self._exists(f"{path}{end}/_SUCCESS"):
                    self._rename(f"{path}{end}", path)
                    break
            else:
                return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _as_table(self, name: str, rows: DataFrame) -> DataFrame:
        target = self.spark.createDataFrame([], TABLES[name]).schema
        missing = {f.name: F.lit(None).cast(f.dataType) for f in target if f.name not in rows.columns}
        return rows.withColumns(missing).select(*[F.col(f.name).cast(f.dataType) for f in target])

    def append(self, name: str, rows: DataFrame) -> None:
        self._as_table(name, rows).write.mode("append").parquet(f"{self.root}/{name}")

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Writes the whole table anew beside the old one, then changes places; at every
        moment one of them is complete under a name that table() knows."""
        here, new, old = (f"{self.root}/{name}{end}" for end in ("", ".new", ".old"))
        self._as_table(name, rows).write.mode("overwrite").parquet(new)
        files, where = self._files(here)
        if files.exists(where):
            files.delete(self._files(old)[1], True)
            self._rename(here, old)
        self._rename(new, here)
        files.delete(self._files(old)[1], True)

    def _rename(self, before: str, after: str) -> None:
        files, where = self._files(before)
        if not files.rename(where, self._files(after)[1]):
            raise OSError(f"{before} could not be renamed to {after}")

    def _now(self):
        return F.lit(self.as_of).cast("timestamp_ntz")

    # ingestion

    def ingest(self, sources: dict[str, Callable[[SparkSession], DataFrame]]) -> DataFrame:
        """Reads, deduplicates against what is stored, stores, embeds, extracts, records."""
        started = self.as_of
        rows, errors = ingest.read_sources(sources, self.spark)
        n_embedded = n_entities = 0
        counts = self.spark.createDataFrame([], "source string, added bigint, duplicates bigint")
        if rows is not None:
            stored = self.table("articles")
            highest = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
            rows = rows.withColumn("content_hash", T.content_hash(F.col("title"))).withColumn("fetched_at", self._now())
            for column in ("doi", "authors", "external_id"):
                rows = rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast("string"))
            path = f"{self.root}/arrivals/{started:%Y%m%dT%H%M%S%f}"
            rows.withColumn("id", F.monotonically_increasing_id() + highest + 1).write.mode("overwrite").parquet(path)  # ids are given once
            marked = ingest.created(self.spark.read.parquet(path), stored)
            counts = self.spark.createDataFrame(ingest.counts(marked).collect(), counts.schema)  # one row a source
            self.append("articles", marked.filter("created"))
            n_embedded, n_entities = self.embed_missing(), self.extract_missing()
        record = ingest.run_record(self.spark, counts, errors, started, self.as_of, n_embedded, n_entities)
        self.append("runs", record)
        return record

    def _unmarked(self, stage: str) -> DataFrame:
        done = self.table("processed").filter(F.col("stage") == stage)
        return stored(kg.unprocessed(self.table("articles"), done))

    def _mark(self, stage: str, articles: DataFrame) -> None:
        self.append("processed", articles.select(F.col("id").alias("article_id"), F.lit(stage).alias("stage"), self._now().alias("processed_at")))

    def embed_missing(self, backend: str = "hash") -> int:
        """Embeds the articles that it has not looked at yet; returns their number."""
        todo = self._unmarked("embed")
        n = todo.count()
        if n:
            # a run that broke off before its marks may have stored vectors
            self.append("embeddings", embed.embed_missing(todo, self.table("embeddings"), backend))
            self._mark("embed", todo)
        return n

    def extract_missing(self) -> int:
        """Extracts the entities of the articles that it has not looked at yet; returns the
        number of new mentions."""
        if not self.gazetteer:
            return 0
        todo = self._unmarked("extract")
        texts = todo.select("id", T.entity_text(F.col("title"), F.col("summary")).alias("text"))
        found = stored(kg.article_entities(kg.mentions(texts, self.gazetteer), kg.gazetteer_table(self.spark, self.gazetteer)))
        edges = kg.append_new(self.table("relations"), kg.relations(found), EDGE)
        self.append("relations", edges.withColumn("created_at", self._now()))
        new = stored(kg.append_new(self.table("mentions"), found, ["article_id", "entity_id"]))
        self.append("mentions", new)
        self._mark("extract", todo)
        return new.count()

    def runs(self, limit: int = 20) -> DataFrame:
        return listing.latest(self.table("runs"), "started_at", limit)

    # articles and search

    def articles(self, source: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        return listing.articles(self.table("articles"), source, limit, offset).select(*schemas.ARTICLE_COLUMNS)

    def article(self, article_id: int) -> DataFrame:
        return listing.lookup(self.table("articles"), id=article_id).select(*schemas.ARTICLE_COLUMNS)

    def related(self, article_id: int, limit: int = 10) -> DataFrame:
        return knn.related(article_id, self.table("articles"), self.table("embeddings"), limit)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        return knn.search(query, self.table("articles"), self.table("embeddings"), listing.bounded(limit))

    # users

    def create_user(self, asked: DataFrame) -> DataFrame:
        """The ids of the users that `asked` (email, apple_user_id, google_user_id) names; new
        ones are stored. Requests are taken in turn: one that shares an address or account
        with an earlier new one means the same user."""
        known = self.table("users")
        highest = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        keys = ("email", "apple_user_id", "google_user_id")
        asked = stored(asked.withColumn("_turn", F.monotonically_increasing_id() + highest + 1))
        new = users.get_or_create(known, asked).filter("id is null").withColumn("id", F.col("_turn"))
        first = dedup.three_tier(new, keys=keys)
        self.append("users", first.withColumns({c: self._now() for c in ("created_at", "updated_at")}))
        return users.get_or_create(self.table("users"), asked).drop("_turn")

    def record_interactions(self, rows: DataFrame) -> None:
        """Stores interactions and makes the vectors of the users anew who have positive ones."""
        rows = stored(rows)
        self.append("interactions", rows)
        changed = rows.filter(F.col("interaction_type").isin(listing.POSITIVE)).select("user_id").distinct()
        mine = self.table("interactions").join(changed, "user_id", "left_semi")
        new = stored(users.vectors(mine, self.table("embeddings")).withColumn("updated_at", self._now()))
        self._replace("user_vectors", users.upsert(self.table("user_vectors"), self._as_table("user_vectors", new), "user_id"))

    def interactions(self, user_id: int, kind: str | None = None, limit: int = 50) -> DataFrame:
        rows = listing.lookup(self.table("interactions"), user_id=self._self(user_id))
        rows = rows if kind is None else listing.lookup(rows, interaction_type=kind)
        return listing.latest(rows, "created_at", limit)

    def user_vectors(self) -> DataFrame:
        """The stored vectors (user_id, dim, w, interaction_count, updated_at)."""
        rows = self.table("user_vectors")
        return rows if self.user is None else rows.filter(F.col("user_id") == self.user)

    def feed(self, limit: int = 20, offset: int = 0, user_ids: list[int] | None = None) -> DataFrame:
        """(user_id, id, similarity, rn, reason, cold_start, next_cursor) for all users, or
        for some; next_cursor is null on a user's last page."""
        user_ids = [self.user] if user_ids is None and self.user is not None else user_ids
        inter, emb, arts, people = self.table("interactions"), self.table("embeddings"), self.table("articles"), self.table("users").select(F.col("id").alias("user_id"))
        if user_ids is not None:
            user_ids = list(map(self._self, user_ids))
            inter, people = inter.filter(F.col("user_id").isin(user_ids)), people.filter(F.col("user_id").isin(user_ids))
        vectors = stored(users.vectors(inter, emb))
        warm = feed.with_reasons(feed.warm(vectors, inter, emb, limit, offset), arts, inter, emb)
        warm = warm.select("user_id", "id", F.round("sim", 4).alias("similarity"), "rn", "reason", F.lit(False).alias("cold_start"))
        new = people.join(vectors.select("user_id").distinct(), "user_id", "left_anti")
        cold = feed.cold(arts, inter, emb, new, self.as_of, limit, offset).select("user_id", "id", "similarity", "rn", "reason", F.lit(True).alias("cold_start"))
        shown = F.count(F.lit(1)).over(Window.partitionBy("user_id"))  # at most `limit` rows a user
        return warm.unionByName(cold).withColumn("next_cursor", F.when(shown == limit, F.lit(offset + limit)))

    def enhanced_feed(self, model=None, tower: ranking.TwoTower | None = None, limit: int = 20, candidates: int = 100) -> DataFrame:
        """(user_id, id, score, rn, reason, cold_start): candidates by the two-tower model, or by
        the user's vector without one, ranked again by the model. Without either, and for
        users without a vector, this is the plain feed."""
        plain = self.feed(limit).select("user_id", "id", F.col("similarity").alias("score"), "rn", "reason", "cold_start")
        if model is None and tower is None:
            return plain
        inter, emb, arts = self.table("interactions"), self.table("embeddings"), self.table("articles")
        inter = inter if self.user is None else inter.filter(F.col("user_id") == self.user)
        vectors = stored(users.vectors(inter, emb))
        if tower is None:
            found = feed.warm(vectors, inter, emb, candidates).select("user_id", "id", "sim")
        else:
            found = feed.by_tower(vectors, inter, emb, tower, candidates)
        found = stored(found)
        rows = self._features(found.select("user_id", "id")) if model is not None else None
        ranked = ranking.enhanced(found, rows, model, limit)
        ranked = feed.with_reasons(ranked, arts, inter, emb).select("user_id", "id", "score", "rn", "reason", F.lit(False).alias("cold_start"))
        return ranked.unionByName(plain.filter("cold_start"))

    def ranked_feed(self, model, limit: int = 20, candidates: int = 100) -> DataFrame:
        inter, emb = self.table("interactions"), self.table("embeddings")
        found = feed.warm(users.vectors(inter, emb), inter, emb, candidates).select("user_id", "id", "sim")
        return ranking.enhanced(found, self._features(found.select("user_id", "id")), model, limit)

    def _features(self, pairs: DataFrame) -> DataFrame:
        return ranking.features(pairs, self.table("articles"), self.table("interactions"), self.table("embeddings"), self.table("mentions"), self.as_of)

    def train_ranker(self, name: str = "ranker", **settings):
        """Trains on all users with enough history and saves the model under models/."""
        pairs = ranking.split(ranking.reranker_pairs(self.table("interactions"), self.table("articles"), self.table("embeddings")), ["user_id", "id"])
        model = ranking.train_gbt(self._features(pairs), **settings)
        model.write().overwrite().save(f"{self.root}/models/{name}")
        return model

    def load_ranker(self, name: str = "ranker"):
        from pyspark.ml.classification import GBTClassificationModel

        return GBTClassificationModel.load(f"{self.root}/models/{name}")

    def explain(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs if self.user is None else pairs.filter(F.col("user_id") == self.user)
        found = explain.signals(pairs, self.table("articles"), self.table("interactions"), self.table("embeddings"), self.table("mentions"), self.as_of)
        return explain.explanations(pairs, found)

    # knowledge graph and bursts

    def entities(self, entity_type: str | None = None, q: str | None = None, limit: int = 50) -> DataFrame:
        known = self.table("mentions").select("entity_id", "name", "entity_type").distinct()
        return kg.find(known, entity_type, q, limit)

    def entity_relations(self, entity_id: int, limit: int = 50) -> DataFrame:
        return kg.relations_of(self.table("relations"), entity_id, limit)

    def article_entities(self, article_id: int) -> DataFrame:
        return listing.lookup(self.table("mentions"), article_id=article_id).orderBy("name")

    def detect_bursts(self, recent: int | None = 100, **settings) -> DataFrame:
        """Stores and returns the new events of the latest articles (all: recent=None)."""
        before = self.table("events")
        new = anomaly.bursts(self.table("articles"), self.table("embeddings"), recent, existing=before, **settings)
        rows = stored(new.join(before.select("article_id", "kind"), ["article_id", "kind"], "left_anti").withColumn("detected_at", self._now()))
        self.append("events", rows)
        return rows

    def events(self, limit: int = 50) -> DataFrame:
        """The newest events."""
        return listing.latest(self.table("events"), "detected_at", limit, ("article_id", "kind"))

    def burst_prompt(self, article_id: int) -> DataFrame:
        return anomaly.prompts(listing.lookup(self.table("events"), article_id=article_id), self.table("articles"))

    def delete_articles(self, ids: DataFrame) -> None:
        """Deletes articles (id) and all that refers to them; each table is rewritten once."""
        of = {"mentions": "article_id", "interactions": "article_id", "relations": "evidence_article_id", "events": "article_id", "processed": "article_id", "embeddings": "id", "articles": "id"}
        for name, key in of.items():
            self._replace(name, self.table(name).join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti"))
