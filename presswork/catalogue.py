"""Every registered query of the content pipeline, and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle
from .functions import scores as S
from .functions import text as T
from .functions.dates import freshness_days
from .operators import anomaly, dedup, embed, evaluate, explain, feed, ingest, kg, knn, listing, ranking, users
from .operators.storage import new_folder, small, stored
from .operators.vector_index import VectorIndex, recall
from .sources import adapters as A
from .streaming import bursts
from .streaming.user_state import current_vectors, refresh_users

AS_OF = datetime(2024, 1, 31)
QUERY = "the ertion thanedble of attion"
ROUND = 4

#: A small vocabulary that occurs in the driver's texts; aliases don't overlap.
GAZETTEER = [
    {"name": "thtion", "type": "disease", "external_source": "DEMO", "external_id": "D:1", "aliases": ["thtion"]},
    {"name": "attion", "type": "drug", "external_source": "DEMO", "external_id": "D:2", "aliases": ["attion"]},
    {"name": "ertion", "type": "gene", "external_source": "DEMO", "external_id": "D:3", "aliases": ["ertion"]},
    {"name": "thanea", "type": "company", "external_source": "DEMO", "external_id": "D:4", "aliases": ["thanea"]},
    {"name": "eriner", "type": "disease", "external_source": "DEMO", "external_id": "D:5", "aliases": ["eriner"]},
    {"name": "thanedble", "type": "drug", "external_source": "DEMO", "external_id": "D:6", "aliases": ["thanedble"]},
    {"name": "queoi", "type": "company", "external_source": None, "external_id": None, "aliases": ["queoi"]},
    {"name": "eaureau", "type": "gene", "external_source": None, "external_id": None, "aliases": ["eaureau"]},
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE = oracle.SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


def _embedded(spark, sf_dir, only=None):
    """Vectors of all articles, or of those in `only` (id)."""
    arts = embed.spread(A.articles(spark, sf_dir).select("id", T.embedding_text(F.col("title"), F.col("summary")).alias("text")))
    return embed.hash_vectors(arts if only is None else arts.join(only, "id", "left_semi"))


def _with_vector(spark, sf_dir):
    """(id) of the articles that have a vector, made once for all its uses."""
    return stored(_embedded(spark, sf_dir).select("id"))


def _entities(spark, sf_dir, columns=("article_id", "pos", "entity_id", "name", "entity_type", "mention_text")):
    arts = A.articles(spark, sf_dir).select("id", T.entity_text(F.col("title"), F.col("summary")).alias("text"))
    return kg.article_entities(kg.mentions(arts, GAZETTEER), kg.gazetteer_table(spark, GAZETTEER)).select(*columns)


def _vectors(spark, sf_dir):
    inter = A.interactions(spark, sf_dir)
    inter = stored(listing.ranked_log(inter))
    liked = _embedded(spark, sf_dir, users.positive_articles(inter).select(F.col("article_id").alias("id")).distinct())
    return users.vectors(inter, liked)


@query
def hash_embed_sparse(spark, sf_dir):
    return embed.sparse(_embedded(spark, sf_dir)).select("id", F.col("dim").cast("bigint").alias("dim"), F.round("w", 6).alias("w"))


@query
def semantic_search_topk(spark, sf_dir):
    return knn.search(QUERY, A.articles(spark, sf_dir), stored(_embedded(spark, sf_dir)), 10)


@query
def related_articles_topk(spark, sf_dir):
    return knn.related(1, A.articles(spark, sf_dir), stored(_embedded(spark, sf_dir)), 10)


@query
def articles_list_recent(spark, sf_dir):
    return listing.articles(A.articles(spark, sf_dir), limit=20).select("id", "title", "source", F.col("published_at").cast("string").alias("published_at"))


@query
def articles_by_source(spark, sf_dir):
    return listing.articles(A.articles(spark, sf_dir), source="src3", limit=20).select("id", "title", "source")


@query
def articles_page_offset(spark, sf_dir):
    rows = listing.page(A.articles(spark, sf_dir), [F.desc_nulls_last("published_at"), F.col("id")], 20, 40)
    return rows.select("id", "title", F.col("next_cursor").cast("bigint").alias("next_cursor"))


@query
def article_lookup(spark, sf_dir):
    return listing.lookup(A.articles(spark, sf_dir), id=42).select("id", "title", "url", "source")


@query
def article_by_content_hash(spark, sf_dir):
    arts = A.articles(spark, sf_dir)
    asked = arts.filter("id = 7").select("content_hash")
    return arts.join(F.broadcast(asked), "content_hash", "left_semi").select("id", "content_hash")


@query
def title_normalize_hash(spark, sf_dir):
    return A.articles(spark, sf_dir).select("id", T.normalize_title(F.col("headline")).alias("normalized"), "content_hash")


@query
def dedup_title_hash(spark, sf_dir):
    return dedup.by_key(A.articles(spark, sf_dir), "content_hash").select("id")


@query
def dedup_three_tier(spark, sf_dir):
    return dedup.three_tier(A.articles(spark, sf_dir)).select("id")


@query
def ingest_counts_by_source(spark, sf_dir):
    return ingest.counts(ingest.created(A.articles(spark, sf_dir)))


@query
def ingestion_run_record(spark, sf_dir):
    per_source = ingest.counts(ingest.created(A.articles(spark, sf_dir)))
    row = ingest.run_record(spark, per_source, {"broken": "no such feed"}, AS_OF, AS_OF)
    totals = [F.col(c).cast("bigint").alias(c) for c in ("added_total", "error_count")]
    return row.select("id", *totals, F.size("detail.added").cast("bigint").alias("n_sources"))


@query
def interactions_latest_n(spark, sf_dir):
    return listing.latest_per_user(A.interactions(spark, sf_dir), 5).select("user_id", "id", "article_id", "interaction_type", F.col("rn").cast("bigint").alias("rn"))


@query
def interactions_by_user(spark, sf_dir):
    rows = listing.lookup(A.interactions(spark, sf_dir), user_id=3, interaction_type="like")
    return listing.latest(rows, "created_at", 20).select("id", "article_id", "interaction_type")


@query
def hidden_articles(spark, sf_dir):
    return listing.hidden(A.interactions(spark, sf_dir))


@query
def item_popularity(spark, sf_dir):
    pop = users.popularity(A.interactions(spark, sf_dir))
    return A.articles(spark, sf_dir).select(F.col("id").alias("article_id")).join(pop, "article_id", "left").select("article_id", F.coalesce("popularity", F.lit(0)).cast("bigint").alias("popularity"))


@query
def user_stats(spark, sf_dir):
    s = users.stats(A.interactions(spark, sf_dir))
    return s.select("user_id", "interaction_count", *[F.round(c, ROUND).alias(c) for c in ("avg_read_time", "bookmark_rate", "like_rate")])


@query
def source_affinity(spark, sf_dir):
    return users.source_affinity(A.interactions(spark, sf_dir), A.articles(spark, sf_dir)).select("user_id", "source", F.round("share", ROUND).alias("share"))


@query
def topic_affinity(spark, sf_dir):
    found = users.topic_affinity(A.interactions(spark, sf_dir), _entities(spark, sf_dir, ("article_id", "entity_id", "name")), A.articles(spark, sf_dir))
    names = kg.gazetteer_table(spark, GAZETTEER).select("entity_id", "name")
    return found.join(F.broadcast(names), "entity_id").select("user_id", "name", F.round("share", ROUND).alias("share"))


@query
def interaction_weights(spark, sf_dir):
    return users.weights(A.interactions(spark, sf_dir)).select("user_id", "article_id", F.round("weight", ROUND).alias("weight"))


@query
def user_embedding(spark, sf_dir):
    return _vectors(spark, sf_dir).select("user_id", F.col("dim").cast("bigint").alias("dim"), (F.round("w", ROUND) + 0.0).alias("w"), "interaction_count")


@query
def feed_cold_start(spark, sf_dir):
    inter = A.interactions(spark, sf_dir)
    return feed.cold(A.articles(spark, sf_dir), inter, _with_vector(spark, sf_dir), inter.select("user_id"), AS_OF, limit=10)


@query
def feed_warm(spark, sf_dir):
    inter, emb = stored(listing.ranked_log(A.interactions(spark, sf_dir))), stored(_embedded(spark, sf_dir))
    rows = stored(feed.warm(users.dense_vectors(inter, emb), inter, emb, limit=10))
    out = feed.with_reasons(rows, A.articles(spark, sf_dir), inter, emb)
    return out.select("user_id", "id", F.round("sim", ROUND).alias("similarity"), "rn", "reason")


def _unit(spark, sf_dir):
    return knn.unit_vectors(A.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _index(spark, vectors):
    size = vectors.agg(F.max(F.size("dims"))).first()[0] or 1
    return VectorIndex.build(vectors, new_folder(spark), size=size)


@query
def vector_index_topk(spark, sf_dir):
    """Approximate neighbours of every fiftieth vector, with the share of the true ones found."""
    vectors = stored(_unit(spark, sf_dir))
    index, asked = _index(spark, vectors), vectors.filter("id % 50 = 0")
    probes, _ = index.probes_for(asked, 10)
    found = stored(index.search(asked, 10, probes))
    share = recall(found, index.exact(asked, 10)[0]).agg((F.sum("n_found") / F.sum("n_true")).alias("recall_at_10"))
    rows = found.select("anchor", "id", F.col("rn").cast("bigint").alias("rn"), F.round("sim", ROUND).alias("similarity"))
    return rows.join(F.broadcast(share))  # one row


@query
def knn_exact_cells(spark, sf_dir):
    """The true neighbours of every fiftieth vector, by cells and the triangle inequality."""
    vectors = stored(_unit(spark, sf_dir))
    found, _ = _index(spark, vectors).exact(vectors.filter("id % 50 = 0"), 10)
    return found.select("anchor", "id", F.col("rn").cast("bigint").alias("rn"), F.round("sim", ROUND).alias("similarity"))


@query
def knn_labels_recall_ndcg(spark, sf_dir):
    vecs = A.table(spark, sf_dir, "embeddings")
    sparse = stored(_unit(spark, sf_dir))
    near = knn.batch(sparse, sparse, 10)
    labels = vecs.select("vec_id", "label")
    ranked = near.select(F.col("anchor").alias("query"), "id", F.col("rn").alias("rank"))
    a, b = labels.select(F.col("vec_id").alias("query"), "label"), labels.select(F.col("vec_id").alias("id"), "label")
    truth = ranked.join(a, "query").join(b, ["id", "label"]).select("query", "id")
    others = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_rel")).filter("n_rel > 0")  # counted, as all pairs of a label would be quadratic
    return evaluate.retrieval(ranked, truth, sizes=a.join(others, "label").select("query", "n_rel"))


@query
def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(A.table(spark, sf_dir, "events"), "value", ["event_type"])


@query
def load_summary(spark, sf_dir):
    samples = A.table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), (F.col("value") / 100).alias("total_seconds"), (F.col("value") / 1000).alias("ttft_seconds"), F.floor("value").alias("token_count"))
    return evaluate.load_summary(samples, 100.0)


@query
def burst_detect(spark, sf_dir):
    found = anomaly.bursts(A.articles(spark, sf_dir), stored(_embedded(spark, sf_dir)), hours=720, threshold=0.5)
    return found.select("article_id", "kind", "score", F.array_join("related_sources", ",").alias("related_sources"), F.array_join(F.col("related_article_ids").cast("array<string>"), ",").alias("related_ids"), "mean_similarity")


@query
def burst_prompt(spark, sf_dir):
    arts = A.articles(spark, sf_dir)
    return anomaly.prompts(anomaly.bursts(arts, stored(_embedded(spark, sf_dir)), hours=720, threshold=0.5), arts)


@query
def kg_mentions(spark, sf_dir):
    return _entities(spark, sf_dir, ("article_id", "name", "mention_text"))


def _relations(spark, sf_dir):
    return kg.relations(_entities(spark, sf_dir))


def _named(spark, edges, *sides):
    names = kg.gazetteer_table(spark, GAZETTEER).select("entity_id", "name")
    for side in sides:
        edges = edges.join(F.broadcast(names.select(F.col("entity_id").alias(side), F.col("name").alias(f"{side}_name"))), side)
    return edges


@query
def kg_relations(spark, sf_dir):
    rows = _named(spark, _relations(spark, sf_dir), "subject_entity_id", "object_entity_id")
    return rows.select(F.col("subject_entity_id_name").alias("subject"), "predicate", F.col("object_entity_id_name").alias("object"), "evidence_article_id")


@query
def kg_relation_strength(spark, sf_dir):
    rows = _named(spark, kg.strength(_relations(spark, sf_dir)), "subject_entity_id", "object_entity_id")
    return rows.select(F.col("subject_entity_id_name").alias("subject"), "predicate", F.col("object_entity_id_name").alias("object"), "strength")


@query
def kg_entity_search(spark, sf_dir):
    """Of the entities that documents name, the drugs with a part of a name."""
    known = _entities(spark, sf_dir, ("entity_id", "name", "entity_type")).distinct()
    ids = kg.gazetteer_table(spark, GAZETTEER).select("entity_id", "external_id")
    return kg.find(known.join(F.broadcast(ids), "entity_id"), "drug", "TION").select("name", "entity_type", "external_id")


@query
def kg_entity_registry(spark, sf_dir):
    """The entity that each mention resolves to, in the order of articles, where only every
    second article gives external ids."""
    ids = kg.gazetteer_table(spark, GAZETTEER).select("entity_id", "external_source", "external_id")
    asked = _entities(spark, sf_dir, ("article_id", "pos", "entity_id", "name", "entity_type")).join(F.broadcast(ids), "entity_id").drop("entity_id")
    given = F.when(F.col("article_id") % 2 == 0, F.col("external_id"))
    asked = asked.withColumns({"arrival": F.col("article_id") * 1000 + F.col("pos"), "external_id": given})
    registry = spark.createDataFrame([], "entity_id bigint, name string, entity_type string, external_source string, external_id string")
    resolved, made = kg.resolve(asked, registry)
    known = made.select("entity_id", F.col("external_id").alias("known_as"))
    return resolved.join(small(known), "entity_id").select("article_id", "name", "known_as")


@query
def kg_entity_neighbourhood(spark, sf_dir):
    rows = _named(spark, kg.neighbourhood(_relations(spark, sf_dir)), "entity_id", "neighbour_id")
    return rows.select(F.col("entity_id_name").alias("entity"), F.col("neighbour_id_name").alias("neighbour"), "n")


@query
def kg_article_entities(spark, sf_dir):
    return _entities(spark, sf_dir).select("article_id", "name", "entity_type").orderBy("article_id", "name")


@query
def nct_ids(spark, sf_dir):
    said = F.concat(F.lit("Trial NCT"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(" after NCT00000001, NCT"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(" xNCT12345678 NCT123456789 "), F.col("title"))
    ids = A.articles(spark, sf_dir).select("id", T.nct_ids(said).alias("ids"))
    return ids.select("id", F.array_join("ids", ",").alias("nct_ids"))


@query
def trial_entities(spark, sf_dir):
    arts = A.articles(spark, sf_dir).select("id", F.concat(F.lit("NCT"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit(" NCT00000001")).alias("text"))
    trials = spark.range(50).select(F.concat(F.lit("NCT"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("nct_id"), F.when(F.col("id") % 2 == 1, F.concat(F.lit("Trial "), F.col("id").cast("string"))).alias("title"))
    return kg.trial_mentions(arts, trials).select("article_id", F.col("pos").cast("bigint").alias("pos"), "name", "external_id")


#: Names of every kind of source, dealt to the articles by id: the driver's own are all unknown.
SOURCES = [
    "Nature",
    "Science",
    "Cell",
    "NEJM",
    "Lancet",
    "Nature Medicine",
    "Nature Biotechnology",
    "Cell Reports",
    "Science Immunology",
    "STAT News",
    "GEN",
    "bioRxiv (genomics)",
    "Medrxiv",
    "PubMed",
    "nature",
    "a blog",
]


@query
def freshness_quality(spark, sf_dir):
    source = F.get(F.array(*map(F.lit, SOURCES)), (F.col("id") % len(SOURCES)).cast("int"))
    arts = A.articles(spark, sf_dir).withColumn("source", source)
    return arts.select("id", freshness_days(F.col("published_at"), AS_OF).alias("freshness"), S.source_quality(F.col("source")).alias("quality"), "source")


def _pairs(spark, sf_dir, inter, emb, vectors):
    """Every user's retrieved candidates, as for the enhanced feed, and every distinct
    (user, article) that has met."""
    retrieved = feed.warm(vectors, inter, emb, limit=100).select("user_id", "id")
    met = inter.select("user_id", F.col("article_id").alias("id")).join(A.articles(spark, sf_dir).select("id"), "id", "left_semi")
    return stored(retrieved.unionByName(met).distinct())


def _pair_inputs(spark, sf_dir):
    """The arguments of ranking.features() and explain.signals(), and the users' vectors."""
    inter, emb = stored(listing.ranked_log(A.interactions(spark, sf_dir))), stored(_embedded(spark, sf_dir))
    vectors = stored(users.dense_vectors(inter, emb))
    pairs = _pairs(spark, sf_dir, inter, emb, vectors)
    return (pairs, A.articles(spark, sf_dir), inter, emb, stored(_entities(spark, sf_dir, ("article_id", "entity_id", "name"))), AS_OF), vectors


@query
def ranker_features(spark, sf_dir):
    inputs, vectors = _pair_inputs(spark, sf_dir)
    rows = ranking.features(*inputs, vectors)
    return rows.select("user_id", "id", *[F.round(c, ROUND).alias(c) for c in ranking.FEATURES])


@query
def explain_signals(spark, sf_dir):
    found = explain.signals(*_pair_inputs(spark, sf_dir)[0])
    return found.select("user_id", "id", "label", "detail", F.round("weight", 3).alias("weight"))


@query
def explain_summaries(spark, sf_dir):
    inputs, _ = _pair_inputs(spark, sf_dir)
    rows = explain.explained(explain.signal_lists(*inputs))
    return rows.select("user_id", "id", "summary", F.size("signals").cast("bigint").alias("n_signals"))


@query
def html_clean_regex(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query
def html_clean_parser(spark, sf_dir):
    from .shipping import ship

    ship(spark)
    return A.table(spark, sf_dir, "pages").select("page_id", T.clean_feed_text("html").alias("feed_text"), T.clean_abstract("html").alias("abstract_text"))


@query
def training_pairs(spark, sf_dir):
    return ranking.two_tower_pairs(A.interactions(spark, sf_dir), _with_vector(spark, sf_dir))


@query
def reranker_training_set(spark, sf_dir):
    rows = ranking.reranker_pairs(A.interactions(spark, sf_dir), A.articles(spark, sf_dir), _with_vector(spark, sf_dir))
    return ranking.split(rows, ["user_id", "id"]).withColumn("label", F.col("label").cast("bigint"))


@query
def training_label_counts(spark, sf_dir):
    rows = ranking.reranker_pairs(A.interactions(spark, sf_dir), A.articles(spark, sf_dir), _with_vector(spark, sf_dir))
    return ranking.label_counts(rows).select(F.col("label").cast("bigint").alias("label"), "n")


@query
def feed_enhanced(spark, sf_dir):
    arts, inter, emb = A.articles(spark, sf_dir), stored(listing.ranked_log(A.interactions(spark, sf_dir))), stored(_embedded(spark, sf_dir))
    vectors = stored(users.dense_vectors(inter, emb))
    ents = stored(_entities(spark, sf_dir, ("article_id", "entity_id", "name")))
    labelled = stored(ranking.split(ranking.reranker_pairs(inter, arts, emb), ["user_id", "id"]))
    train = stored(ranking.features(labelled, arts, inter, emb, ents, AS_OF, vectors))
    model = ranking.train_gbt(train, **ranking.PRODUCTION)
    retrieved = stored(feed.warm(vectors, inter, emb, limit=100).select("user_id", "id", "sim"))
    rows = ranking.features(retrieved.select("user_id", "id"), arts, inter, emb, ents, AS_OF, vectors)
    return ranking.enhanced(retrieved, rows, model, limit=10)


@query
def user_get_or_create(spark, sf_dir):
    n, key = F.col("id"), F.col("c_custkey")
    account = lambda every, letter: F.when(key % every == 0, F.concat(F.lit(letter), key))
    email = F.concat(F.lower("c_name"), F.lit("@x.org")).alias("email")
    known = A.table(spark, sf_dir, "customer").select(key.alias("id"), email, account(3, "a").alias("apple_user_id"), account(5, "g").alias("google_user_id"))
    email = F.when(n % 2 == 0, F.concat(F.lit("customer#"), F.lpad(n.cast("string"), 9, "0"), F.lit("@x.org"))).alias("email")
    asked = spark.range(300).select(n.alias("request"), email, F.concat(F.lit("a"), n).alias("apple_user_id"), F.concat(F.lit("g"), n).alias("google_user_id"))
    return users.get_or_create(known, asked).select("request", F.col("id").alias("user_id"))


@query
def cascade_surviving(spark, sf_dir):
    parents = A.articles(spark, sf_dir).filter("id % 3 <> 0")
    return ingest.surviving(A.interactions(spark, sf_dir), parents, "article_id").groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_user_vectors(spark, sf_dir):
    """The vectors of user_embedding, kept by a stream of the interactions."""
    inter = A.interactions_of(A.table_stream(spark, sf_dir, "events"))
    liked = users.positive_articles(A.interactions(spark, sf_dir)).select(F.col("article_id").alias("id")).distinct()
    store = new_folder(spark)
    refresh_users(inter, stored(_embedded(spark, sf_dir, liked)), store, new_folder(spark)).awaitTermination()
    rows = embed.sparse(current_vectors(spark, store), ["user_id", "interaction_count"])
    return rows.select("user_id", F.col("dim").cast("bigint").alias("dim"), (F.round("w", ROUND) + 0.0).alias("w"), "interaction_count")


@query
def stream_burst_pairs(spark, sf_dir):
    """Pairs of documents from different sources that say much the same within two days,
    found by a stream."""
    flow, store = A.articles_of(A.table_stream(spark, sf_dir, "documents")), new_folder(spark)
    bursts.refresh_pairs(flow, stored(_embedded(spark, sf_dir)), store, new_folder(spark), new_folder(spark)).awaitTermination()
    rows = spark.read.schema(bursts.PAIRS).parquet(store)
    return rows.select("anchor", "id", F.round("sim", ROUND).alias("similarity"), "source")


@query
def stream_ingest_counts(spark, sf_dir):
    """Documents as a stream, taken in one go and counted by day and source."""
    from .streaming.ingest import counts_by_source

    flow = A.table_stream(spark, sf_dir, "documents")
    published = F.expr("timestampadd(HOUR, cast((doc_id * 37) % 720 as int), timestamp_ntz'2024-01-01 00:00:00')")
    counted = counts_by_source(flow.select("source", published.alias("published_at"))).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "source", "n")
    store = new_folder(spark)
    # each batch has the counts of all windows that it changed; this stream's one batch has all
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", store).parquet(store)
    last = F.max("batch").over(Window.partitionBy("day", "source"))
    return rows.withColumn("last", last).filter("batch = last").select("day", "source", "n")
