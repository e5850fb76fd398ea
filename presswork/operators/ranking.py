"""Features, training sets and models of the rerankers."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.dates import freshness_days
from ..functions.scores import source_quality
from ..shipping import ship
from . import users as U
from .blocks import Vectors, gathered, lists, with_vectors
from .embed import dense
from .explain import topic_scores
from .listing import latest_per_user
from .storage import small, stored

#: The features' names and order.
FEATURES = [
    "user_item_cosine",
    "user_item_dot",
    "user_interaction_count",
    "user_avg_read_time",
    "user_bookmark_rate",
    "user_like_rate",
    "freshness",
    "popularity",
    "source_quality",
    "has_doi",
    "has_embedding",
    "user_topic_aff",
    "user_source_aff",
]
#: Of train_gbt(): at most 500 rounds at a rate of 0.05; depth 6 has room for 63 leaves.
PRODUCTION = {"rounds": 500, "depth": 6, "rate": 0.05}


def features(pairs: DataFrame, articles: DataFrame, interactions: DataFrame, embedded: DataFrame, entities: DataFrame, as_of: datetime, vectors: DataFrame | None = None) -> DataFrame:
    """pairs (user_id, id, ...) with the thirteen features. Cosine and dot are of the
    user's and the article's vectors, 0 where one is missing. vectors: the users', if they
    have been made before."""
    people = pairs.select("user_id").distinct()
    vectors = U.dense_vectors(interactions.join(people, "user_id", "left_semi"), embedded) if vectors is None else vectors
    facts = articles.select("id", "source", "doi", "published_at").join(U.popularity(interactions).withColumnRenamed("article_id", "id"), "id", "left")
    facts = stored(facts.join(embedded.select("id").distinct().withColumn("_e", F.lit(1.0)), "id", "left"))
    out = with_products(pairs, vectors, embedded).join(small(facts), "id").join(small(stored(U.stats(interactions))), "user_id", "left")
    out = out.join(topic_scores(pairs, entities, U.topic_affinity(interactions, entities, articles)), ["user_id", "id"], "left")
    out = out.join(U.source_affinity(interactions, articles), ["user_id", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out.select(
        *pairs.columns,
        zero("s").alias("user_item_cosine"),
        zero("s").alias("user_item_dot"),  # both vectors have length 1
        zero("interaction_count").alias("user_interaction_count"),
        zero("avg_read_time").alias("user_avg_read_time"),
        zero("bookmark_rate").alias("user_bookmark_rate"),
        zero("like_rate").alias("user_like_rate"),
        freshness_days(F.col("published_at"), as_of).alias("freshness"),
        zero("popularity").alias("popularity"),
        source_quality(F.col("source")).alias("source_quality"),
        F.col("doi").isNotNull().cast("double").alias("has_doi"),
        zero("_e").alias("has_embedding"),
        zero("topic_aff").alias("user_topic_aff"),
        zero("share").alias("user_source_aff"),
    )


def with_products(pairs: DataFrame, vectors: DataFrame, embedded: DataFrame) -> DataFrame:
    """pairs (user_id, id, ...) with `s`, the product of the user's and the article's vectors,
    null where one is missing; a block of users gets each article's vector once."""
    rows = gathered(pairs, "p").select("user_id", "p").join(dense(vectors, "user_id"), "user_id", "left")
    schema = StructType([*pairs.schema.fields]).add("s", "double")
    return with_vectors(rows, F.when(F.col("dims").isNotNull(), F.col("p.id")), embedded, _products, schema)


def _products(rows: pa.Table, articles: pa.Table) -> pa.Table:
    known, (pairs, ends) = Vectors(articles), lists(rows.column("p"))
    (dims, at), (ws, _) = lists(rows.column("dims")), lists(rows.column("ws"))
    places, dims, ws = known.places(pairs.field("id").to_numpy()), dims.to_numpy(), ws.to_numpy()
    out, missing = np.zeros(len(pairs)), np.ones(len(pairs), bool)
    for i in range(len(rows)):
        asked = np.arange(ends[i], ends[i + 1])
        asked = asked[places[asked] >= 0]
        if len(asked) and at[i + 1] > at[i]:
            mine = np.zeros(max(known.width, int(dims[at[i] : at[i + 1]].max()) + 1))
            mine[dims[at[i] : at[i + 1]]] = ws[at[i] : at[i + 1]]
            row, d, w = known.entries(places[asked])
            out[asked], missing[asked] = np.bincount(row, weights=w * mine[d], minlength=len(asked)), False
    return pa.table([*pairs.flatten(), pa.array(out, mask=missing)], names=[*[f.name for f in pairs.type], "s"])


def two_tower_pairs(interactions: DataFrame, embedded: DataFrame, least: int = 5, limit: int = 100, count_limit: int = 200) -> DataFrame:
    """(user_id, id): up to `limit` latest positive, embedded articles of users with
    enough interactions."""
    enough = latest_per_user(interactions, count_limit).groupBy("user_id").count().filter(F.col("count") >= least).select("user_id")
    liked = latest_per_user(interactions, limit).select("user_id", F.col("article_id").alias("id"))
    return liked.join(enough, "user_id", "left_semi").join(embedded.select("id").distinct(), "id", "left_semi").distinct()


def reranker_pairs(interactions: DataFrame, articles: DataFrame, embedded: DataFrame, least: int = 10, limit: int = 200, pool: int = 200, seed: int = 42) -> DataFrame:
    """(user_id, id, label): each user's positives, and as many negatives drawn by hash
    from the `pool` newest embedded articles that aren't among them."""
    has = embedded.select("id").distinct()
    enough = latest_per_user(interactions, limit).groupBy("user_id").count().filter(F.col("count") >= least).select("user_id")
    positive = stored(latest_per_user(interactions, limit).select("user_id", F.col("article_id").alias("id")).distinct().join(enough, "user_id", "left_semi").join(has, "id", "left_semi"))
    most = limit + pool  # a user's positives can hide at most `limit` of the newest, and no more than there are
    newest = stored(articles.join(has, "id", "left_semi").orderBy(F.desc_nulls_last("published_at"), "id").limit(most).select("id", "published_at"))
    placed = newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("published_at"), "id")) - 1)  # `most` rows
    counts = positive.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    offered = counts.select("user_id", "n", F.explode(F.sequence(F.lit(0), (F.col("n") + (pool - 1)).cast("int"))).alias("place")).join(small(placed), "place").drop("place")
    free = offered.join(positive, ["user_id", "id"], "left_anti")
    by_time = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("published_at"), "id")
    drawn = Window.partitionBy("user_id").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "user_id", "id"), 256), "id")
    negative = free.withColumn("t", F.row_number().over(by_time)).filter(F.col("t") <= pool).withColumn("d", F.row_number().over(drawn)).filter("d <= n")
    return positive.withColumn("label", F.lit(1)).unionByName(negative.select("user_id", "id", F.lit(0).alias("label")))


def split(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `test`: a repeatable random fifth, by hash of the keys."""
    name = F.sha2(F.concat_ws(":", F.lit("test"), F.lit(seed), *keys), 256)
    return df.withColumn("test", F.conv(F.substring(name, 1, 8), 16, 10).cast("bigint") % 1000 < int(1000 * test_share))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _assembled(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in FEATURES])))


def train_gbt(train: DataFrame, rounds: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 42):
    """Gradient-boosted trees on rows of features() with label and test; training stops
    when the test rows gain no more. Returns the model."""
    from pyspark.ml.classification import GBTClassifier

    rows = _assembled(train).select("features", F.col("label").cast("double").alias("label"), "test")
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, validationIndicatorCol="test").fit(rows)


def importance(model) -> dict[str, float]:
    return dict(zip(FEATURES, model.featureImportances.toArray().tolist()))


def auc(model, rows: DataFrame) -> float:
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = model.transform(_assembled(rows).withColumn("label", F.col("label").cast("double")))
    return BinaryClassificationEvaluator().evaluate(scored)


def predict(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_assembled(rows))
    return scored.withColumn("rerank", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def enhanced(retrieved: DataFrame, rows: DataFrame, model, limit: int = 20, blend: float = 0.7) -> DataFrame:
    """(user_id, id, score, rn) of retrieved (user_id, id, sim): 0.3 of the similarity and
    0.7 of the model's probability; without a model, the similarity."""
    if model is None:
        scored = retrieved.withColumn("score", F.col("sim"))
    else:
        scored = retrieved.join(predict(model, rows).select("user_id", "id", "rerank"), ["user_id", "id"]).withColumn("score", (1 - blend) * F.col("sim") + blend * F.col("rerank"))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rn", rn).filter(F.col("rn") <= limit).select("user_id", "id", F.round("score", 6).alias("score"), F.col("rn").cast("bigint").alias("rn"))


class Tower:
    """Linear, batch norm, ReLU and dropout for each hidden layer, a last linear one, and
    rows of length 1, with gradients, in numpy."""

    def __init__(self, sizes: list[int], dropout: float, rng: np.random.Generator):
        self.dropout, self.rng = dropout, rng
        bound = lambda n: n**-0.5
        self.w = [rng.uniform(-bound(a), bound(a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(n) for n in sizes[1:]]
        self.scale, self.shift = ([np.full(n, x) for n in sizes[1:-1]] for x in (1.0, 0.0))
        self.mean, self.var = ([np.full(n, x) for n in sizes[1:-1]] for x in (0.0, 1.0))

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.b, *self.scale, *self.shift]

    def forward(self, x: np.ndarray, train: bool = False) -> np.ndarray:
        self.kept = []
        for i in range(len(self.scale)):
            z = x @ self.w[i] + self.b[i]
            if train:
                mean, var = z.mean(axis=0), z.var(axis=0)
                n = len(z)
                self.mean[i] = 0.9 * self.mean[i] + 0.1 * mean
                self.var[i] = 0.9 * self.var[i] + 0.1 * var * n / max(1, n - 1)
            else:
                mean, var = self.mean[i], self.var[i]
            spread = np.sqrt(var + 1e-5)
            unit = (z - mean) / spread
            y = self.scale[i] * unit + self.shift[i]
            on = y > 0
            if train and self.dropout:
                on = on * (self.rng.random(y.shape) >= self.dropout) / (1 - self.dropout)
            self.kept.append((x, unit, spread, on))
            x = y * on
        z = x @ self.w[-1] + self.b[-1]
        length = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        self.last = x, z / length, length
        return z / length

    def backward(self, g: np.ndarray) -> list[np.ndarray]:
        """Gradients of parameters(), after forward(train=True); g: of its result."""
        x, out, length = self.last
        g = (g - out * (g * out).sum(axis=1, keepdims=True)) / length
        w, b, scale, shift = [x.T @ g], [g.sum(axis=0)], [], []
        g = g @ self.w[-1].T
        for i in range(len(self.scale) - 1, -1, -1):
            x, unit, spread, on = self.kept[i]
            g = g * on
            scale.insert(0, (g * unit).sum(axis=0))
            shift.insert(0, g.sum(axis=0))
            g = g * self.scale[i]
            g = (g - g.mean(axis=0) - unit * (g * unit).mean(axis=0)) / spread
            w.insert(0, x.T @ g)
            b.insert(0, g.sum(axis=0))
            g = g @ self.w[i].T
        return [*w, *b, *scale, *shift]


class TwoTower:
    """A user and an item tower, trained with a symmetric in-batch contrastive loss by AdamW. Rows of
    users and items that are trained on are bounded by the caller; embedding is a Spark job."""

    def __init__(self, dim: int = 768, hidden: tuple[int, ...] = (512, 256), out: int = 128, dropout: float = 0.1, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.user, self.item = (Tower([dim, *hidden, out], dropout, rng) for _ in range(2))

    def fit(self, users: np.ndarray, items: np.ndarray, epochs: int = 15, batch: int = 256, rate: float = 1e-3, decay: float = 1e-4, temperature: float = 0.07, seed: int = 42) -> list[float]:
        """Losses by epoch. Row i of users and items is a positive pair; the other rows
        of its batch are the negatives."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        params = self.user.parameters() + self.item.parameters()
        m, v = ([np.zeros_like(p) for p in params] for _ in range(2))
        softmax = lambda x: (e := np.exp(x - x.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)
        for _ in range(epochs):
            order, total = rng.permutation(len(users)), 0.0
            for at in range(0, len(order), batch):
                k = order[at : at + batch]
                if len(k) < 2:  # no negatives, and no spread for the batch norm
                    continue
                a, b = self.user.forward(users[k], True), self.item.forward(items[k], True)
                p, q = softmax(a @ b.T / temperature), softmax(b @ a.T / temperature)
                total -= (np.log(np.diag(p) + 1e-12) + np.log(np.diag(q) + 1e-12)).sum() / 2
                g = (p + q.T - 2 * np.eye(len(k))) / (2 * len(k) * temperature)
                step += 1
                for i, (x, d) in enumerate(zip(params, self.user.backward(g @ b) + self.item.backward(g.T @ a))):
                    m[i] += 0.1 * (d - m[i])
                    v[i] += 0.001 * (d * d - v[i])
                    x -= rate * (m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8) + decay * x)
            losses.append(total / max(1, len(order)))
        return losses

    def embed(self, vectors: DataFrame, side: str = "item", key: str = "id") -> DataFrame:
        """(key, embedding) of (key, dims, ws) rows."""
        ship(vectors.sparkSession)
        tower = self.item if side == "item" else self.user
        tower.kept, tower.last, width = [], (), len(tower.w[0])

        def run(frames):
            for frame in frames:
                x = np.zeros((len(frame), width))
                for i, (d, w) in enumerate(zip(frame["dims"], frame["ws"])):
                    x[i, d] = w
                yield pd.DataFrame({key: frame[key].to_numpy(), "embedding": list(tower.forward(x))})

        return vectors.select(key, "dims", "ws").mapInPandas(run, f"{key} bigint, embedding array<double>")
