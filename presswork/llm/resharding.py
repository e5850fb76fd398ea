"""Sharding: minimum-cost-flow resharding under the law of equal row counts.

Old shards have more or fewer rows than their new capacities, which are at most one
apart. A block is a run of a shard's rows in the order of size: the rows that must leave
whatever the capacities, and the one row more that stays if the shard gets the larger
capacity. In the flow network of old shards, blocks and new shards a row's cost is its
size, so the cheapest flow moves the fewest bytes; the sizes in it are exact. The driver
sees two blocks a shard. Moved rows are found by distributed ranks, and only the files of
shards that gain or lose rows are rewritten.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, delete, small, with_keys

#: Stands for a null old shard.
NO_SHARD = 2**31 - 1
#: Rows of one shard that are ranked in one task.
ROWS_PER_BUCKET = 20_000


class Flow:
    """Cheapest flow by shortest augmenting paths with potentials; costs not negative."""

    def __init__(self, n_nodes: int):
        self.out: list[list[int]] = [[] for _ in range(n_nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for node, end, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[node].append(len(self.to))
            self.to.append(end)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """(amount, cost) of the cheapest of the largest flows."""
        n, amount, total = len(self.out), 0, 0
        high = [0] * n
        while True:
            far, via = [float("inf")] * n, [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e] and d + self.cost[e] + high[a] - high[self.to[e]] < far[self.to[e]]:
                        far[self.to[e]] = d + self.cost[e] + high[a] - high[self.to[e]]
                        via[self.to[e]] = e
                        heappush(heap, (far[self.to[e]], self.to[e]))
            if via[sink] < 0:
                return amount, total
            high = [h + min(f, far[sink]) for h, f in zip(high, far)]
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
                total += step * self.cost[e]
            amount += step


def transfers(rows: dict[int, int], shards: int, marginal: dict[tuple[int, int], int]) -> dict[int, list[tuple[int, int]]]:
    """{old shard: [(upto rank, new shard), ...]}: where each shard's smallest rows go.

    rows: row counts of the old shards; those numbered `shards` or more give up all rows.
    marginal: (old shard, k) -> size of its k-th smallest row (k from 1), for the k next
    to the rows it must give up (forced()). New row counts are at most one apart."""
    total = sum(rows.values())
    base, extra = divmod(total, shards)
    olds = sorted(set(rows) | set(range(shards)))
    source, sink, hub, spare = range(4)
    old, new = ({s: at + i for i, s in enumerate(olds)} for at in (4, 4 + len(olds)))
    flow = Flow(4 + 2 * len(olds))
    leaving, arriving = {}, {}
    for s in olds:
        n = rows.get(s, 0)
        flow.arc(source, old[s], n)
        must, may = forced(n, base, extra) if s < shards else (n, 0)
        # rows that must leave cost the same in every flow; the row more has its own size
        leaving[s] = [flow.arc(old[s], hub, must)] + ([flow.arc(old[s], hub, 1, marginal[s, must + 1])] if may else [])
    for s in range(shards):
        flow.arc(old[s], new[s], total)
        arriving[s] = flow.arc(hub, new[s], total)
        flow.arc(new[s], sink, base)
        flow.arc(new[s], spare, 1)
    flow.arc(spare, sink, extra)
    flow.run(source, sink)
    wanted = [[s, flow.used(arriving[s])] for s in range(shards)]
    out: dict[int, list[tuple[int, int]]] = {}
    for s in olds:
        at, left = 0, sum(flow.used(arc) for arc in leaving[s])
        while left:
            while not wanted[-1][1]:
                wanted.pop()
            step = min(left, wanted[-1][1])
            at, left = at + step, left - step
            wanted[-1][1] -= step
            out.setdefault(s, []).append((at, wanted[-1][0]))
    return out


def forced(n: int, base: int, extra: int) -> tuple[int, int]:
    """(rows that a shard of n rows must give up, 1 if it gives up one more with the smaller capacity)."""
    must = max(0, n - base - (1 if extra else 0))
    return must, int(bool(extra) and n > base)


def ranked(df: DataFrame, block: str, order: list[str], name: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """df with `name`: rank (from 0, no gaps) within the block by `order`; the last of
    order is hashed where many rows agree in the others, and _tie comes last.

    Rows are numbered in buckets of about rows_per_bucket, and the counts of the buckets
    before are added. Values of the coarse order with few rows are one bucket, so a
    block's counts are one row a value, or a row for each rows_per_bucket rows."""
    *coarse, fine = order
    keys = [block, *coarse]
    many = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_bucket).cast("int").alias("_buckets")).filter("_buckets > 1")
    df = df.join(small(many), keys, "left").withColumn("_bucket", F.pmod(F.xxhash64(fine), F.coalesce("_buckets", F.lit(1))).cast("int")).drop("_buckets")
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(block).orderBy(*coarse, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(fine, "_tie")
    return df.withColumn("_row", F.row_number().over(inside)).join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_bucket", "_row", "_before")


def kth_sizes(sizes: DataFrame, wanted: dict[int, set[int]]) -> dict[tuple[int, int], int]:
    """{(shard, k): size of the shard's k-th smallest row} from (old_shard, class, size, n).
    Size classes narrow the search, so that no shard's sizes are added up in one task."""
    if not wanted:
        return {}
    spark = sizes.sparkSession
    asked = spark.createDataFrame([(s, k) for s, ks in wanted.items() for k in ks], "old_shard int, k long")
    byclass = sizes.groupBy("old_shard", "class").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("old_shard").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    place = byclass.withColumn("upto", upto).join(F.broadcast(asked), "old_shard").filter("k <= upto and k > upto - n")
    hit = sizes.join(F.broadcast(place.select("old_shard", "class", "k", (F.col("upto") - F.col("n")).alias("below"))), ["old_shard", "class"])
    upto = F.sum("n").over(Window.partitionBy("old_shard", "class", "k").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    found = hit.withColumn("upto", F.col("below") + upto).filter("k <= upto and k > upto - n")
    return {(r.old_shard, r.k): r.size for r in found.select("old_shard", "k", "size").collect()}  # one a shard


def assign(docs: DataFrame, old_shard: Column, shards: int = 16, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc, tid (the row's keys), number, doc_id, size, text_crc32, old_shard, shard, slot of
    every row; number tells equal rows apart. Row counts of the shards are at most one
    apart, slots run from 0 without gaps in the order of hash buckets of doc_id, and no
    other choice moves fewer bytes.

    Size is the text's UTF-8 bytes plus 1, and a null text has none. A null doc_id or
    old shard is a value like others (the latter counts as a shard that is given up).
    Repeated rows and ties in size are ranked by doc_id, then the text's name; rows equal
    in these are alike, so either may have either place. No rows give none; columns of
    other names play no part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    given = F.coalesce(old_shard.cast("int"), F.lit(NO_SHARD))
    rows = with_keys(docs.select("doc_id", "text", given.alias("old_shard"))).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        "old_shard",
        F.col("__doc").alias("_id"),
        F.col("__tid").alias("_tie"),
    )
    sizes = rows.groupBy("old_shard", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int"))
    counts = {r.old_shard: r.n for r in sizes.groupBy("old_shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    base, extra = divmod(sum(counts.values()), shards)
    wanted = {s: {must + 1} for s, n in counts.items() if s < shards for must, may in [forced(n, base, extra)] if may}
    moves = transfers(counts, shards, kth_sizes(sizes, wanted))
    spark = docs.sparkSession
    plan = spark.createDataFrame(sorted(moves.items()), "old_shard int, goes array<struct<upto:long,shard:int>>")
    placed = ranked(rows, "old_shard", ["size", "_id"], "_rank", rows_per_bucket).join(F.broadcast(plan), "old_shard", "left")
    # goes is in order of rank: the first entry that reaches beyond this row's
    new = F.expr("coalesce(try_element_at(filter(goes, g -> _rank < g.upto), 1).shard, old_shard)")
    placed = placed.withColumn("shard", new).drop("_rank", "goes")
    placed = ranked(placed, "shard", ["_id"], "slot", rows_per_bucket)
    number = F.row_number().over(Window.partitionBy("_id", "_tie").orderBy("shard", "slot"))
    return placed.select(F.col("_id").alias("doc"), F.col("_tie").alias("tid"), number.alias("number"), "doc_id", "size", "text_crc32", "old_shard", "shard", F.col("slot").cast("long").alias("slot"))


def rewrite(docs: DataFrame, old_shard: Column, path: str, shards: int = 16, placed: DataFrame | None = None) -> list[int]:
    """Writes the shards that gain or lose rows to path/shard=N (Parquet, with the slot as
    a column; a task writes one file for each shard, by slot), leaving the folders of other
    shards there alone. When the new files stand, the folders of shards that have given up
    all rows go; if that is broken off, it is made good by calling again with the same
    `placed`. Returns the numbers of the shards written. placed: assign()'s rows, if made before. Texts are
    exchanged once, or twice if some rows are equal. Every row of docs is written once,
    whatever its doc_id; columns of docs named shard or slot are replaced."""
    placed = Scratch(docs.sparkSession).save(assign(docs, old_shard, shards)) if placed is None else placed
    changed = placed.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    affected = sorted(r[0] for r in changed.collect() if 0 <= r[0] < shards)  # bounded: the number of shards
    rest = [c for c in docs.columns if c not in ("shard", "slot")]
    given = with_keys(docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), "doc_id", "text")).select("_row", "__doc", "__tid")
    goes = placed.filter(F.col("shard").isin(affected)).select(F.col("doc").alias("__doc"), F.col("tid").alias("__tid"), F.col("number").alias("_number"), "shard", "slot")
    if placed.filter("number > 1").isEmpty():
        rows = given.join(goes.drop("_number"), ["__doc", "__tid"])
    else:  # rows that are alike are numbered here too, at the price of one more exchange
        number = F.row_number().over(Window.partitionBy("__doc", "__tid").orderBy(F.xxhash64("_row")))
        rows = given.withColumn("_number", number).join(goes, ["__doc", "__tid", "_number"])
    rows = rows.select("_row.*", "shard", "slot")
    writer = rows.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy("shard").parquet(path)
    written = {r.shard for r in goes.select("shard").distinct().collect()}
    for shard in {r[0] for r in changed.collect()} - written:  # bounded: the number of shards
        delete(docs.sparkSession, f"{path}/shard={'__HIVE_DEFAULT_PARTITION__' if shard == NO_SHARD else shard}")
    return affected


def by_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's columns, of rows read back: old shards are hashes of the source, as a
    table laid out by source has them, so that a source with many rows makes a shard too
    large. Affected shards are rewritten in the shared folder, and size and checksum
    of their rows are those of the files; the other shards stay as they are."""
    old = F.pmod(F.xxhash64(F.col("source")), F.lit(shards))
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", "source")
    placed = scratch.save(assign(docs, old, shards))
    path = f"{scratch.root}/shards"
    affected = rewrite(docs, old, path, shards, placed)
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    same = placed.filter(~F.col("shard").isin(affected)).select(*names)
    if affected:
        text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
        schema = docs.select("doc_id", "text", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("shard")).schema
        files = docs.sparkSession.read.schema(schema).parquet(path)
        read = files.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "shard", "slot")
        same = same.unionByName(read)
    return same.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
