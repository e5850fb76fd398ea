"""Chat formatting: reply trees to training conversations.

Root-to-leaf paths come from iterative self-joins that double their reach each round
(the 2**k-th ancestor of every node), so a chain of n replies takes log2(n) rounds, not
n. Leaves are ranked by the score of their path; the nodes of the chosen paths are
gathered by going back through the same tables.

Template, one block a turn:  ### role:\\n text </turn>\\n   (no spaces added). Backslash, #
and < inside texts, and : inside roles too, get a backslash in front, so control strings
never occur in them and reading takes it off again.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import NO_ID, Scratch

ROLE_LEARNED = "assistant"
_block = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*):\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"[\\#<:]" if role else r"[\\#<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(conversation, loss mask: spans of code points that hold the learned role's texts)."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, True)}:\n", escape(text)
        if role == ROLE_LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), mask


def read(conversation: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(conversation):
        found = _block.match(conversation, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def best_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, place) of the `paths` best root-to-leaf paths of each tree:
    those of the highest sum of scores; of equal ones the longer, then the one whose
    leaf has the smaller id. nodes: tree, node (unique in its tree), parent (null, or
    unknown, for a root), score (null: 0), all but score long. Place 0 is the root. Rows with
    a null tree or node are left out. A tree in which replies go round in a circle has one row
    with nulls beside its name; the others have their paths all the same."""
    scratch = Scratch(nodes.sparkSession)
    nodes = nodes.filter("tree is not null and node is not null")
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = scratch.save(nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent"))
    start = nodes.select("tree", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    start = start.join(links, ["tree", "node"], "left").select("tree", "node", F.col("parent").alias("up"), "total", F.lit(1).cast("long").alias("length"))
    first = scratch.save(start)
    # up: the 2**k-th ancestor; total and length are of the 2**k nodes from here up. Rows that
    # have come to the root are done and aren't joined again.
    done, active, reach = [first.filter("up is null")], first.filter("up is not null"), []
    longest = (nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0).bit_length()
    broken = None
    while not active.isEmpty():
        if len(reach) > longest:  # a path of more nodes than the tree has: the replies go round in a circle
            broken = scratch.save(active.select("tree").distinct())
            break
        reach.append(active)
        state = reduce(DataFrame.unionByName, [*done, active])
        over = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("length").alias("further"))
        step = active.join(over, ["tree", "up"])
        step = scratch.save(step.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("further")).alias("length")))
        done.append(step.filter("up is null"))
        active = step.filter("up is not null")
    # written before the anti-join, which the optimizer would else push into each part of the union
    whole = scratch.save(reduce(DataFrame.unionByName, done))
    if broken is not None:
        whole = scratch.save(whole.join(broken, "tree", "left_anti"))
    leaves = whole.join(links.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("length"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= paths)
    found = scratch.save(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("length") - 1).alias("place")))
    for k in range(len(reach) - 1, -1, -1):
        back = reach[k].select("tree", "node", "up")
        found = scratch.save(found.union(found.join(back, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"))))
    if broken is not None:
        found = found.unionByName(broken, allowMissingColumns=True)
    return found


def format_trees(nodes: DataFrame, paths: int = 1, unique: bool = False) -> DataFrame:
    """(tree, rank, leaf, conversation, mask) of the chosen paths. nodes as in best_paths,
    with role and text (null: empty). Of several rows of one node the smallest is taken
    (by parent, score, role, text); unique=True says that there are none. One
    conversation, however long, is gathered in one row, as it is one text; other columns
    play no part, and no nodes give no rows. A tree whose replies go round in a circle is one
    row without a conversation."""
    common.ship(nodes.sparkSession)
    if not unique:
        row = F.min(F.struct("parent", F.col("score").cast("double").alias("score"), "role", "text")).alias("row")
        nodes = nodes.filter("tree is not null and node is not null").groupBy("tree", "node").agg(row).select("tree", "node", "row.*")
    chosen = best_paths(nodes, paths)
    turns = chosen.join(nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    gathered = turns.groupBy("tree", "rank", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            text, mask = zip(*made) if made else ((), ())
            spans = pa.array([[{"start": a, "stop": b} for a, b in m] for m in mask], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            columns = [batch.column("tree"), batch.column("rank"), batch.column("leaf"), pa.array(text, pa.string()), spans]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "rank", "leaf", "conversation", "mask"])

    made = gathered.mapInArrow(run, "tree long, rank int, leaf long, conversation string, mask array<struct<start:int,stop:int>>")
    return made.unionByName(chosen.filter("rank is null").select("tree"), allowMissingColumns=True)


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row answers
    the one before it, by turn (null turns first); equal turns are taken by role, then
    text, and repeated rows are turns of their own. A null conv_id is a conversation of
    its own; null roles and texts are empty."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from conversations and masks: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Rows without a conversation are left out."""
    common.ship(formatted.sparkSession)
    formatted = formatted.filter("conversation is not null")

    def run(batches):
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for text, mask in zip(batch.column("conversation").to_pylist(), batch.column("mask").to_pylist()):
                turns = read(text)
                learned = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
                out.append((len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(learned), sha(learned), len(text)))
            columns = list(zip(*out)) if out else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), *(pa.array(c, t) for c, t in zip(columns, types))], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    made = formatted.select("tree", "conversation", "mask").mapInArrow(run, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return made.select(common.doc_id_of("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations plus conversation -7, whose two turns hold the template's control strings."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
  sum(14 + 2 * length(r) - length(regexp_replace(r, '[\\#<:]', '', 'g')) + 2 * length(t) - length(regexp_replace(t, '[\\#<]', '', 'g')))::bigint formatted_chars
from c group by conv_id
"""
