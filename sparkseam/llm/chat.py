r"""Chat formatting of reply trees.

Nodes (tree, node, parent, score) form forests. Pointer doubling, an iterative self-join of each node's jump on the
jumps themselves, gives every leaf its root and its path score in log2(depth) rounds. Leaves are ranked within their
tree by path score; the best `paths` leaves are walked back to their roots by the same doubled jumps, so only nodes of
chosen paths are listed, and each path becomes one conversation string.

Template: `<|im_start|>role<|im_sep|>text<|im_end|>` for each turn. Backslashes inside roles and texts are doubled and
every control string gets a backslash after its first character, so no control string stands in a text; taking the
character after each backslash undoes both.

Defined results: null text is empty and null role the empty role; null is a tree like any other. A parent that doesn't
exist makes a root; nodes on a parent cycle have no root and are left out, and so are nodes whose id is null. Equal
scores: the smaller leaf wins. Rows that repeat a node are one node with the smallest parent, the largest score, and the
smallest role and text; the query numbers repeated turns by role and text, so all of them stay. Very long texts are
formatted whole; one conversation's text must fit a row. An empty table gives an empty result. Only the named columns
are read, so other columns' names can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseam.operators.ranges import row_numbers
from sparkseam.session import materialise

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that must not stand unescaped in a text.
CONTROLS = [START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    # longer strings first: <<SYS>> holds no other, and none holds another's beginning
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def root_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """tree, leaf, rank, node, depth (0 at the root) of the best root-to-leaf paths. nodes: tree, node, parent, score."""
    # in a struct a null tree equals itself in joins
    nodes = nodes.filter("node is not null").select(F.struct("tree").alias("tree"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = materialise(nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score")), "nodes")
    here = nodes.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    known = nodes.join(here, ["tree", "parent"], "left").select("tree", "node", "up", "score")
    # jump k: from a node 2^k steps up; total: the score of the nodes passed, the node itself included
    jumps = [materialise(known.select("tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "jump0")]
    parents = known.filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    bound = nodes.count()
    rooted = jumps[0].filter("up is null")
    while not jumps[-1].filter("up is not null").isEmpty() and 2 ** len(jumps) <= 2 * bound:
        # nodes whose jump has passed the root are done and leave the rounds
        live = jumps[-1].filter("up is not null")
        done = rooted.select("tree", F.col("node").alias("up"), F.lit(None).cast(nodes.schema["node"].dataType).alias("_up"),
            F.col("total").alias("_total"), F.col("steps").alias("_steps"))
        next_ = live.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"),
            F.col("steps").alias("_steps")).unionByName(done)
        step = live.join(next_, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
            (F.col("steps") + F.col("_steps")).alias("steps"))
        jumps.append(materialise(step, f"jump{len(jumps)}"))
        rooted = rooted.unionByName(jumps[-1].filter("up is null"))
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    best = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))).filter(F.col("rank") <= paths)
    spread = materialise(best.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("steps") - 1).alias("depth")), "walk")
    # with the largest jump first, each round doubles the listed part of every path
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].filter("up is not null").select("tree", "node", "up")
        if k == len(jumps) - 1 and j.isEmpty():
            continue
        more = spread.join(j, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        spread = materialise(spread.unionByName(more), f"walk{k}")
    return spread.select(F.col("tree")["tree"].alias("tree"), "leaf", "rank", "node", "depth")


def format_paths(paths: DataFrame, turns: DataFrame) -> DataFrame:
    """tree, leaf, rank, formatted, loss_spans (start, end in code points of formatted). turns: tree, node, role, text."""
    said = turns.filter("node is not null").select(F.struct("tree").alias("tree"), "node", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    said = said.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("_said")).select("tree", "node",
        F.col("_said")["role"].alias("role"), escape(F.col("_said")["text"]).alias("text"))
    rows = paths.withColumn("tree", F.struct("tree")).join(said, ["tree", "node"])
    each = F.struct("depth", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"), "text", (F.col("role") == "assistant").alias("loss"))
    # a conversation is one output row, so its turns meet in one task; only the chosen paths' turns are gathered
    rows = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(each)).alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def walk(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["head"])
        e = s + F.length(x["text"])
        return F.struct((e + len(END)).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(s.cast("long").alias("start"),
            e.cast("long").alias("end"))))).otherwise(a["spans"]).alias("spans"))

    return rows.select(F.col("tree")["tree"].alias("tree"), "leaf", "rank", formatted.alias("formatted"), F.aggregate("t", zero, walk,
        lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(formatted, re.escape(START)), lambda x, i: i > 0)
    return F.transform(turns, lambda x: F.struct(unescape(F.substring_index(x, SEP, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x,
        SEP, -1), END, 1)).alias("text")))


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chains: each turn replies to the turn before it."""
    fixed = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0,
        "user").otherwise("assistant").alias("role"), F.lit(fixed).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    # numbered in ranges of the global order, so a conversation with many turns is in several tasks; the number before a
    # conversation's first turn is no node of it, which makes that turn the root
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn"), F.col("role"), F.col("text")]
    rows = materialise(row_numbers(rows, order, "node").select(F.col("conv_id").alias("tree"), "node", "role", "text"), "turns")
    nodes = rows.select("tree", "node", (F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"))
    done = format_paths(root_paths(nodes), rows)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1,
        (s["end"] - s["start"]).cast("int")))), "")
    back = done.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias(
            "formatted_chars"),
    )


def _escape_sql(x: str) -> str:
    out = f"replace(coalesce({x}, ''), '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, * from (values (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v(turn, role, text)),
b as (select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
  coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
  sum(length({_escape_sql('role')}) + length({_escape_sql('text')}) + {len(START + SEP + END)})::bigint as formatted_chars from a group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from b
"""
