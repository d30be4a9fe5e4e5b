"""Chat formatting: reply trees to conversations, DataFrame functions only.

A reply tree's nodes name their parents.  Iterative self-joins follow the links
by doubling: after k rounds a node knows its ancestor 2^k steps up and the score
and length of the way there, so the longest thread costs a logarithmic number of
rounds.  Leaves are ranked in their tree by the mean score of their path; the
same links, read back from the largest step to the smallest, enumerate the nodes
of each chosen path.  Only ids move in these rounds; texts join once at the end.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  In roles and
texts a backslash is doubled and a control string gets one inside, so nothing in
them reads as a mark and ``parse`` gives them back exactly.

Nulls and edge cases: a null text or role is empty; a parent that is not in the
table makes its child a root; nodes on or under a cycle belong to no path;
repeated node ids are reduced to one (the smallest role, text); ties in score go
to the longer path, then the smaller leaf id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import table

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
_END_PATTERN = r"<\|im_end\|>\n"
_CONTROL = r"(?<=<)(?=\|[A-Za-z_]+\|>|/?s>|</?SYS>>)|(?<=\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", r"\\N")


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\N", "$1\n"))


def _ways(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """For every node on no cycle its root, the score and length of its path; and the link tables by step 2^k."""
    real = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    now = table(
        nodes.join(real, "parent_id", "left").select(
            "node_id",
            F.when(F.col("known"), F.col("parent_id")).alias("up"),
            F.when(F.col("known"), None).otherwise(F.col("node_id")).alias("root_id"),
            F.col("score").alias("total"),
            F.lit(1).cast("long").alias("length"),
        ),
        "chat-links",
    )
    steps, rounds = [], max(1, now.count()).bit_length() + 1
    for _ in range(rounds):  # a path without a cycle is shorter than the table
        links = now.where(F.col("up").isNotNull())
        if links.isEmpty():
            break
        steps.append(links.select("node_id", "up"))
        there = now.select(
            F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("root_id").alias("root2"),
            F.col("total").alias("total2"), F.col("length").alias("length2"),
        )
        now = table(
            links.join(there, "up")
            .select(
                "node_id", F.col("up2").alias("up"), F.col("root2").alias("root_id"),
                (F.col("total") + F.col("total2")).alias("total"), (F.col("length") + F.col("length2")).alias("length"),
            )
            .unionByName(now.where(F.col("up").isNull())),
            "chat-links",
        )
    return now.where(F.col("root_id").isNotNull()), steps


def best_paths(nodes: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """``leaf_id, node_id, place, rank`` of the chosen paths: the ``per_tree`` best of each root (None: all).

    ``nodes``: node_id, parent_id, score.
    """
    ways, steps = _ways(nodes)
    leaves = ways.join(nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null"), "node_id", "left_anti")
    order = Window.partitionBy("root_id").orderBy((F.col("total") / F.col("length")).desc(), F.col("length").desc(), "node_id")
    chosen = leaves.withColumn("rank", F.row_number().over(order))
    if per_tree is not None:
        chosen = chosen.where(F.col("rank") <= per_tree)
    path = table(chosen.select(F.col("node_id").alias("leaf_id"), "node_id", "rank"), "chat-paths")
    for links in reversed(steps):
        path = table(path.unionByName(path.join(links, "node_id").select("leaf_id", F.col("up").alias("node_id"), "rank")), "chat-paths")
    return path.join(ways.select("node_id", F.col("length").alias("place")), "node_id")


def format_trees(nodes: DataFrame, per_tree: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree_id, leaf_id, rank, n_turns, formatted, loss_spans``.

    ``nodes``: tree_id, node_id, parent_id, role, text, score.  A span of
    ``loss_spans`` is (turn, begin, end), code points within the turn's own
    segment of ``formatted``; segments end with ``END``.
    """
    one = F.min(F.struct("tree_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent_id", "score"))
    nodes = table(nodes.groupBy("node_id").agg(one.alias("n")).select("node_id", "n.*"), "chat-nodes")
    paths = best_paths(nodes.select("node_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), per_tree)
    turns = (
        paths.join(nodes.select("node_id", "tree_id", "role", "text"), "node_id")
        .groupBy("leaf_id", "rank")
        .agg(F.first("tree_id").alias("tree_id"), F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    )
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    pieces = turns.select(
        "tree_id", "leaf_id", "rank",
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))).alias("p"),
    )
    spans = F.filter(
        F.transform(
            "p",
            lambda x, k: F.struct(
                k.alias("turn"), F.length(x["head"]).alias("begin"), (F.length(x["head"]) + F.length(x["body"])).alias("end"), x["loss"].alias("loss")
            ),
        ),
        lambda s: s["loss"],
    )
    return pieces.select(
        "tree_id", "leaf_id", "rank",
        F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["turn"].alias("turn"), s["begin"].alias("begin"), s["end"].alias("end"))).alias("loss_spans"),
    )


def segments(formatted: Column) -> Column:
    """The turns' segments, without their end marks."""
    cut = F.split(formatted, _END_PATTERN, -1)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def parse(segment: Column) -> Column:
    """Role and text of a segment, as they were."""
    pattern = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)$"
    return F.struct(
        _unescape_role(F.regexp_extract(segment, pattern, 1)).alias("role"), unescape(F.regexp_extract(segment, pattern, 2)).alias("text")
    )


def loss_texts(parts: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask, from the segments."""
    return F.transform(
        loss_spans, lambda s: unescape(F.substring(F.get(parts, s["turn"]), s["begin"] + 1, s["end"] - s["begin"]))
    )


def nodes_of_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linear conversations as trees: each turn answers the one before it."""
    order = Window.partitionBy(id_col).orderBy(turn_col, "role", "text")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return turns.select(id_col, "role", "text", F.row_number().over(order).alias("k")).select(
        F.col(id_col).alias("tree_id"),
        F.concat_ws(":", key, F.format_string("%010d", "k")).alias("node_id"),
        F.when(F.col("k") > 1, F.concat_ws(":", key, F.format_string("%010d", F.col("k") - 1))).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
