"""Chat formatting of reply trees, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.shared import cut, forget

#: A turn is OPEN, the role, MIDDLE, the text, CLOSE. Escapes make sure that none of "#", "<" and, in a role, a line
#: end stands in what is written between them, so the marks can't be taken for text nor text for marks.
OPEN, MIDDLE, CLOSE = "### ", ":\n", "</turn>\n"
TEXT_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, ("\n", "\\n"))


def escape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    """Control strings out of a text; the backslash comes first, so that every later one leads an escape."""
    for char, instead in escapes:
        text = F.replace(text, F.lit(char), F.lit(instead))
    return text


def unescape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    """The inverse: the backslash comes last, so that those it brings back lead no escape."""
    for char, instead in reversed(escapes):
        text = F.replace(text, F.lit(instead), F.lit(char))
    return text


def reply_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: path_id (the leaf's id), tree_id, rank, depth, and every column of nodes.

    nodes: tree_id, id (unique in its tree), parent_id (null: a root), score, and any others. A parent that isn't in
    the tree makes a root too; nodes on a cycle lie on no path. Branches are ranked within their tree by the mean
    score of their nodes (null scores count as 0), ties to the smaller leaf id; the first `keep` are chosen. Of rows
    that share tree_id and id the one whose other columns sort least counts.

    Iterated self-joins double what is known: after round j each node knows its ancestor 2 ** j steps up and the sum
    of scores in between, and at the end a chosen leaf's path grows from the ends in the same way. A node that has
    reached its root takes part in later rounds only as an ancestor. Rounds follow the logarithm of the deepest tree,
    and joins are on single nodes, so that a huge tree is spread out like any rows.
    """
    spark = nodes.sparkSession
    if nodes.groupBy("tree_id", "id").count().where("count > 1").limit(1).count():
        least = nodes.groupBy("tree_id", "id").agg(F.min(F.struct(*(c for c in nodes.columns if c not in ("tree_id", "id")))).alias("_row"))
        nodes = cut(least.select("tree_id", "id", "_row.*").select(*nodes.columns), "chat-nodes")
    # no path has more nodes than its tree: what still goes up after that many steps is on a cycle
    most = nodes.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    here = nodes.select("tree_id", "id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"))
    known = here.select(F.col("tree_id").alias("t_2"), F.col("id").alias("id_2"))
    step = here.join(known, F.expr("tree_id <=> t_2 and parent_id = id_2"), "left")
    jumps = [cut(step.select("tree_id", "id", F.col("id_2").alias("up"), "sum", F.lit(1).cast("long").alias("depth")), "chat-up-0")]
    settled = jumps[0].where("up is null")
    while jumps[-1].where("up is not null").limit(1).count() and 1 << (len(jumps) - 1) < most:
        going = jumps[-1].where("up is not null")
        above = settled.unionByName(going).select(F.col("tree_id").alias("t_2"), F.col("id").alias("id_2"), F.col("up").alias("up_2"), F.col("sum").alias("sum_2"), F.col("depth").alias("depth_2"))
        joined = going.join(above, F.expr("tree_id <=> t_2 and up = id_2"))
        jumps.append(cut(joined.selectExpr("tree_id", "id", "up_2 as up", "sum + sum_2 as sum", "depth + depth_2 as depth"), f"chat-up-{len(jumps)}"))
        settled = settled.unionByName(jumps[-1].where("up is null"))
    parents = jumps[0].where("up is not null").select(F.col("tree_id").alias("t_2"), F.col("up").alias("id_2")).distinct()
    leaves = settled.join(parents, F.expr("tree_id <=> t_2 and id = id_2"), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc(F.col("sum") / F.col("depth")), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    paths = cut(chosen.select("tree_id", "rank", F.col("id").alias("path_id"), "id", F.lit(0).cast("long").alias("above"), F.col("depth").alias("length")), "chat-paths")
    for j, jump in enumerate(jumps[:-1]):
        up = jump.where("up is not null").select(F.col("tree_id").alias("t_2"), F.col("id").alias("id_2"), "up")
        further = paths.join(up, F.expr("tree_id <=> t_2 and id = id_2"))
        grown = paths.unionByName(further.select("tree_id", "rank", "path_id", F.col("up").alias("id"), (F.col("above") + (1 << j)).alias("above"), "length"))
        grown = cut(grown, "chat-paths")
        forget(spark, paths)
        paths = grown
    on_path = paths.select(F.col("tree_id").alias("t_2"), F.col("id").alias("id_2"), "path_id", "rank", (F.col("length") - F.col("above") - 1).alias("depth"))
    return on_path.join(nodes, F.expr("tree_id <=> t_2 and id = id_2")).drop("t_2", "id_2")


def format_paths(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One conversation for each path_id of turns(path_id, depth, role, text): formatted and its loss spans.

    loss_spans are the places of the trained role's texts, in code points: turn (from 0), start (from the turn's
    first character, counted from 1) and length, in order. A null text or role is an empty one.
    """
    role, text = escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    written = turns.select("path_id", "depth", F.concat(head, text, F.lit(CLOSE)).alias("piece"), (F.char_length(head) + 1).alias("start"), F.char_length(text).alias("length"), F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("trained"))
    gathered = written.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "start", "length", "trained"))).alias("turns"))
    numbered = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t.start.alias("start"), t.length.alias("length"), t.trained.alias("trained")))
    spans = F.transform(F.filter(numbered, lambda t: t.trained), lambda t: F.struct(t.turn.alias("turn"), t.start.alias("start"), t.length.alias("length")))
    return gathered.select("path_id", F.concat_ws("", F.col("turns.piece")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says: turns (role, text) in order, and loss_text, the texts under its loss mask."""
    pieces = F.split("formatted", CLOSE)
    cut_up = formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))  # what follows the last mark is empty
    body = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.char_length(p))
    role = lambda p: F.substring_index(body(p), MIDDLE, 1)
    text = lambda p: F.substring(p, F.char_length(role(p)) + len(OPEN) + len(MIDDLE) + 1, F.char_length(p))
    turns = F.transform("pieces", lambda p: F.struct(unescape(role(p), ROLE_ESCAPES).alias("role"), unescape(text(p)).alias("text")))
    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.element_at("pieces", s.turn + 1), s.start, s.length)))
    return cut_up.select(*formatted.columns, turns.alias("turns"), F.concat_ws("", under).alias("loss_text"))


def format_trees(nodes: DataFrame, keep: int = 1, trained_role: str = "assistant") -> DataFrame:
    """tree_id, path_id, formatted, loss_spans: the best `keep` branches of each reply tree, each as one conversation.

    nodes: tree_id, id, parent_id, score, role, text. An empty table gives an empty result.
    """
    paths = reply_paths(nodes, keep)
    key = F.struct("tree_id", F.col("path_id").alias("leaf"))
    out = format_paths(paths.select(key.alias("path_id"), "depth", "role", "text"), trained_role)
    return out.select(F.col("path_id.tree_id").alias("tree_id"), F.col("path_id.leaf").alias("path_id"), "formatted", "loss_spans")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch: each turn answers the one before it.

    Turns are in the order of `turn` (nulls first); of turns with the same number, the role and text decide, and a
    row that is there twice makes two turns.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = conversations.select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("id"), "role", "text")
    return at.select("tree_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.lit(0.0).alias("score"), "role", "text")
