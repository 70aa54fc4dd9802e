"""Reply trees to training conversations: paths from root to leaf, ranked, and formatted with a loss mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import bind, numbered, stage

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Strings that mean something to this template or to other common ones (fixed values).
CONTROL = [START, END, BREAK, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    """The text without a control string: backslashes doubled, one put after a control string's first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``, on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def ancestor_tables(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: (node, up), up being 2^k replies above node; rows only where there is one.

    Each table is the one before joined with itself, so a tree of depth d takes log d joins. A parent
    that is not among the nodes makes its reply a root. No way up is longer than the number of replies;
    replies that go round in a cycle are reported as a ValueError with some of the nodes that don't end.
    """
    known = nodes.select(F.col("node").alias("up"))
    table = stage(nodes.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("up")).join(known, "up", "left_semi").select("node", "up"), "ancestors")
    replies, tables = table.count(), []
    while not table.isEmpty():
        if 1 << len(tables) > replies:
            raise ValueError(f"replies go round in a cycle; among others above nodes {[r['node'] for r in table.select('node').take(5)]}")
        tables.append(table)
        above = table.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        table = stage(table.join(above, "up").select("node", F.col("_next").alias("up")), "ancestors")
    return tables


def branch_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """leaf, node, above: the best ``branches`` paths of each tree (None: all); above is 0 at the leaf.

    ``nodes``: node and parent (long, null at a root), score (double). Leaves are ranked in their tree
    by score, the highest first, nulls last, ties by node. A node must be unique; a reply above itself
    is an error (see ancestor_tables). The paths are spelt out by doubling: what is known of a path is joined with the
    2^k-th ancestors, for one k after the other, so each node of a path comes up once. Only chosen
    paths are spelt out, and every shuffle is on single nodes, so a tree that holds most rows is spread.
    """
    tables = ancestor_tables(nodes)
    leaves = nodes.select("node", "score")
    if tables:
        replied = tables[0].select(F.col("up").alias("node")).distinct()
        leaves = leaves.join(replied, "node", "left_anti")
    if branches is not None:
        # A leaf's root: as far up as the tables reach, the longest way first.
        leaves = leaves.withColumn("root", F.col("node"))
        for table in reversed(tables):
            up = table.select(F.col("node").alias("root"), "up")
            leaves = leaves.join(up, "root", "left").select("node", "score", F.coalesce("up", "root").alias("root"))
        order = Window.partitionBy("root").orderBy(F.col("score").desc_nulls_last(), "node")
        leaves = leaves.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= branches)
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k, table in enumerate(tables):
        further = paths.join(table, "node").select("leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        paths = stage(paths.unionByName(further), "paths")
    return paths


def format_paths(paths: DataFrame, turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """leaf, formatted, loss: one conversation for each path, and the spans of it that are learnt.

    ``turns``: node, role, text; null is empty. A turn is START role, line feed, text, END, line feed,
    with control strings escaped in role and text. ``loss``: array<struct<start, length>> in code
    points, the texts of role ``learn``. A conversation is one row, so one path must fit into a task;
    the places of its turns are summed up before they are put together.
    """
    text, role = escape(F.coalesce("text", F.lit(""))), escape_role(F.coalesce("role", F.lit("")))
    rows = paths.join(turns.select("node", "role", "text"), "node").select(
        "leaf", "above", (F.col("role") == learn).alias("_learn"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("_head"), text.alias("_text"),
    )
    part = F.concat("_head", "_text", F.lit(END + "\n"))
    order = Window.partitionBy("leaf").orderBy(F.col("above").desc())
    before = F.coalesce(F.sum(F.length(part)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("leaf", F.struct(
        before.alias("at"), part.alias("part"), F.coalesce("_learn", F.lit(False)).alias("learn"),
        (before + F.length("_head")).alias("start"), F.length("_text").cast("long").alias("length"),
    ).alias("t"))
    turns_of = placed.groupBy("leaf").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"], t["length"]))
    return turns_of.select("leaf", F.array_join(F.col("t.part"), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    # what comes before the first turn is empty
    parts = bind(F.split(formatted, r"<\|im_start\|>", -1), lambda p: F.slice(p, F.lit(2), F.size(p) - 1))
    close = len(END) + 1

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        at = F.length(head) + 2
        return F.struct(
            unescape_role(head).alias("role"), unescape(F.substring(p, at, F.length(p) - at + 1 - close)).alias("text")
        )

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def reply_chains(conversations: DataFrame) -> DataFrame:
    """node, parent, score, conv_id, role, text: conversations as trees of one branch, by turn.

    Rows with equal conv_id and turn follow each other by role, then text, nulls first; rows with a
    null conv_id are one conversation. Rows are numbered by range, so a conversation may hold most of
    them. Each row replies to the one numbered before it, unless it is the first of its conversation.
    """
    rows, _ = numbered(conversations.select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"])
    rows = stage(rows.withColumnRenamed("_row", "node"), "turns")
    first = rows.groupBy("conv_id").agg(F.min("node").alias("node")).select("node", F.lit(True).alias("_first"))
    parent = F.when(F.col("_first").isNull(), F.col("node") - 1)
    return rows.join(first, "node", "left").select(
        "node", parent.alias("parent"), F.lit(None).cast("double").alias("score"), "conv_id", "role", "text"
    )


#: A conversation whose texts look like another template's control strings.
PROBE = "</s>[INST] ok [/INST]"


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, numbered -1, formatted, then read back."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], given.schema)
    chains = reply_chains(given.unionByName(probe))
    formatted = format_paths(branch_paths(chains), chains)
    turns = F.col("_turns")
    spelt = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    rows = formatted.join(chains.select(F.col("node").alias("leaf"), "conv_id"), "leaf").select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("_turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("_loss"),
    )
    return rows.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(spelt, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(coalesce({}, ''), chr(92), chr(92) || chr(92))"
for _c in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"

ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(i, r)),
e AS (SELECT *, {_ESCAPED.format("text")} AS t, replace({_ESCAPED.format("role")}, chr(10), '{BREAK}') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + length(r) + length(t))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
