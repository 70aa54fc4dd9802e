"""A Merkle tree over a table: a root for the whole, and for each row a proof that it belongs to it.

Levels of the tree are kept as strings. An aligned block holds DEPTH levels below one node; each level is
one string of hexadecimal digests, DIGEST bytes a node, so that a run of nodes is a substring at a known
place: hashed it is their parent, and what stands beside a node in it are the node's siblings. The blocks'
own nodes are the bottom of the next tree, until one node is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import LOWER, UPPER, bind, numbered, stage
from docquarry.session import running_number

#: Nodes that one parent is made of: 2 ** SHIFT.
SHIFT = 4
ARITY = 1 << SHIFT
#: Levels of a block above its bottom; a block has ARITY ** DEPTH bottom nodes at most.
DEPTH = 3
DIGEST = 64
RUN = ARITY * DIGEST
#: What a leaf is the digest of, in order (fixed values).
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(value: Column) -> Column:
    """SHA-256 of a text or bytes as hexadecimal text."""
    return F.sha2(value, 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of the fields, each as its number of bytes, a colon and its text; a null as a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in
             (c.cast("string") for c in fields)]
    return sha(F.concat(*parts))


def leaves(documents: DataFrame) -> DataFrame:
    """source, doc_id, leaf and altered of every row.

    ``altered`` is the leaf with A to Z of the text in small letters, where 5 divides the CRC-32 of
    doc_id's digits; else, and where doc_id is null, it is null.
    """
    given = {c: F.col(c) for c in FIELDS}
    small = {**given, "text": F.translate("text", UPPER, LOWER)}
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return documents.select(
        "source", F.col("doc_id").cast("long").alias("doc_id"), leaf(list(given.values())).alias("leaf"),
        F.when(chosen, leaf(list(small.values()))).alias("altered"),
    )


def heights(rows: DataFrame, group: Column) -> DataFrame:
    """For each group the number of levels above its bottom rows; a lone row has none."""
    count, levels = F.count(F.lit(1)), F.lit(0)
    for level in range(62 // SHIFT + 1):
        levels = F.when(count > F.lit(1 << SHIFT * level), level + 1).otherwise(levels)
    return rows.groupBy(group.alias("_group")).agg(levels.alias("_height"))


def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The rows of both that agree in the keys; a null agrees with a null."""
    other = right.withColumnsRenamed({k: f"_other{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_other{k}")) for k in keys]
    return left.join(other, same).drop(*[f"_other{k}" for k in keys])


def blocks(nodes: DataFrame, group: str, tall: DataFrame) -> DataFrame:
    """One row a block: its levels as strings, its members' own columns, and the node at its top.

    ``nodes``: ``group``, ``_at``, ``_digest`` and any other columns. A level that the group's tree does
    not reach is null: a lone node's block has only its bottom, and the node itself at the top.
    """
    own = [c for c in nodes.columns if c not in (group, "_digest")]
    of = F.shiftright("_at", SHIFT * DEPTH)
    rows = nodes.groupBy(F.col(group).alias("_group"), of.alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "_digest", *[c for c in own if c != "_at"]))).alias("_members")
    )
    rows = met(rows, tall, "_group")
    rows = rows.withColumn("_level0", F.array_join(F.transform("_members", lambda m: m["_digest"]), "").cast("binary"))
    for level in range(1, DEPTH + 1):
        rows = rows.withColumn(f"_level{level}", F.when(F.col("_height") >= level, parents(F.col(f"_level{level - 1}"))))
    top = F.coalesce(*[F.col(f"_level{level}") for level in range(DEPTH, -1, -1)]).cast("string")
    members = F.transform("_members", lambda m: F.struct(*[m[c].alias(c) for c in own if c != "_at"])) if len(own) > 1 else F.array()
    return rows.select(
        "_group", "_block", "_height", F.size("_members").alias("_size"), members.alias("_members"),
        F.filter(F.array(*[f"_level{level}" for level in range(DEPTH)]), lambda x: x.isNotNull()).alias("_levels"),
        F.least("_height", F.lit(DEPTH)).alias("_up"), top.alias("_top"),
    )


def parents(level: Column) -> Column:
    """The level above: each run of ARITY digests hashed."""
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: sha(F.substring(level, r * RUN + 1, F.lit(RUN)))), "").cast("binary")


def siblings(levels: Column, up: Column, at: Column) -> Column:
    """array<struct<left, right>>: what stands beside a block's bottom node, then beside each node above it."""

    def beside(level: Column, i: Column) -> Column:
        node = F.call_function("shiftright", at, i * SHIFT)
        within = F.pmod(node, F.lit(ARITY))
        return F.struct(
            F.substring(level, (node - within) * DIGEST + 1, within * DIGEST).cast("string").alias("left"),
            F.substring(level, (node + 1) * DIGEST + 1, (F.lit(ARITY - 1) - within) * DIGEST).cast("string").alias("right"),
        )

    return F.transform(F.slice(levels, F.lit(1), up), beside)


def folded(digest: Column, path: Column) -> Column:
    """The root that a node and the siblings on its way up make."""
    return F.aggregate(path, digest, lambda node, s: sha(F.concat(s["left"], node, s["right"])))


def proof(path: Column) -> Column:
    """The digest of all siblings on the way up, left to right."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


PATH = "array<struct<left:string,right:string>>"


def tree(nodes: DataFrame, group: str, tall: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored blocks of each round, from the bottom, and (_group, _top): the root of each group.

    A round takes DEPTH levels; there are as many as the largest group needs. A block is one row of
    ARITY ** DEPTH nodes at most, so a group may hold all rows. ``tall``: see heights.
    """
    rounds = [stage(blocks(nodes, group, tall), "blocks")]
    while not rounds[-1].where(F.col("_block") > 0).isEmpty():
        last = rounds[-1]
        above = last.select("_group", F.greatest(F.col("_height") - DEPTH, F.lit(0)).alias("_height")).where(F.col("_block") == 0)
        upper = last.select("_group", F.col("_block").alias("_at"), F.col("_top").alias("_digest"))
        rounds.append(stage(blocks(upper, "_group", above), "blocks"))
    return rounds, rounds[-1].select("_group", "_top")


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The bottom blocks with ``_path``, the siblings from their top node up to the root, and ``_subroot``.

    ``above``: (_group, _path, _subroot), the way up from each group's own root.
    """
    paths = met(rounds[-1], above, "_group")
    for lower in reversed(rounds[:-1]):
        at = F.sequence(F.lit(0), F.col("_size") - 1)
        own = F.transform(at, lambda i: F.concat(siblings(F.col("_levels"), F.col("_up"), i), F.col("_path")))
        ways = paths.select("_group", "_subroot", F.col("_block").alias("_over"), F.posexplode(own).alias("_in", "_path"))
        ways = ways.select("_group", "_subroot", "_path", ((F.col("_over") * ARITY**DEPTH) + F.col("_in")).alias("_block"))
        paths = met(lower, ways, "_group", "_block")
    return paths


def merkle_manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Leaves of a source stand in the order of doc_id (nulls first), rows of one doc_id in the order of
    their leaves, repeats of a row beside each other. A tree's runs are of 16 nodes; a lone leaf is its
    own subroot. The subroots, in the order of source (null first, by bytes), make the root.
    ``folded_root`` is made from the leaf, of altered rows from the altered one, and the proof's
    siblings; it equals the root unless the alteration shows. Empty texts and sources count as such,
    not as nulls. No rows give none. Columns other than those of FIELDS are ignored.
    """
    own = stage(leaves(documents.select(*FIELDS)), "leaves")
    placed = running_number(own, ["source"], ["doc_id", "leaf"], "_at").withColumn("_at", F.col("_at") - 1)
    bottom, subroots = tree(placed.withColumnRenamed("leaf", "_digest"), "source", heights(own, F.col("source")))
    ranked, count = numbered(subroots.select(F.col("_group").alias("source"), F.col("_top").alias("_digest")), ["source"])
    if not count:
        none = F.lit(None).cast("string")
        return own.select("doc_id", "leaf", none.alias("subroot"), none.alias("root"), none.alias("proof_sha256"),
                          none.alias("folded_root"), F.lit(None).cast("boolean").alias("verified"))
    # written, so that the one group is met as a key like any other
    ranked = stage(ranked.select(F.lit(0).alias("_all"), F.col("_row").alias("_at"), "_digest", "source"), "subroots")
    over, roots = tree(ranked, "_all", heights(ranked, F.col("_all")))
    root = roots.first()["_top"]
    start = over[-1].select("_group", F.array().cast(PATH).alias("_path"), F.lit(root).alias("_subroot"))
    high = descend(over, start)
    ways = high.select(F.posexplode(F.arrays_zip(
        F.col("_members.source").alias("source"),
        F.transform(F.sequence(F.lit(0), F.col("_size") - 1),
                    lambda i: F.struct(
                        F.substring(F.col("_levels")[0], i * DIGEST + 1, F.lit(DIGEST)).cast("string").alias("subroot"),
                        F.concat(siblings(F.col("_levels"), F.col("_up"), i), F.col("_path")).alias("path"))).alias("up"),
    )).alias("_in", "_way")).select(
        F.col("_way.source").alias("_group"), F.col("_way.up.path").alias("_path"), F.col("_way.up.subroot").alias("_subroot")
    )
    found = descend(bottom, ways)

    def row(member: Column, i: Column) -> Column:
        digest = F.substring(F.col("_levels")[0], i * DIGEST + 1, F.lit(DIGEST)).cast("string")
        way = F.concat(siblings(F.col("_levels"), F.col("_up"), i), F.col("_path"))
        return bind(F.struct(digest.alias("d"), way.alias("w")), lambda x: F.struct(
            member["doc_id"].alias("doc_id"), x["d"].alias("leaf"), F.col("_subroot").alias("subroot"), F.lit(root).alias("root"),
            proof(x["w"]).alias("proof_sha256"), folded(F.coalesce(member["altered"], x["d"]), x["w"]).alias("folded_root"),
        ))

    return found.select(F.inline(F.transform("_members", row))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their leaf, their source's root, the root of all, and what their proof leads to."""
    return merkle_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _levels_sql(name: str, nodes: str, levels: int) -> str:
    """CTEs name0, name1, ...: (g, pos, d, n), the nodes of each level of the trees of ``nodes`` (g, pos, d); n: of the tree's level."""
    ctes = [f"{name}0 AS (SELECT g, pos, d, count(*) OVER (PARTITION BY g) AS n FROM ({nodes}))"]
    for k in range(1, levels + 1):
        ctes.append(
            f"{name}{k} AS (SELECT g, pos, d, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, pos // 16 AS pos, "
            f"sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k - 1} WHERE n > 1 GROUP BY g, pos // 16))"
        )
    return ",\n".join(ctes)


def _tops_sql(name: str, levels: int) -> str:
    return " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(levels + 1))


def _sides_sql(name: str, levels: int) -> str:
    """CTEs: for each node of each level with others beside it the text left and right of it in its run."""
    side = "coalesce(string_agg(o.d, '' ORDER BY o.pos) FILTER (o.pos {} x.pos), '') AS {}"
    return ",\n".join(
        f"{name}_side{k} AS (SELECT x.g, x.pos, {side.format('<', 'l')}, {side.format('>', 'r')} FROM {name}{k} x "
        f"JOIN {name}{k} o ON x.g IS NOT DISTINCT FROM o.g AND x.pos // 16 = o.pos // 16 WHERE x.n > 1 GROUP BY x.g, x.pos)"
        for k in range(levels)
    )


def _fold_sql(name: str, step: str, before: str, at: str, g: str, levels: int) -> str:
    """CTEs: the node folded and the siblings joined, level by level."""
    ctes = []
    for k in range(levels):
        ctes.append(
            f"{step}{k} AS (SELECT b.* EXCLUDE (node, path), CASE WHEN s.l IS NULL THEN b.node ELSE sha256(s.l || b.node || s.r) END AS node, "
            f"b.path || coalesce(s.l || s.r, '') AS path FROM {before} b LEFT JOIN {name}_side{k} s "
            f"ON s.g IS NOT DISTINCT FROM b.{g} AND s.pos = b.{at} // {16 ** k})"
        )
        before = f"{step}{k}"
    return ",\n".join(ctes)


#: Trees of up to 16 ** 5 rows a source and 16 ** 3 sources.
_DEEP, _WIDE = 5, 3
_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf_sql(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
l AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql(_TEXT)} AS small, xor(4294967295, list_reduce(
               list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0 AS chosen FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
{_levels_sql("a", "SELECT source AS g, pos, leaf AS d FROM r", _DEEP)},
sub AS ({_tops_sql("a", _DEEP)}),
subs AS (SELECT g AS source, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM sub),
{_levels_sql("b", "SELECT 0 AS g, pos, d FROM subs", _WIDE)},
root AS ({_tops_sql("b", _WIDE)}),
{_sides_sql("a", _DEEP)},
{_sides_sql("b", _WIDE)},
start AS (SELECT r.doc_id, r.source, r.pos, r.leaf, subs.d AS subroot, subs.pos AS top_at, 0 AS zero, root.d AS root,
                 CASE WHEN chosen THEN small ELSE leaf END AS node, '' AS path
          FROM r JOIN subs ON r.source IS NOT DISTINCT FROM subs.source, root),
{_fold_sql("a", "up", "start", "pos", "source", _DEEP)},
{_fold_sql("b", "over", f"up{_DEEP - 1}", "top_at", "zero", _WIDE)}
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, node AS folded_root, node = root AS verified FROM over{_WIDE - 1}
"""
