"""Merkle manifest of a table: digests of rows, trees per group, a tree over the groups, and proofs.

Every row is a leaf: the hash of its fields. The leaves of a group ascend by key; each two consecutive nodes
make a node of the level above (the last run may hold one), up to the group's subroot. Subroots, ordered by
group, make the upper tree, whose top is the root of the table.

* ``built`` makes the levels from blocks of 2^``STEP`` = 256 consecutive digests: one shuffle brings a block
  together, its eight levels are made there, and its top goes into the next round. A round has 1/256 of the rows of the last.
* Levels from ``STEP`` on are stored as node rows linked to their parents: (tree, node level and place, parent, sibling
  and its side). All leaves climb past the same few nodes near the root. So nodes are stored once per lane, a
  lane being 2^``LANE`` leaves of a tree; a join of climbing leaves and nodes has no hot key.
* ``climbed`` is a recursive query over the node rows. Its rows are the leaves of a block, which have the same
  siblings from level ``STEP`` on; they ascend side by side. The anchor takes the stored levels of the block and folds
  each leaf, tampered or not, with its own siblings; each step of the recursion appends the sibling of
  the node to the proof, folds all leaves with it and goes to the parent, through the subroot to the root.

Fields: each is ``-`` if null, otherwise its UTF-8 byte count, ``:`` and its value; so no two rows have the
same input unless they are equal. Rows of equal keys ascend by digest; equal rows are leaves of their own with the same digest, and
each gets a proof. A null key comes first, and the null group comes before all others. A table without rows has no nodes and gives no rows. Columns
that are no fields may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.base import scratch, small, written
from assayer.operators.ordering import numbered

STEP, LANE = 8, 16
#: Fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of fields."""
    shown = [v.cast("string") for v in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def parent(left: Column, right: Column) -> Column:
    """Hash of one or two digests in hexadecimal; ``right`` may be null."""
    return F.sha2(F.concat(left, F.coalesce(right, F.lit(""))), 256)


def levels(digests: str, height: Column) -> Column:
    """All levels of a block: the digests themselves, then ``height`` levels above them."""

    def grown(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        pairs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int"))
        return F.concat(done, F.array(F.transform(pairs, lambda i: parent(F.get(last, 2 * i), F.get(last, 2 * i + 1)))))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(F.col(digests)), grown)


def siblings(tower: str, place: Column) -> Column:
    """What a digest at ``place`` of a block meets on its way up: (sibling, null where there is none; whether it is on the left)."""
    below = F.slice(F.col(tower), 1, F.size(tower) - 1)
    return F.transform(
        below,
        lambda level, k: F.struct(
            F.get(level, F.call_function("shiftright", place, k).bitwiseXOR(F.lit(1))).alias("sibling"),
            (F.call_function("shiftright", place, k).bitwiseAND(F.lit(1)) == 1).alias("on_left"),
        ),
    )


def folded(digest: Column, path: Column) -> Column:
    """The top that ``digest`` leads to along ``path``."""
    met = lambda d, n: F.when(n["on_left"], parent(n["sibling"], d)).otherwise(parent(d, n["sibling"]))
    return F.aggregate(path, digest, met)


def blocks(digests: DataFrame, rows: str) -> DataFrame:
    """Blocks of ``digests`` (tree, n, at, ``rows``: a struct with ``digest``): tree, n, block, rows, tower, top.

    ``n``: nodes of the tree in this round. A tree of one block ends with it, any other has ``STEP`` levels per block.
    """
    together = digests.groupBy("tree", "n", F.shiftright("at", STEP).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", rows))).alias("rows")
    )
    height = F.when(F.col("n") <= 1 << STEP, F.ceil(F.log2("n")).cast("int")).otherwise(STEP)
    only = together.select("tree", "n", "block", F.transform("rows", lambda r: r[rows]).alias("rows"), height.alias("height"))
    only = only.withColumn("digests", F.transform("rows", lambda r: r["digest"]))
    return only.withColumn("tower", levels("digests", F.col("height"))).withColumn("top", F.get(F.element_at("tower", -1), F.lit(0)))


def above(tops: DataFrame, most: int, start: int) -> tuple[DataFrame, DataFrame | None]:
    """Rounds over ``tops`` (tree, n, at, digest) until every tree has one digest left: its root (tree, digest), and node rows.

    ``most``: the largest number of nodes of a tree. Node rows: tree, level, node, sibling, on_left, with levels from ``start`` on.
    """
    roots, nodes = tops.where("n = 1").select("tree", "digest"), None
    while most > 1:
        made = written(blocks(tops.where("n > 1").withColumn("row", F.struct("digest")), "row"), "merkle-blocks")
        stage = made.select("tree", "block", F.posexplode(F.slice("tower", 1, F.size("tower") - 1)).alias("k", "digests"))
        stage = stage.select("tree", "block", "k", "digests", F.posexplode("digests").alias("i", "digest")).select(
            "tree",
            (F.col("k") + start).alias("level"),
            (F.expr(f"shiftleft(block, {STEP} - k)") + F.col("i")).alias("node"),
            F.get("digests", F.col("i").bitwiseXOR(F.lit(1))).alias("sibling"),
            (F.col("i").bitwiseAND(F.lit(1)) == 1).alias("on_left"),
        )
        nodes = stage if nodes is None else nodes.unionByName(stage)
        tops = made.select("tree", _rounded("n").alias("n"), F.col("block").alias("at"), F.col("top").alias("digest"))
        roots = roots.unionByName(tops.where("n = 1").select("tree", "digest"))
        most, start = -(-most >> STEP), start + STEP
    return roots, nodes


def _rounded(n: str) -> Column:
    """Blocks that ``n`` nodes make."""
    return F.shiftright(F.col(n) + ((1 << STEP) - 1), STEP)


def leaves(docs: DataFrame, key: str, group: str, fields: Sequence[str], tampered: dict[str, Column]) -> DataFrame:
    """key, group, ``digest`` and the digest ``tampered`` of the altered row, null where that is the same."""
    plain = leaf([F.col(f"`{c}`") for c in fields])
    altered = leaf([tampered.get(c, F.col(f"`{c}`")) for c in fields])
    found = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("group"), plain.alias("digest"), altered.alias("tampered"))
    return found.withColumn("tampered", F.expr("nullif(tampered, digest)"))


CLIMB = """
WITH RECURSIVE climb(tree, lane, block, level, node, folded, proof) MAX RECURSION LEVEL 200 AS (
    SELECT tree, lane, block, level, node, folded, proof FROM {starts}
    UNION ALL
    SELECT c.tree, c.lane, c.block, n.parent_level, n.parent_node,
           transform(c.folded, x -> unhex(sha2(
               CASE WHEN n.sibling IS NULL THEN lower(hex(x)) WHEN n.on_left THEN concat(n.sibling, lower(hex(x)))
               ELSE concat(lower(hex(x)), n.sibling) END, 256))),
           concat(c.proof, coalesce(n.sibling, ''))
    FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.lane = n.lane AND c.level = n.level AND c.node = n.node)
SELECT tree, block, folded, proof FROM climb WHERE level = {top}
"""
#: Level of subroots as leaves of the upper tree; no tree is as high.
UPPER = 64


def climbed(starts: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """tree, block, ``folded`` (the tops that the block's leaves lead to) and ``proof`` (the siblings they met)."""
    spark, limit = starts.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # rows are as many as blocks times levels
    try:
        return written(spark.sql(CLIMB, starts=starts, nodes=nodes, top=top), "merkle-climb")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)


def node_rows(groups: DataFrame, inner: DataFrame | None, upper: DataFrame | None, spark: SparkSession) -> DataFrame:
    """Stored nodes (tree, lane, level, node, parent_level, parent_node, sibling, on_left), once for every lane."""
    lanes = F.shiftright(F.col("n") + ((1 << LANE) - 1), LANE)
    out = spark.createDataFrame([], "tree long, lane long, level int, node long, parent_level int, parent_node long, sibling string, on_left boolean")
    if inner is not None:
        height = F.ceil(F.log2("n"))
        wide = F.greatest(F.col("level") - LANE, F.lit(0))
        first = F.expr(f"if(level < {LANE}, shiftright(node, {LANE} - level), shiftleft(node, level - {LANE}))")
        last = F.least(first + F.call_function("shiftleft", F.lit(1).cast("long"), wide), lanes) - 1
        up = F.col("level") + 1 < height
        out = out.unionByName(inner.join(small(groups.select("tree", "n")), "tree").select(
            "tree", F.explode(F.sequence(first, last)).alias("lane"), "level", "node",
            F.when(up, F.col("level") + 1).otherwise(UPPER).alias("parent_level"),
            F.when(up, F.shiftright("node", 1)).otherwise(F.col("tree")).alias("parent_node"), "sibling", "on_left",
        ))
    if upper is not None:
        height = upper.agg(F.max("level")).first()[0] + 1
        passed = groups.select("tree", lanes.alias("lanes"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("level"))
        passed = passed.withColumn("node", F.expr("shiftright(tree, level)"))
        met = passed.join(upper.select("level", "node", "sibling", "on_left"), ["level", "node"])
        out = out.unionByName(met.select(
            "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"), (F.col("level") + UPPER).alias("level"), "node",
            (F.col("level") + UPPER + 1).alias("parent_level"), F.shiftright("node", 1).alias("parent_node"), "sibling", "on_left",
        ))
    return written(out, "merkle-nodes")


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, tampered: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, and, recomputed from
    the row with the values ``tampered``, ``folded_root`` and whether it is the root (``verified``)."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = numbered(leaves(docs, key, group, fields, tampered or {}), ["group"], [F.col("key").asc_nulls_first(), "digest", "tampered"], "at")
        rows = written(rows, "merkle-leaves")
        groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        groups = numbered(groups, [], [F.col("group").asc_nulls_first()], "tree").withColumn("tree", F.col("tree") - 1)
        groups = written(groups, "merkle-groups")
        most, trees = groups.agg(F.max("n"), F.count(F.lit(1))).first()
        placed = rows.join(small(groups), rows["group"].eqNullSafe(groups["group"])).select(
            "tree", "n", (F.col("at") - 1).alias("at"), F.struct("key", "digest", "tampered").alias("row")
        )
        base = written(blocks(placed, "row"), "merkle-base")
        tops = base.select("tree", _rounded("n").alias("n"), F.col("block").alias("at"), F.col("top").alias("digest"))
        subroots, inner = above(tops, -(-(most or 0) >> STEP), STEP)
        subroots = written(subroots, "merkle-subroots")
        heads = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).alias("n"), F.col("tree").alias("at"), "digest")
        roots, upper = above(heads, trees, 0)
        root = (roots.first() or [None, None])[1]
        nodes = node_rows(groups, inner, upper, spark)

        paths = F.transform("rows", lambda r, i: siblings("tower", i))
        own = F.zip_with("rows", paths, lambda r, p: F.unhex(folded(F.coalesce(r["tampered"], r["digest"]), p)))
        ended = F.col("n") <= 1 << STEP  # the block's top is the subroot
        starts = base.select(
            "tree", F.shiftright("block", LANE - STEP).alias("lane"), "block", F.when(ended, UPPER).otherwise(STEP).alias("level"),
            F.when(ended, F.col("tree")).otherwise(F.col("block")).alias("node"), own.alias("folded"), F.lit("").alias("proof"),
        )
        climb = climbed(starts, nodes, UPPER + max(trees - 1, 0).bit_length())
        both = base.select("tree", "block", "rows", paths.alias("paths")).join(climb, ["tree", "block"])
        both = both.join(small(subroots.select("tree", F.col("digest").alias("subroot"))), "tree")
        each = both.select("subroot", "proof", F.explode(F.arrays_zip("rows", "paths", "folded")).alias("x"))
        met = F.array_join(F.transform("x.paths", lambda n: n["sibling"]), "")
        back = F.lower(F.hex("x.folded"))
        return written(each.select(
            F.col("x.rows.key").alias(key), F.col("x.rows.digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
            F.sha2(F.concat(met, F.col("proof")), 256).alias("proof_sha256"), back.alias("folded_root"), (back == F.lit(root)).alias("verified"),
        ), "merkle", keep=True)
