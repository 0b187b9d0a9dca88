"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, a root over all.

Leaves stand in the order of their keys and are appended one by one. What is appended closes
every aligned subtree that waited for it: both halves take the other's digest into the
witnesses of their leaves, so each leaf holds a partial witness at any time, which grows with
each sibling that is completed. A leaf never waits for the whole tree, and what was appended is
never read again.

The append is distributed by blocks of 2 ** LEVELS aligned leaves, one task's work each. The
roots of the blocks are then appended themselves, in blocks of their own, and so on until one
node is left, so no task sees more than a block, however many leaves a tree has. A leaf's
witness is that of its block's path after its own. A node without a sibling is hashed alone.

Places of leaves come from ranges: rows are cut by tree and key into ranges, numbered within
each, and a small table of the ranges' counts says where each begins. A tree that holds most
rows is many ranges; equal rows are told apart by where they were read, so that they spread too.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship_package
from .grouped import by_group
from .scratch import Scratch, bounded_broadcast

#: Levels of a block: 1,024 leaves.
LEVELS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(columns: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of values: ``-`` for null, else bytes of its text, ``:``, text."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its witness lead to. A step is L or R and the digest that
    stands left or right, or - where a node stands alone."""

    def step(node: Column, s: Column) -> Column:
        other, side = F.substring(s, 2, 64), F.substring(s, 1, 1)
        return F.sha2(F.when(side == "L", F.concat(other, node)).when(side == "R", F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(path, leaf, step)


def siblings_digest(path: Column) -> Column:
    """SHA-256 of a witness's digests, from the leaf to the root."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.substring(s, 2, 64))), 256)


def _hash(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Witnesses:
    """An append-only tree. ``open`` are its aligned subtrees that wait for a sibling, from
    the largest to the smallest: (level, first leaf, digest); ``paths`` are the witnesses
    of the leaves, each complete up to the subtree that it stands in."""

    def __init__(self):
        self.open: list[tuple[int, int, str]] = []
        self.paths: list[list[str]] = []

    def append(self, node: str) -> None:
        self.paths.append([])
        self.join(0, len(self.paths) - 1, node)

    def join(self, level: int, first: int, node: str) -> None:
        """A complete subtree of the last leaves, from first on: close what waited for it."""
        while self.open and self.open[-1][0] == level:
            _, before, left = self.open.pop()
            for path in self.paths[before:first]:
                path.append("R" + node)
            for path in self.paths[first:]:
                path.append("L" + left)
            level, first, node = level + 1, before, _hash(left, node)
        self.open.append((level, first, node))

    def close(self, height: int | None = None) -> None:
        """No more leaves: nodes without a sibling are hashed alone, until one node is left
        and, if a height is given, that one stands there."""
        while len(self.open) > 1 or (height is not None and self.open and self.open[0][0] < height):
            level, first, node = self.open.pop()
            for path in self.paths[first:]:
                path.append("-")
            self.join(level + 1, first, _hash(node))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows (with a column tree) and the columns pos, its place in its tree by order, and
    total, the leaves of its tree."""
    keys = ["tree", *order, "_read"]
    cut = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    saved = scratch.save(cut.drop("_read").withColumn("_at", F.monotonically_increasing_id()), name)
    at = F.shiftright("_at", 33)
    ranges = saved.groupBy("tree", at.alias("_range")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy("tree")
    ranges = ranges.select(
        F.col("tree").alias("_tree"), F.col("_range").alias("_in"), "_first",
        (F.sum("_n").over(by.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("total"),
    )
    ranges = scratch.save(ranges, f"{name}-ranges")
    joined = saved.join(bounded_broadcast(ranges), F.col("tree").eqNullSafe(F.col("_tree")) & (at == F.col("_in")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "total")


def _grow(nodes: DataFrame) -> DataFrame:
    """Each node's path within its block."""

    def run(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block["pos"]))
        tree = Witnesses()
        for node in block["node"].to_pylist():
            tree.append(node)
        tree.close(LEVELS if block["total"][0].as_py() > 1 << LEVELS else None)
        return block.append_column("path", pa.array(tree.paths, pa.list_(pa.string())))

    nodes = nodes.withColumn("block", F.shiftright("pos", LEVELS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", path array<string>"
    return by_group(nodes, ["tree", "block"], run, schema)


def climb(nodes: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """From (tree, pos, total, node and further columns) to the same rows with path, the
    witness up to the root of the tree, and to (tree, root)."""
    level = scratch.save(_grow(nodes), f"{name}-paths")
    first = level.where(F.col("pos") == F.shiftleft("block", LEVELS))
    above = first.select("tree", F.col("block").alias("pos"), F.shiftright(F.col("total") + ((1 << LEVELS) - 1), LEVELS).alias("total"), fold(F.col("node"), F.col("path")).alias("node"))
    above = scratch.save(above, f"{name}-blocks")
    if above.where("total > 1").isEmpty():
        return level.drop("block"), above.select("tree", F.col("node").alias("root"))
    upper, roots = climb(above, scratch, f"{name}-up")
    upper = upper.select(F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("path").alias("_up"))
    joined = level.join(bounded_broadcast(upper), F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    return joined.select(*nodes.columns, F.concat("path", "_up").alias("path")), roots


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "lang", key: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: tree and key (as named there), the carried columns, leaf
    (the digest of its columns), subroot (of its tree), root (of all) and path, the witness
    from leaf to root as ``fold`` reads it.

    Trees are ordered bytewise, null first; leaves by key, null first, equal keys by leaf.
    Nulls and empty texts have digests of their own; equal rows are leaves of their own, any
    of which may stand first; other columns of docs are not read; an empty table gives an
    empty one.
    """
    ship_package(docs.sparkSession)
    scratch, carry = Scratch(docs.sparkSession, "merkle"), carry or {}
    leaves = docs.select(F.col(tree).alias("tree"), F.col(key).alias("key"), digest([F.col(c) for c in columns]).alias("node"), *[c.alias(f"carry_{n}") for n, c in carry.items()])
    leaves = scratch.save(leaves, "digests")  # cutting ranges reads the rows twice: texts only once
    paths, subroots = climb(numbered(leaves, ["key", "node"], scratch, "leaves"), scratch, "leaves")
    crowns = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    tops, root = climb(numbered(crowns, ["name"], scratch, "crowns"), scratch, "crowns")
    crown = tops.crossJoin(F.broadcast(root.select("root"))).select(F.col("name").alias("_name"), F.col("node").alias("subroot"), "root", F.col("path").alias("_top"))
    joined = paths.join(bounded_broadcast(crown), F.col("tree").eqNullSafe(F.col("_name")))
    return joined.select(
        F.col("tree").alias(tree), F.col("key").alias(key), *[F.col(f"carry_{n}").alias(n) for n in carry],
        F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "_top").alias("path"),
    )


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and witness, and whether the witness leads from what the
    document says now, after tampering, to the root. A null doc_id is never tampered with; a
    null n_chars stays null. Nulls, ties, repeats and empty tables as in ``manifest``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    now = digest([F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(c) for c in COLUMNS])
    rows = manifest(docs, carry={"now": now}).withColumn("folded_root", fold(F.col("now"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of the decimal doc_id comes from the table of the polynomial 0xEDB88320.
OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), said AS (
  SELECT d.*, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 7 = 0, false) AS touched
  FROM documents d, steps
), hashed AS (
  SELECT doc_id, lang, touched,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS was, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS now,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM said
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, sha256(head || was || tail) AS leaf, sha256(head || CASE WHEN touched THEN now ELSE was END || tail) AS held FROM hashed)
), nodes AS (
  SELECT 0 AS level, lang, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS total FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(total) + 1) // 2 FROM nodes WHERE total > 1 GROUP BY level, lang, pos // 2
), subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM nodes WHERE total = 1
), tops AS (
  SELECT 0 AS level, pos, subroot AS node, total FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(total) + 1) // 2 FROM tops WHERE total > 1 GROUP BY level, pos // 2
), low AS (
  SELECT l.lang, l.pos, list(CASE WHEN s.pos IS NULL THEN '-' WHEN s.pos < n.pos THEN 'L' || s.node ELSE 'R' || s.node END ORDER BY n.level) AS path
  FROM leaves l JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.total > 1 AND n.pos = l.pos >> n.level
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.pos = xor(n.pos, 1) GROUP BY ALL
), high AS (
  SELECT r.lang, list(CASE WHEN s.pos IS NULL THEN '-' WHEN s.pos < n.pos THEN 'L' || s.node ELSE 'R' || s.node END ORDER BY n.level) AS path
  FROM subroots r JOIN tops n ON n.total > 1 AND n.pos = r.pos >> n.level LEFT JOIN tops s ON s.level = n.level AND s.pos = xor(n.pos, 1) GROUP BY ALL
), proofs AS (
  SELECT l.doc_id, l.leaf, l.held, r.subroot, t.node AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN low ON low.lang IS NOT DISTINCT FROM l.lang AND low.pos = l.pos
  LEFT JOIN high ON high.lang IS NOT DISTINCT FROM l.lang, (SELECT node FROM tops WHERE total = 1) t
), folded AS (
  SELECT *, list_reduce(list_prepend(held, path), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
