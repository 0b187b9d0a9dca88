"""Connected components of a table of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: Up to so many nodes the table of roots is broadcast (a node is two numbers); links that
#: one file and task holds.
BROADCAST_NODES, LINKS_A_TASK = 500_000, 250_000


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """From (a, b), links in either direction, to (node, root): root is the smallest node
    that node reaches. Each round takes the smallest root among a node and its neighbours
    and then the root of that root, so chains shrink by half at least; the rounds end when
    nothing changes. All sides are aggregated before they are joined, and every round is
    written to the shared folder."""
    tasks = 1 + 2 * links.count() // LINKS_A_TASK
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = scratch.save(both.coalesce(tasks), f"{name}-both")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    roots = scratch.save(first.coalesce(tasks), f"{name}-0")
    small = roots.count() <= BROADCAST_NODES
    side = F.broadcast if small else lambda df: df
    done, k = False, 0
    while not done:
        k += 1
        seen = both.join(side(roots.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = seen.join(side(roots), "node").select("node", F.least("root", "m").alias("up"), F.col("root").alias("was"))
        above = roots.select(F.col("node").alias("up"), F.col("root").alias("top"))
        after = hooked.join(side(above), "up").select("node", F.least("up", "top").alias("root"), "was")
        saved = scratch.save(after.coalesce(tasks), f"{name}-{k}")
        done = saved.where("root != was").isEmpty()
        roots = saved.select("node", "root")
        scratch.drop(f"{name}-{k - 1}")
    return roots
