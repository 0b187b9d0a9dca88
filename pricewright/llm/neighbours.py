"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label count once. A first neighbour graph comes from small groups that
share a random projection's signs, and is refined by joining neighbours of neighbours: each
vector brings its neighbours together, they are compared with each other and keep the best.
No link between components that a comparison meets is lost: it is written beside the lists, as
a spanning forest of its group. A vector has a list of the best inside its component and one of
the best outside, so links of its own dense group never crowd out those that leave it; rounds
go on until none joins two components, and then no list outside holds a link. All members of a
component meet in blocks, which counts every link inside it. A random set of vectors, compared with all, audits
the share of links found in the very result that is returned; below AUDIT new projections are
drawn and the graph is refined again with longer lists, and when that does not help, it fails.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship_package
from .graph import components
from .grouped import by_group
from .scratch import Scratch, bounded_broadcast

SIMILARITY = 0.93
#: First length of the neighbour lists, least rounds of joins before an audit, audits at most.
NEIGHBOURS, ROUNDS, AUDITS = 8, 2, 6
#: Projections for the first graph and for each audit that fails, their least signs, and members
#: of a group of it on average.
TABLES, SIGNS, GROUP = 6, 10, 48
#: Vectors that the audit compares with all, four times as many while they have fewer than
#: AUDIT_LINKS links, AUDIT_MOST at most; and the share of their links to be found.
AUDIT_ROWS, AUDIT_LINKS, AUDIT_MOST, AUDIT = 512, 1000, 8192, 0.98
BLOCK, SEED = 512, 7


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    if ((top > 1e150) | (top < 1e-150)).any():  # squares would leave the range of doubles
        x = x / top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(node, space, label, vec, copies): vectors that may link, equal ones of a label once;
    node is their smallest id. Only vectors of one length are compared."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull()
    return (
        vectors.where(fine)
        .groupBy(F.col(label).alias("label"), v.alias("vec"))
        .agg(F.min(vec_id).alias("node"), F.count(F.lit(1)).alias("copies"))
        .where("node is not null")
        .select("node", F.struct("label", F.size("vec").alias("length")).alias("space"), "vec", "copies")
    )


def _best(node: np.ndarray, sims: np.ndarray, k: int, least: np.ndarray, link: bool = False) -> pa.Table:
    """Of a square of similarities, the k best of each row above its least."""
    k = min(k, len(node) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, top, 1)
    keep = (value > least[:, None]).ravel()
    return _edges(np.repeat(node, k)[keep], node[top].ravel()[keep], value.ravel()[keep], link)


def _edges(node: np.ndarray, other: np.ndarray, sim: np.ndarray, link: bool) -> pa.Table:
    return pa.table({"node": node, "other": other, "sim": sim, "link": np.full(len(node), link)})


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a symmetric table of links that join all that it joins, fewer than its rows."""
    left, a, b = near.any(axis=1), [], []
    for first in np.flatnonzero(left):
        todo = [first] if left[first] else []
        left[first] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            a += [at] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


#: link: not for the lists, but to join the components of its ends.
EDGES = "node long, other long, sim double, link boolean"


def compared(node: np.ndarray, root: np.ndarray, vec: pa.ChunkedArray, k: int, similarity: float, inside: np.ndarray | None = None, outside: np.ndarray | None = None) -> pa.Table:
    """The k best of each inside its component and outside, above the least of each list, and
    the links that join components."""
    x = _unit(vec)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    own = root[:, None] == root[None, :]
    a, b = forest((sims >= similarity) & ~own)
    every = np.full(len(node), -1.5)
    lists = [_best(node, np.where(own, sims, -2), k, every if inside is None else inside), _best(node, np.where(own, -2, sims), k, every if outside is None else outside)]
    return pa.concat_tables([*lists, _edges(node[a], node[b], sims[a, b], True)])


def signs_of(nodes: DataFrame) -> DataFrame:
    """(space, parts, n_signs): signs grow with the logarithm of the vectors of a space, so that
    its spread vectors make groups of GROUP or fewer at any size."""
    sizes = nodes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("space", F.ceil(F.col("n") / GROUP).alias("parts"), F.greatest(F.lit(SIGNS), F.ceil(F.log2(F.col("n") / GROUP)).cast("int")).alias("n_signs"))


def first_graph(nodes: DataFrame, scratch: Scratch, k: int, similarity: float, audit: int = 0) -> DataFrame:
    """Groups of vectors that share signs of a projection, TABLES times; a group that would be
    large is dealt by chance, so none grows with the data. Each audit has its own projections."""
    spaces = scratch.save(signs_of(nodes), f"spaces{audit}")
    most = spaces.agg(F.max("n_signs")).first()[0] or SIGNS

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"node": [], "table": [], "signs": []}
            lists = batch.column(1)
            lengths = np.asarray(lists.value_lengths())
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = _unit(lists.take(pa.array(at)))
                planes = np.random.default_rng([SEED, audit, int(n)]).standard_normal((int(n), TABLES * most))
                bits = (x @ planes > 0).reshape(len(at), TABLES, most) @ (1 << np.arange(most))
                out["node"].append(np.repeat(np.asarray(batch.column(0))[at], TABLES))
                out["table"].append(np.tile(np.arange(TABLES), len(at)))
                out["signs"].append(bits.ravel())
            yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in out.items()})

    marks = nodes.select("node", "vec").mapInArrow(signed, "node long, table long, signs long")
    placed = nodes.select("node", "space").join(spaces, "space")
    short = F.expr("signs & (shiftleft(1L, n_signs) - 1)").alias("signs")
    marks = scratch.save(marks.join(placed, "node").select("node", "space", "table", short), f"marks{audit}")
    sizes = marks.groupBy("space", "table", "signs").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = marks.join(sizes, ["space", "table", "signs"]).select("node", F.xxhash64("space", "table", "signs").alias("g"), F.pmod(F.xxhash64(F.lit(audit), "node", "table"), F.col("parts")).alias("part"))
    chance = placed.select("node", F.xxhash64("space").alias("g"), F.pmod(F.xxhash64(F.lit(SEED + audit), "node"), F.col("parts")).alias("part"))
    grouped = dealt.union(chance).join(nodes.select("node", "root", "vec"), "node")

    def meet(t: pa.Table) -> pa.Table | None:
        return compared(np.asarray(t.column("node")), np.asarray(t.column("root")), t.column("vec"), k, similarity) if t.num_rows > 1 else None

    return by_group(grouped, ["g", "part"], meet, EDGES)


def shortened(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each node inside its component and outside, each other one once."""
    once = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.first("own").alias("own"))
    rank = F.row_number().over(W.partitionBy("node", "own").orderBy(F.desc("sim"), "other"))
    return once.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def listed(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The lists (node, other, sim, own) of edges under the components of nodes."""
    once = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    root = nodes.select("node", "root")
    with_roots = once.join(root, "node").join(root.select(F.col("node").alias("other"), F.col("root").alias("_root")), "other")
    return shortened(with_roots.select("node", "other", "sim", (F.col("root") == F.col("_root")).alias("own")), k)


def joined(graph: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """One round: at each node its neighbours and those that have it as one meet."""
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim", "own")
    around = graph.union(shortened(back, k)).select("node", "other").distinct()

    def least(own):
        return F.when(F.count_if(own) >= k, F.min(F.when(own, F.col("sim")))).otherwise(-1.5)

    worst = graph.groupBy(F.col("node").alias("other")).agg(least(F.col("own")).alias("inside"), least(~F.col("own")).alias("outside"))
    members = around.join(worst, "other", "left").join(nodes.select(F.col("node").alias("other"), "root", "vec"), "other")
    members = members.select("node", "other", "root", F.coalesce("inside", F.lit(-1.5)).alias("inside"), F.coalesce("outside", F.lit(-1.5)).alias("outside"), "vec")

    def meet(t: pa.Table) -> pa.Table | None:
        other, root, inside, outside = (np.asarray(t.column(c)) for c in ("other", "root", "inside", "outside"))
        return compared(other, root, t.column("vec"), k, similarity, inside, outside) if t.num_rows > 1 else None

    return by_group(members, ["node"], meet, EDGES)


def merged(nodes: DataFrame, met: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """nodes with the roots that follow from the links met."""
    links = met.where("link").select(F.col("node").alias("a"), F.col("other").alias("b"))
    known = nodes.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(known.union(links), scratch, f"{name}-roots").withColumnRenamed("root", "_root")
    return scratch.save(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root"), name)


def counted(roots: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, links): within each component, every pair is compared, block by block; links
    counts copies and leaves out the copies of the node itself."""
    members = roots.join(nodes.select("node", "vec", "copies"), "node")
    blocks = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = placed.withColumn("other", to).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "vec", "copies")

    def meet(t: pa.Table) -> pa.Table | None:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x, block, node, copies = _unit(t.column("vec")), np.asarray(t.column("block")), np.asarray(t.column("node")), np.asarray(t.column("copies"))
        near = x @ x.T >= similarity
        np.fill_diagonal(near, False)
        if i != j:  # pairs of one block meet where i = j
            near &= block[:, None] != block[None, :]
        return pa.table({"node": node, "links": (near @ copies).astype(np.int64)})

    return by_group(sent, ["root", "i", "j"], meet, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def exact(nodes: DataFrame, similarity: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """nodes with their roots, and (node, links), from every pair of a space, block by block: the
    way that is left where no audit is passed. Of a pair of blocks only counts and a forest of
    its links leave the task."""
    every = nodes.select("node", "vec", "copies", F.col("space.label").alias("label"), F.col("space.length").alias("length"))
    sizes = scratch.save(every.groupBy("label", "length").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "spaces")
    placed = every.join(bounded_broadcast(sizes), ["label", "length"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = placed.withColumn("other", to).select("label", "length", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "vec", "copies")

    def meet(t: pa.Table) -> pa.Table | None:
        x, block, node, copies = _unit(t.column("vec")), np.asarray(t.column("block")), np.asarray(t.column("node")), np.asarray(t.column("copies"))
        near = x @ x.T >= similarity
        np.fill_diagonal(near, False)
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():  # pairs of one block meet where i = j
            near &= block[:, None] != block[None, :]
        a, b = forest(near)
        links = (near @ copies).astype(np.int64)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        none = pa.nulls(len(some), pa.int64())
        return pa.concat_tables([pa.table({"node": node[some], "links": links[some], "other": none}), pa.table({"node": node[a], "links": np.zeros(len(a), np.int64), "other": node[b]})])

    met = scratch.save(by_group(sent, ["label", "length", "i", "j"], meet, "node long, links long, other long"), "exact")
    edges = met.where("other is not null").select("node", "other", F.lit(1.0).alias("sim"), F.lit(True).alias("link"))
    found = met.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    return merged(nodes.withColumn("root", F.col("node")), edges, scratch, "exact-nodes"), scratch.save(found, "exact-counted")


def audited(nodes: DataFrame, found: DataFrame, similarity: float) -> float:
    """Of some vectors, compared with all, the lesser of two shares: their links that were found,
    and those vectors with links that have none outside their component. So many vectors that
    their links are AUDIT_LINKS, or all, or AUDIT_MOST."""
    rows, every = AUDIT_ROWS, nodes.count()
    while True:
        share, seen = audited_rows(nodes, found, similarity, rows)
        if seen >= AUDIT_LINKS or rows >= min(every, AUDIT_MOST):
            return share
        rows *= 4


def audited_rows(nodes: DataFrame, found: DataFrame, similarity: float, rows: int) -> tuple[float, int]:
    """The lesser share of audited() for so many vectors, and their links."""
    drawn = nodes.orderBy(F.xxhash64(F.lit(SEED), "node"), "node").limit(rows).select("node", "space", "vec", "root").toArrow()
    spaces: dict = {}
    for i, x in enumerate(drawn.column("space").to_pylist()):
        spaces.setdefault((x["label"], x["length"]), []).append(i)
    held = {s: (drawn.column("node").to_numpy()[at], drawn.column("root").to_numpy()[at], _unit(drawn.column("vec").take(pa.array(at)))) for s, at in spaces.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, int]] = {}
        for whole in batches:
            for batch in (whole.slice(lo, BLOCK) for lo in range(0, whole.num_rows, BLOCK)):
                space = [(s["label"], s["length"]) for s in batch.column(1).to_pylist()]
                for s in set(space) & set(held):
                    part = batch.take(pa.array([i for i, x in enumerate(space) if x == s]))
                    ids, roots, q = held[s]
                    near = q @ _unit(part.column(2)).T >= similarity
                    near &= ids[:, None] != np.asarray(part.column(0))[None, :]
                    away = (near & (roots[:, None] != np.asarray(part.column(4))[None, :])).sum(axis=1)
                    for k, n, m in zip(ids.tolist(), (near @ np.asarray(part.column(3))).tolist(), away.tolist(), strict=True):
                        was = totals.get(k, (0, 0))
                        totals[k] = (was[0] + n, was[1] + m)
        if totals:
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(totals), pa.int64()), "n": pa.array([n for n, _ in totals.values()], pa.int64()), "away": pa.array([m for _, m in totals.values()], pa.int64())})

    true = nodes.select("node", "space", "vec", "copies", "root").mapInArrow(run, "node long, n long, away long").groupBy("node").agg(F.sum("n").alias("n"), F.sum("away").alias("away"))
    got = F.sum(F.least(F.coalesce("links", F.lit(0)), F.col("n")))
    row = true.where("n > 0").join(found, "node", "left").agg(F.sum("n").alias("n"), (got / F.sum("n")).alias("links"), F.avg((F.col("away") == 0).cast("int")).alias("whole")).first()
    return (min(row["links"], row["whole"]) if row["n"] else 1.0), row["n"] or 0


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Only vectors of one label and length are compared; vectors that are null, zero, or hold
    null or non-finite components link with nothing, nor do those without a label. n_links
    counts the other rows linked directly, copies among them. A row with a null id has its
    class's links and component, and is kept if it has none. Repeated rows link with each
    other. An empty table gives an empty one. Where AUDITS audits are not passed, all pairs of
    a label and length are compared in blocks.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "neighbours")
    narrow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"), F.col(label).alias("label"))
    nodes = scratch.save(classes_of(narrow, "vec_id", "vec", "label"), "nodes")
    nodes = nodes.withColumn("root", F.col("node"))
    k, graph = NEIGHBOURS, None
    for audit in range(AUDITS):
        met = scratch.save(first_graph(nodes, scratch, k, similarity, audit), f"met{audit}")
        for turn in itertools.count():
            more = not met.where("link").isEmpty()
            if more:
                nodes = merged(nodes, met, scratch, f"nodes{audit}-{turn}")
            if turn >= ROUNDS and not more:
                break
            edges = met.where("not link").select("node", "other", "sim")
            edges = edges if graph is None else graph.select("node", "other", "sim").union(edges)
            graph = scratch.save(listed(edges, nodes, k), f"graph{audit}-{turn}")
            met = scratch.save(joined(graph, nodes, k, similarity), f"met{audit}-{turn}")
        roots = nodes.where("node != root").select("node", "root")
        roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        found = scratch.save(counted(roots, nodes.drop("root"), similarity), f"counted{audit}")
        share = audited(nodes, found, similarity)
        if share >= AUDIT:
            break
        k *= 2
    else:
        nodes, found = exact(nodes, similarity, scratch)
    named = nodes.select(F.col("space.label").alias("label"), "vec", "node", "copies", "root").join(found, "node", "left")
    named = named.select("label", "vec", F.col("root").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = narrow.join(named, ["label", "vec"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_embedding_neighbours(spark, sf_dir: str) -> DataFrame:
    """All embeddings, nulls, zeros, ties and repeats as ``near_duplicates`` treats them."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
