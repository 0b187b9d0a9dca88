"""Near-duplicate documents: bottom-k sketches from one hash function.

A document is the set of its hashed word shingles. It keeps the SKETCH smallest values
(its bottom-k sketch) and, of each of 128 ranges of values, one bit of the smallest one.
Documents with equal sets form a class, which from then on counts once. Each kept value has
an inverted list of classes. Two sets with the similarity sought share so many kept values
that they must share one among the rarest of each (prefix filtering), so only those values
have lists; common word pairs have none. Inside the lists, the bits estimate how much of the
union two sketches share, and only pairs that may reach the similarity go on to be compared
on their whole texts.

Large groups are never expanded into pairs: every member of a list meets one member of it,
in turn with other choices. Pairs that may link form clusters, those of them that do link
form components; in a large cluster each document meets a few others of it besides. Only
documents outside their cluster's largest component are then compared with the others, block
by block in memory. A block yields the links that join its components, one for each that it
joins, and not all pairs that link. No list is cut: one that is very long is dealt to many
tasks in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .graph import components
from .grouped import by_group
from .scratch import Scratch, bounded_broadcast
from .workers import handing_back

SIMILARITY, SHINGLE, SKETCH = 0.8, 5, 64
#: Deviations below the mean that a sketch's overlap may lie: a link is missed about once in 10**7.
SAFE = 5.3
#: Members of a list that one block holds, and text handled at a time in a worker (its words
#: and values take some forty times as much).
BLOCK, CHUNK_BYTES = 2000, 1 << 18
STAR_ROUNDS = 2
#: Members of a cluster that meet at a time.
MEMBERS = 256
#: Members of a cluster of more than MEMBERS whom all its others meet.
CENTRES = 8
#: Hashes of wanted texts that are broadcast at most; beyond them the texts are shuffled.
HASHES = 1_000_000

_U = np.uint64
_POWER = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(64, _POWER, dtype=_U))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _POWER, dtype=_U))
    return _POWERS


def shingle_values(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end (UTF-8, text i from bounds[i] to bounds[i + 1]): the hash of
    each shingle, and where those of each text begin (one more than there are texts). A
    text of fewer words than a shingle has one, of all its words; one without words, none."""
    n_texts = len(bounds) - 1
    if not len(data):
        return np.zeros(0, _U), np.zeros(n_texts + 1, np.int64)
    word = ~_GAP[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = bounds[1:-1]
    edges = edges[edges < len(data)]
    first[edges] |= word[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(n_texts + 1, np.int64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    longest = int(place[word].max()) + 1
    terms = np.where(word, _LOWER[data].astype(_U) + _U(1), _U(0)) * _powers(longest)[np.where(word, place, 0)]
    words = _mix(np.add.reduceat(terms, starts) + np.add.reduceat(word.astype(_U), starts))
    text_of = np.searchsorted(bounds, starts, "right") - 1
    per_text = np.bincount(text_of, minlength=n_texts)
    word_at = np.concatenate([[0], np.cumsum(per_text)])
    value = np.zeros(len(words), _U)
    for k in range(shingle):
        follow = np.zeros(len(words), _U)
        follow[: len(words) - k] = words[k:]
        here = np.zeros(len(words), bool)
        here[: len(words) - k] = text_of[k:] == text_of[: len(words) - k]
        value = np.where(here, _mix(value * _POWER + follow + _U(k)), value)
    count = np.where(per_text == 0, 0, np.maximum(per_text - shingle + 1, 1))
    keep = np.arange(len(words)) - word_at[text_of] < count[text_of]
    return value[keep], np.concatenate([[0], np.cumsum(count)])


def _laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def text_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column, a part of it at a time."""
    data, bounds = _laid_out(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK_BYTES, "right")) - 1)
        values, at = shingle_values(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], shingle)
        for i in range(hi - lo):
            yield np.unique(values[at[i] : at[i + 1]])
        lo = hi


def range_bits(values: np.ndarray) -> tuple[int, int]:
    """One bit of the smallest value in each of 128 ranges (by other bits of the value), as
    two signed 64-bit numbers; a range without values has 0."""
    mixed = _mix(values ^ _U(0x5851F42D4C957F2D))
    smallest = np.full(128, np.iinfo(np.uint64).max, _U)
    np.minimum.at(smallest, (mixed >> _U(57)).astype(np.int64), mixed << _U(7))
    bits = np.where(smallest == np.iinfo(np.uint64).max, 0, (_mix(smallest) & _U(1)).astype(np.uint8))
    return tuple(int(x) for x in np.packbits(bits.astype(np.uint8)).view(">i8"))


ROWS = "doc_id long, text_hash long, n int, digest binary, sketch array<long>, bits1 long, bits2 long"


def sketched(docs: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """One row for each row of docs, see ROWS; rows have equal digests if their sets are equal."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch, one, two = [], [], [], [], []
            for values in text_sets(batch.column(2), shingle):
                n.append(len(values))
                digest.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                sketch.append(values[:k].view(np.int64))
                b = range_bits(values)
                one.append(b[0])
                two.append(b[1])
            flat = np.concatenate(sketch) if sketch else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sketch])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), lists, pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "digest", "sketch", "bits1", "bits2"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(handing_back(run), ROWS)


def least_shared(n: Column, k: int = SKETCH, similarity: float = SIMILARITY) -> Column:
    """Kept values that a set of n must share with any that is similar: exact while both
    sets are kept whole, else SAFE deviations below the mean of a draw without replacement."""
    exact = F.ceil(similarity * n - 1e-9)
    spread = F.sqrt(F.greatest(k * similarity * (1 - similarity) * (1 - k * similarity / n), F.lit(0.0)))
    return F.when(n <= similarity * k, exact).otherwise(F.least(exact, F.floor(similarity * k - SAFE * spread))).cast("int")


def most_differing(n: Column, similarity: float = SIMILARITY) -> Column:
    """Bits in which a set of n may differ from one that is similar."""
    q = (1 - similarity) / 2
    used = 128 * (1 - F.exp(-n / similarity / 128))
    return F.least(q * used + 6 * F.sqrt(q * (1 - q) * used) + 2, (1 - similarity) / similarity * n)


def lists(classes: DataFrame, scratch: Scratch, k: int = SKETCH, similarity: float = SIMILARITY) -> DataFrame:
    """(value, cid, n, bits1, bits2, most, blocks): the inverted lists of the rarest kept
    values. A value that only one class keeps takes its place but needs no list."""
    kept = classes.where("n > 0").select("cid", F.explode("sketch").alias("value"))
    shared = kept.groupBy("value").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    common = kept.join(shared, "value").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("many", "value"))).alias("by_rarity"))
    n = F.col("n")
    held = F.least(n, F.lit(k))
    room = held - least_shared(n, k, similarity) + 1 - (held - F.size("by_rarity"))
    chosen = classes.drop("sketch").join(common, "cid").where(room > 0).select("cid", "n", "bits1", "bits2", most_differing(n, similarity).alias("most"), F.explode(F.slice("by_rarity", F.lit(1), room)).alias("v"))
    return scratch.save(chosen.select(F.col("v.value").alias("value"), "cid", "n", "bits1", "bits2", "most", F.ceil(F.col("v.many") / BLOCK).cast("int").alias("blocks")), "lists")


def _may_link(similarity: float) -> Column:
    """Of rows x and y of one list: sizes and bits allow the similarity."""
    apart = F.bit_count(F.col("x.bits1").bitwiseXOR(F.col("y.bits1"))) + F.bit_count(F.col("x.bits2").bitwiseXOR(F.col("y.bits2")))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    return (small >= similarity * large - 1e-9) & (apart <= F.greatest("x.most", "y.most"))


def star_pairs(labelled: DataFrame, turn: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): of each list, its first member in the order of this turn and each other one
    of another component; a member keeps the centre that looks most alike."""
    centre = labelled.groupBy("value").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "root").alias("h"), "cid", "n", "bits1", "bits2", "most", "root")).alias("c")).select("value", "c.*")
    apart = F.bit_count(F.col("x.bits1").bitwiseXOR(F.col("y.bits1"))) + F.bit_count(F.col("x.bits2").bitwiseXOR(F.col("y.bits2")))
    near = labelled.alias("x").join(centre.alias("y"), "value").where((F.col("x.root") != F.col("y.root")) & _may_link(similarity))
    best = near.groupBy(F.col("x.cid").alias("a")).agg(F.min(F.struct(apart.alias("d"), F.col("y.cid").alias("b"))).alias("m"))
    return best.select("a", F.col("m.b").alias("b"))


def matched(posted: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of posted with another row in their list that they may link with. Rows of
    a very long list meet block by block: each stands in its own and is sent to all."""
    open_ = (F.col("x.cid") != F.col("y.cid")) & _may_link(similarity)
    short = posted.where("blocks = 1")
    found = short.alias("x").join(short.alias("y"), (F.col("x.value") == F.col("y.value")) & open_, "left_semi")
    long_ = posted.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    sent = long_.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    far = long_.alias("x").join(sent.alias("y"), (F.col("x.value") == F.col("y.value")) & (F.col("x.block") == F.col("y.to")) & open_, "left_semi")
    return found.union(far.drop("block"))


def mixed_lists(labelled: DataFrame) -> DataFrame:
    """Rows of lists that hold more than one cluster: the others hold nothing new."""
    mixed = labelled.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("value")
    return labelled.join(mixed, "value", "left_semi")


def largest_roots(rows: DataFrame, key: str) -> DataFrame:
    """(key, main, size, guests) of each key whose rows have several roots: the root of most
    rows, all rows and those of other roots, its guests."""
    by_root = rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("rows"))
    found = by_root.groupBy(key).agg(F.max(F.struct("rows", "root")).alias("m"), F.sum("rows").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return found.select(key, F.col("m.root").alias("main"), "size", (F.col("size") - F.col("m.rows")).alias("guests"))


def guests_and_hosts(rows: DataFrame, key: str, at_a_time: int) -> DataFrame:
    """Rows (key, root, cid, more) as hosts and the guests among them once more as guests, with
    block and part such that a guest meets every host of its key once. A key, block and part
    has about at_a_time rows of either kind at most. Keys of one root have no guests."""
    share = lambda n: F.ceil(F.col(n) / at_a_time).cast("int")
    here = rows.join(largest_roots(rows, key).select(key, "main", share("size").alias("blocks"), share("guests").alias("parts")), key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    rest = [c for c in rows.columns if c != key]
    hosts = here.select(key, one_of("blocks").alias("block"), every("parts").alias("part"), F.lit(True).alias("host"), *rest)
    guests = here.where("root != main").select(key, every("blocks").alias("block"), one_of("parts").alias("part"), F.lit(False).alias("host"), *rest)
    return hosts.union(guests)


def joining(t: pa.Table, linked: Callable[[int, np.ndarray], np.ndarray]) -> pa.Table:
    """(a, b): links of guests with hosts that join the roots of t into what all its links
    would join them to, each of them between two that were apart: fewer than there are roots.
    linked(i, held) tells which of the hosts, rows held, row i links with."""
    ids = np.asarray(t.column("cid"))
    held = np.flatnonzero(np.asarray(t.column("host")))
    label = np.unique(np.asarray(t.column("root")), return_inverse=True)[1]
    a, b = [], []
    for i in np.setdiff1d(np.arange(len(ids)), held):
        apart = label[held] != label[i]
        if not apart.any():
            continue
        near = held[apart & linked(i, held)]
        met, first = np.unique(label[near], return_index=True)
        a += [int(ids[i])] * len(met)
        b += [int(x) for x in ids[near[first]]]
        if len(met):
            label[np.isin(label, met)] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crossing_pairs(labelled: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of one list that may link although their clusters differ, as many as
    join what all of them would."""

    def meet(t: pa.Table) -> pa.Table:
        n, most = np.asarray(t.column("n")), np.asarray(t.column("most"))
        bits = [np.asarray(t.column(c)).view(_U) for c in ("bits1", "bits2")]

        def linked(i: int, held: np.ndarray) -> np.ndarray:
            apart = sum(np.bitwise_count(x[held] ^ x[i]).astype(np.int64) for x in bits)
            sizes = np.minimum(n[held], n[i]) >= similarity * np.maximum(n[held], n[i]) - 1e-9
            return sizes & (apart <= np.maximum(most[held], most[i]))

        return joining(t, linked)

    rows = labelled.select("value", "root", "cid", "n", "bits1", "bits2", "most")
    return by_group(guests_and_hosts(rows, "value", BLOCK), ["value", "block", "part"], meet, "a long, b long")


def clusters(posted: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(cid, cluster) such that no two documents of different clusters may link, as far as
    sizes and bits tell, and the pairs (a, b) with list centres that were met on the way."""
    labelled, edges, stars = posted.withColumn("root", F.col("cid")), None, None
    for turn in range(STAR_ROUNDS):
        stars = scratch.save(star_pairs(labelled, turn, similarity), f"star{turn}")
        edges = stars if edges is None else edges.union(stars)
        roots = components(edges, scratch, f"cluster{turn}").withColumnRenamed("node", "cid")
        labelled = posted.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        labelled = scratch.save(mixed_lists(labelled), f"mixed{turn}")
    crossing = scratch.save(crossing_pairs(labelled, similarity), "crossing")
    roots = components(edges.union(crossing), scratch, "clusters")
    return roots.select(F.col("node").alias("cid"), F.col("root").alias("cluster")), edges.distinct()


def centre_pairs(grouped: DataFrame) -> DataFrame:
    """From (cid, cluster), (a, b): each member of a cluster of more than MEMBERS, and each of
    up to CENTRES members of it, so that few stay outside its largest component."""
    large = grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > MEMBERS).select("cluster")
    here = grouped.join(large, "cluster")
    order = F.xxhash64("cid")
    centres = here.groupBy("cluster", F.pmod(order, F.lit(CENTRES)).alias("slot")).agg(F.min_by("cid", order).alias("b"))
    return here.join(centres, "cluster").where("cid != b").select(F.col("cid").alias("a"), "b")


def linked_within(members: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """From members (cid, cluster, root): links (a, b) between different components of a
    cluster. All but the members of a cluster's largest component are its guests; a guest is
    compared on whole sets with every member, a block of MEMBERS at a time, and links are
    kept that join what all of them would. Clusters of one component have no guests."""
    percent = round(similarity * 100)

    def meet(t: pa.Table) -> pa.Table | None:
        host = np.asarray(t.column("host"))
        if host.all() or not host.any():
            return None
        sets = list(text_sets(t.column("text").combine_chunks(), shingle))
        held = np.flatnonzero(host)
        flat, sizes = np.concatenate([sets[i] for i in held]), np.array([len(sets[i]) for i in held])
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]

        def linked(i: int, _: np.ndarray) -> np.ndarray:
            own = sets[i]
            both = np.add.reduceat((own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat).astype(np.int64), at)
            return 100 * both >= percent * (sizes + len(own) - both)

        return joining(t, linked)

    rows = guests_and_hosts(members.select("cluster", "root", "cid"), "cluster", MEMBERS).join(texts, "cid").select("cluster", "block", "part", "host", "cid", "root", "text")
    return by_group(rows, ["cluster", "block", "part"], meet, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, k: int = SKETCH) -> DataFrame:
    """Of pairs (a, b): those whose whole sets have the similarity. The sketches' union is
    estimated first; only pairs that it leaves open are compared in full."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(text_sets(batch.column(2), shingle), text_sets(batch.column(3), shingle), strict=True)):
                p_in_q = np.isin(p[:k], q[:k], assume_unique=True)
                union = np.union1d(p[:k], q[:k])[:k]
                estimate = p_in_q[np.searchsorted(p[:k], union[np.isin(union, p[:k])])].sum() / max(1, len(union))
                if len(p) and len(q) and estimate >= similarity - 6 * math.sqrt(similarity * (1 - similarity) / k):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(handing_back(run), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, k: int = SKETCH) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash (xxhash64 of the text), n_shingles,
    group_id (any number, one for each component; null without shingles), component_id, kept.

    Words are lower-cased (A-Z); component_id is the smallest doc_id that links lead to.
    Empty and null texts have no shingle and link with nothing. Rows of one text or of one
    set belong together; a null doc_id never names a component unless no other is in it,
    then component_id is null and kept is true. Repeated rows are all kept or none. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.save(sketched(docs, doc_id, text, shingle, k), "rows")
    same = rows.where("n > 0").groupBy("digest", "n", "sketch", "bits1", "bits2").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"))
    classes = scratch.save(same.withColumn("cid", F.monotonically_increasing_id()), "classes")
    posted = scratch.save(matched(lists(classes, scratch, k, similarity), similarity), "matched")
    scratch.drop("lists")
    wanted = scratch.save(classes.join(posted.select("cid").distinct(), "cid", "left_semi").select("cid", "text_hash"), "wanted")
    source = docs.select(F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("text"))

    def texts_of(ids: DataFrame) -> DataFrame:
        hashes = wanted.join(ids.distinct(), "cid", "left_semi")
        return source.join(bounded_broadcast(hashes.select("text_hash"), HASHES), "text_hash", "left_semi").groupBy("text_hash").agg(F.min("text").alias("text")).join(hashes, "text_hash").select("cid", "text")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid")))

    grouped, stars = clusters(posted, scratch, similarity)
    grouped = scratch.save(grouped, "grouped")
    met = scratch.save(stars.union(centre_pairs(grouped)).distinct(), "met")
    links = scratch.save(verified(met, texts_of(ends(met)), shingle, similarity, k), "links")
    roots = components(links, scratch, "linked").withColumnRenamed("node", "cid")
    members = scratch.save(grouped.join(roots, "cid", "left").select("cid", "cluster", F.coalesce("root", "cid").alias("root")), "members")
    asked = members.join(largest_roots(members, "cluster").select("cluster"), "cluster", "left_semi").select("cid")
    more = scratch.save(linked_within(members, texts_of(asked), shingle, similarity), "more")
    roots = components(links.union(more), scratch, "roots")
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("digest", F.coalesce("root", "cid").alias("root"), "first_id")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_digest = scratch.save(named.join(smallest, "root").select("digest", "root", "component_id"), "named")
    out = rows.select("doc_id", "text_hash", "n", "digest").join(by_digest, "digest", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("root").alias("group_id"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, unchanged, of which no two are near-duplicates: of each component
    the row with the smallest doc_id (then one of its rows). Rows without shingles stay."""
    scratch = Scratch(docs.sparkSession, "minhash-stage")
    found = scratch.save(near_duplicates(docs, doc_id, text, shingle, similarity), "found")
    kept = found.where("kept")
    pick = kept.where("group_id is not null").groupBy("group_id").agg(F.min("text_hash").alias("text_hash"))
    grouped = kept.join(pick, ["group_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    alone = kept.where("group_id is null").groupBy("doc_id", "text_hash").agg(F.lit(1).cast("long").alias("rows"))
    keys = scratch.save(grouped.union(alone).select(F.col("doc_id").alias("_key_id"), F.col("text_hash").alias("_key_hash"), F.col("rows").alias("_rows")), "keys")
    hashed = docs.withColumn("_hash", F.xxhash64(F.col(text)))

    def having(which: DataFrame) -> DataFrame:
        return hashed.join(bounded_broadcast(which, HASHES), F.col(doc_id).eqNullSafe(F.col("_key_id")) & (F.col("_hash") == F.col("_key_hash")), "left_semi")

    rows = having(keys.where("_rows = 1"))
    repeated = keys.where("_rows > 1")
    if not repeated.isEmpty():
        rows = rows.union(having(repeated).dropDuplicates([doc_id, "_hash"]))
    return rows.select(*docs.columns)


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents on shingles of two words; nulls, empty texts, ties and repeats as
    ``near_duplicates`` treats them."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: The same without sketches: sets that share a shingle among their rarest are compared whole.
OP8_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT k, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM cut
), grams AS (
  SELECT k, len(s) AS n, unnest(s) AS g FROM sets
), ranked AS (
  SELECT k, n, g, row_number() OVER (PARTITION BY k ORDER BY many, g) AS r FROM (SELECT *, count(*) OVER (PARTITION BY g) AS many FROM grams)
), rare AS (
  SELECT k, n, g FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1
), pairs AS (
  SELECT DISTINCT x.k AS a, y.k AS b FROM rare x JOIN rare y ON x.g = y.g AND x.k < y.k AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
), shared AS (
  SELECT a, b, len(x.s) + len(y.s) AS total, len(list_intersect(x.s, y.s)) AS common FROM pairs JOIN sets x ON x.k = a JOIN sets y ON y.k = b
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 80 * (total - common)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT k, k AS other FROM sets UNION SELECT r.k, e.b FROM reach r JOIN edges e ON e.a = r.other
), named AS (
  SELECT r.k, min(o.doc_id) AS component_id FROM reach r JOIN sets o ON o.k = r.other GROUP BY r.k
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM sets JOIN named USING (k)
"""
