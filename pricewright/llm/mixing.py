"""Mix sources to target weights by weighted sampling without replacement.

Each document draws an exponential key scaled by its quality weight (Efraimidis and
Spirakis: the smallest ``-ln(u) / weight`` come first, as the largest ``u ** (1 / weight)``
do). Within a source the documents stand in the order of their keys; a source takes whole
epochs of itself first and then the documents whose running size fits what is left of its
target. The running sizes are never computed by sorting a source: sizes are summed by the
leading digits of the key, the digit in which the budget ends is opened at the next level,
and after LEVELS such aggregates the key at which the budget ends is known exactly. A source
with a third of all documents therefore costs a few partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, Scratch, bounded_broadcast

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 20240601
WORD = r"[^\x20\x09-\x0D]+"
#: Keys are integers below 2 ** (LEVELS * BITS).
LEVELS, BITS, SCALE = 7, 8, 2.0**45
LEAST_WEIGHT = 0.05
#: Sources that one task puts in order.
SOURCES_A_TASK = 100_000


def letter_share(text: Column) -> Column:
    """The default quality weight: the share of letters among a text's characters."""
    t = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(t, r"\P{L}+", "")) / F.greatest(F.length(t), F.lit(1))


def digest(doc_id: str, text: str, source: str) -> Column:
    """What a row's draw depends on: rows with equal digests are told apart by their number."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    return F.md5(F.concat_ws("\x01", F.lit(str(SEED)), part(doc_id), part(source), part(text)))


def drawn(of: Column, number: Column, weight: Column) -> Column:
    """The key of a row with this digest that is the so-and-so-many-th of its like."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", of, number.cast("string"))), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)
    w = F.greatest(F.least(F.coalesce(weight.cast("double"), F.lit(LEAST_WEIGHT)), F.lit(1.0)), F.lit(LEAST_WEIGHT))
    return F.least(F.floor(-F.log(u) / w * SCALE), F.lit(2 ** (LEVELS * BITS) - 1)).cast("long")


def numbered(rows: DataFrame, of: str, scratch: Scratch, name: str) -> DataFrame:
    """rows and _number, from 1 on over rows with an equal digest. They are numbered within a
    partition first, then over the partitions, so no task gets all rows of one digest. Which
    of equal rows gets which number is left open."""
    again = scratch.save(rows.groupBy(of).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(of).alias("_of")), f"{name}-again")
    if again.isEmpty():
        return rows.withColumn("_number", F.lit(1).cast("long"))
    again = bounded_broadcast(again)
    equal = rows.join(again, F.col(of) == F.col("_of"), "left_semi").withColumn("_part", F.spark_partition_id())
    equal = scratch.save(equal.withColumn("_at", F.monotonically_increasing_id()), f"{name}-equal")
    sizes = equal.groupBy(of, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(of).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(of).alias("_of"), F.col("_part").alias("_p"), before.alias("_before"))
    here = equal.withColumn("_row", F.row_number().over(W.partitionBy(of, "_part").orderBy("_at")))
    told = here.join(sizes, (F.col(of) == F.col("_of")) & (F.col("_part") == F.col("_p"))).select(*rows.columns, (F.col("_row") + F.col("_before")).cast("long").alias("_number"))
    return rows.join(again, F.col(of) == F.col("_of"), "left_anti").withColumn("_number", F.lit(1).cast("long")).union(told)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], n: int, scratch: Scratch, name: str) -> DataFrame:
    """rows and, for each of sums, its total over the rows before in the order. The rows are
    dealt by ranges into parts for SOURCES_A_TASK each; the parts' totals are summed apart."""
    parts = 1 + n // SOURCES_A_TASK
    dealt = scratch.save(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{k}").over(upto), F.lit(0)).alias(f"_{k}") for k in sums])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    here = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(k) for k, c in sums.items()])
    return here.join(F.broadcast(totals), F.col("_part") == F.col("_p")).select(*rows.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), one row a source: target is added. The targets share all
    sizes by weight (weights repeat over the sources by code point, null last); one that
    would pass cap times its source's size stops there and the excess is shared again.
    In the order of cap * size / weight the sources that stop come first, so running sums
    over the sources, not rounds, find the level of the others."""
    n, one = sizes.count(), F.lit(1).cast("long")
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"_r": one}, n, scratch, "by-name")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", cap * F.col("source_size").cast("double")).withColumn("_at", F.col("_cap") / F.col("_w"))
    met = running(ranked, [F.col("_at"), F.col("_r")], {"_caps": F.col("_cap"), "_ws": F.col("_w")}, n, scratch, "by-level")
    total = ranked.agg(F.sum(F.col("source_size").cast("double")).alias("_sizes"), F.sum("_w").alias("_weights"))
    level = (F.col("_sizes") - F.col("_caps")) / (F.col("_weights") - F.col("_ws"))
    final = met.join(F.broadcast(total)).select("_at", level.alias("_level")).agg(F.max(F.when(F.col("_at") > F.col("_level"), F.col("_level"))).alias("_final"))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("_cap"), F.col("_w") * F.coalesce("_final", F.lit(0.0))))
    return ranked.join(F.broadcast(final)).select("source", "source_size", target.alias("target"))


def plan(sized: DataFrame, scratch: Scratch, weights=WEIGHTS, cap: int = MAX_EPOCHS) -> tuple[DataFrame, bool]:
    """From rows (source, size, key): one row a source with source_size, target, epochs and
    last_key; a document is taken epochs times, and once more if its key <= last_key. And
    whether the sources are few enough to be broadcast."""
    sizes = scratch.save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = targets(sizes, scratch, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    state = goal.withColumn("epochs", whole).withColumn("left", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))).withColumn("prefix", F.lit(0).cast("long"))
    state = scratch.save(state.withColumn("open", F.col("left") > 0).withColumnRenamed("source", "s"), "state0")
    small = state.count() <= BROADCAST_ROWS
    side = F.broadcast if small else lambda df: df
    narrow = sized.select("source", "size", "key")
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        digits = (
            narrow.join(side(state.where("open").select("s", "prefix", "left")), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("key", shift + BITS) == F.col("prefix")))
            .groupBy("s", F.shiftright("key", shift).alias("next"), "left")
            .agg(F.sum("size").cast("double").alias("here"))
        )
        upto = digits.withColumn("upto", F.sum("here").over(W.partitionBy("s").orderBy("next")))
        # the first digit that the budget doesn't cover whole
        ends = upto.where(F.col("upto") > F.col("left")).groupBy("s").agg(F.min(F.struct("next", "upto", "here")).alias("e")).select(F.col("s").alias("s2"), "e.*")
        state = scratch.save(
            state.select("s", "source_size", "target", "epochs", "left", "open").join(side(ends), F.col("s").eqNullSafe(F.col("s2")), "left").select(
                "s", "source_size", "target", "epochs", "open",
                F.coalesce(F.col("left") - (F.col("upto") - F.col("here")), F.lit(0.0)).alias("left"),
                F.coalesce("next", F.lit(-1)).alias("prefix"),
                F.coalesce("here", F.lit(0.0)).alias("here"),
            ),
            f"state{level + 1}",
        )
    # the document at which the budget ends is taken if that comes nearer to the target
    last = F.when(F.col("here") - F.col("left") < F.col("left"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    return state.select(F.col("s"), "source_size", "target", "epochs", F.when(F.col("open"), last).otherwise(-1).alias("last_key")), small


def sized_rows(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, source: str, quality: Column | None) -> DataFrame:
    """(doc_id, source, size, key), a row for each of docs."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    weight = letter_share(F.col(text)) if quality is None else quality
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), weight.cast("double").alias("weight"), digest(doc_id, text, source).alias("of"))
    told = numbered(scratch.save(rows, "rows"), "of", scratch, "rows")
    return scratch.save(told.select("doc_id", "source", "size", drawn(F.col("of"), F.col("_number"), F.col("weight")).alias("key")), "sized")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights=WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, times, taken.

    size: words of the text (null: 0); times: whole copies that the mix takes, cap at most;
    taken = times * size. A source's taken words miss its target by half a document at most.
    Null sources are one source, the last; null and empty texts have size 0 and are never in
    the way; repeated rows (equal in id, source and text) each draw their own key, so a source
    of them comes as near to its target as any; an empty table gives an empty one. Keys depend
    on the rows alone, so reruns agree. Only the three columns are read, whatever others there are.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = sized_rows(docs, scratch, doc_id, text, source, quality)
    found, small = plan(sized, scratch, weights, cap)
    times = F.col("epochs") + F.when(F.col("key") <= F.col("last_key"), 1).otherwise(0)
    return (
        sized.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken"))
    )


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights=WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs as the mix takes them: each as many times as ``mix`` says, unchanged.
    Of rows equal in id, source and text as many stay as ``mix`` takes, whichever they are.
    Columns named _of, _number and the like are kept apart from those used here."""
    scratch = Scratch(docs.sparkSession, "mixing")
    found, small = plan(sized_rows(docs, scratch, doc_id, text, source, quality), scratch, weights, cap)
    found = found.select(F.col("s").alias("_s"), F.col("epochs").alias("_epochs"), F.col("last_key").alias("_last"))
    row = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(source).alias("_source"), (letter_share(F.col(text)) if quality is None else quality).alias("_weight"), digest(doc_id, text, source).alias("_digest"))
    told = numbered(row, "_digest", scratch, "docs")
    times = F.col("_epochs") + F.when(drawn(F.col("_digest"), F.col("_number"), F.col("_weight")) <= F.col("_last"), 1).otherwise(0)
    taken = told.join(F.broadcast(found) if small else found, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_times", times.cast("int")).where(F.col("_times") > 0)
    return taken.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_doc.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, null sources and texts, ties and repeats as ``mix`` treats them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "times")


#: The same with a sort of each source in place of the sums by digits.
OP4_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '\P{L}+', '', 'g')) / greatest(length(coalesce(text, '')), 1) AS share,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         md5('20240601' || chr(1) || coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(1) || coalesce(source, chr(0)) || chr(1) || coalesce(text, chr(0))) AS of
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY of) AS number, greatest(least(share, 1.0::DOUBLE), 0.05::DOUBLE) AS w FROM rows
), keyed AS (
  SELECT doc_id, source, size, least(floor(-ln((CAST(CAST('0x' || md5(of || ':' || number)[:13] AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE) / w * 35184372088832.0::DOUBLE), 72057594037927935.0::DOUBLE) AS key FROM numbered
), sizes AS (
  SELECT source, sum(size)::DOUBLE AS source_size FROM keyed GROUP BY 1
), ranked AS (
  SELECT source, source_size, r, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][r % 3 + 1] AS w, 3 * source_size AS cap FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sizes)
), levels AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), goals AS (
  SELECT *, floor(target / nullif(source_size, 0) + 1e-9) AS epochs
  FROM (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, w * coalesce((SELECT max(level) FROM levels WHERE cap / w > level), 0)) END AS target FROM ranked)
), spent AS (
  SELECT k.*, source_size, target, coalesce(epochs, 0) AS epochs, greatest(target - coalesce(epochs, 0) * source_size, 0) AS budget,
         sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
), chosen AS (
  SELECT *, CAST(epochs + CASE WHEN budget > 0 AND (upto <= budget OR (upto - size < budget AND upto - budget < budget - (upto - size))) THEN 1 ELSE 0 END AS BIGINT) AS times FROM spent
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(times * size AS BIGINT) AS taken, times FROM chosen
"""
