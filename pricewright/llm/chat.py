"""Chat formatting: collapse cumulative snapshots, then render.

A chat that is logged after every turn leaves a conversation for each of its states, each a
prefix of the next. A turn's rolling hash covers all turns up to it: two independent running
sums of hashes that include the turn's place. A conversation whose last rolling hash stands
inside a longer one is a snapshot of it and goes; of equal conversations the one with the
smallest id stays. Running sums are taken in runs of turns, then over the runs, so that one
very long conversation is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Turns in a run, and bits of a hash (their sums stay within a long for 2**23 turns).
RUN, BITS = 1000, 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What both marks begin with, and how roles and texts that hold it are written.
MARK, ESCAPED = "<|im_", "<\\|im_"


def _hash(seed: int) -> Column:
    said = [x for c in ("role", "text") for x in (F.coalesce(F.col(c), F.lit("")), F.col(c).isNull())]
    return F.pmod(F.xxhash64(F.lit(seed), F.col("place"), *said), F.lit(2**BITS))


def _running(rows: DataFrame, order: list[Column], made: dict[str, Column]) -> DataFrame:
    """rows and, for each of made, its sum over the conversation up to and with the row."""
    local = W.partitionBy("conv", "run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv").orderBy(F.col("run").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "run").agg(*[F.sum(c).alias(f"_{k}") for k, c in made.items()])
    sums = sums.select(F.col("conv").alias("_conv"), F.col("run").alias("_run"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in made])
    here = rows.select("*", *[F.sum(c).over(local).alias(k) for k, c in made.items()])
    met = here.join(sums, F.col("conv").eqNullSafe(F.col("_conv")) & F.col("run").eqNullSafe(F.col("_run")))
    return met.select(*rows.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in made])


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, h1, h2): the rolling hashes. Turns stand by number (null last), then
    role and text; repeated rows are turns of their own."""
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("run", F.floor(F.col("turn") / RUN))
    order = [F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]
    placed = _running(rows, order, {"place": F.lit(1).cast("long")})
    return _running(placed.withColumns({"x1": _hash(1), "x2": _hash(2)}), [F.col("place")], {"h1": F.col("x1"), "h2": F.col("x2")}).select("conv", "place", "h1", "h2")


def maximal(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies): conversations that are no proper prefix of another; of
    equal ones the smallest id (null only if there is no other), n_copies of them in all."""
    scratch = Scratch(turns.sparkSession, "chat")
    rolling = scratch.save(prefixes(turns, conv_id, turn, role, text), "rolling")
    whole = rolling.groupBy("conv").agg(F.max(F.struct("place", "h1", "h2")).alias("e")).select("conv", "e.*")
    whole = scratch.save(whole, "whole")
    distinct = whole.groupBy("place", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    ends = whole.select(F.col("conv").alias("_conv"), F.col("place").alias("_last"))
    inside = rolling.join(ends, F.col("conv").eqNullSafe(F.col("_conv"))).where("place < _last").select("place", "h1", "h2").distinct()
    return distinct.join(inside, ["place", "h1", "h2"], "left_anti").select("conv", F.col("place").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies, rendered.

    Rows with a null conv_id are one conversation. A null role or text is rendered as an
    empty one, but is not equal to it. Turns stand by number, then role and text; repeated
    rows are turns of their own. A mark inside a role or text is written with a backslash
    (MARK as ESCAPED), so that no text opens or closes a turn. An empty table gives an
    empty one; further columns are not read. A rendered conversation is one value, so its
    turns meet in one row.
    """
    kept = Scratch(turns.sparkSession, "chat-kept").save(maximal(turns, conv_id, turn, role, text), "kept")
    rows = turns.select(F.col(conv_id).alias("_id"), F.struct(F.col(turn).isNull().alias("late"), F.col(turn).alias("t"), F.col(role).isNull().alias("no_role"), F.col(role).alias("role"), F.col(text).isNull().alias("no_text"), F.col(text).alias("text")).alias("said"))
    own = rows.join(kept, F.col("_id").eqNullSafe(F.col("conv"))).groupBy("conv", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("said")).alias("said"))
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(MARK), F.lit(ESCAPED))
    line = F.transform("said", lambda s: F.concat(F.lit(OPEN), plain(s["role"]), F.lit("\n"), plain(s["text"]), F.lit(CLOSE + "\n")))
    return own.select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", F.array_join(line, "").alias("rendered"))


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, nulls, ties and repeats as ``rendered`` treats them."""
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The same on lists of turns, without hashes.
OP7_SQL = r"""
WITH whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS said FROM conversations GROUP BY conv_id
), once AS (
  SELECT min(conv_id) AS conv_id, len(said) AS n_turns, count(*) AS n_copies, said FROM whole GROUP BY said
)
SELECT conv_id, n_turns, n_copies,
       array_to_string(list_transform(said, lambda s: '<|im_start|>' || replace(coalesce(s.role, ''), '<|im_', '<\|im_') || chr(10)
                                      || replace(coalesce(s.text, ''), '<|im_', '<\|im_') || '<|im_end|>' || chr(10)), '') AS rendered
FROM once a WHERE NOT EXISTS (SELECT 1 FROM once b WHERE b.said[1] = a.said[1] AND b.n_turns > a.n_turns AND b.said[1:a.n_turns] = a.said)
"""
