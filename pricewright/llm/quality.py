"""Quality rules with thresholds that adapt to each language and source.

Counts are taken of every whole text. For each (lang, source) a quantile sketch of each rate is
kept, of the documents that no base rule rejects: counts in buckets of the rate's BITS leading
binary digits, so a quantile is right to within one part in 2 ** (BITS - 1). Such sketches merge
by adding counts, in any order and with the same result, which lets them be pre-aggregated before
the shuffle and makes them a few hundred rows for a group however large.

A rate is a count over a size, as it is. Most rates are zero in most documents, so a sketch has
two parts: the share of zeros, and the quantiles of the rest, which say how large the rate is
where there is any. The threshold of a group is a fence above the quartiles of that rest,
drawn towards the fence of its language, and that towards the whole corpus's, the more the
fewer documents the rest has. No rate has a cutoff or an allowance of its own. The fences are
joined to the documents, and a document beyond one is not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_broadcast

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Leading binary digits of a sketch's buckets; rates are whole millionths.
BITS, UNIT = 8, 1_000_000
#: rate -> (count, size). Signs are characters that are neither letters nor white space.
RATES = {
    "sign_rate": ("n_signs", "word_chars"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}
#: Fence: the third quartile and so many times the distance between the quartiles, where
#: box plots begin to call a value far out.
REACH = 3
#: A group's fence counts as much as that of the next larger group when its sketch has so many
#: documents with the rate.
PRIOR = 20

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _windows(words: Column) -> Column:
    """The 3-word windows as (hash, place), sorted, so that equal ones are neighbours."""
    return F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )


def _repeated(windows: Column, words: Column) -> Column:
    """Places of the windows whose words stand elsewhere in the text too; equal hashes are
    confirmed on the words (two neighbours with one hash and other words need a collision
    of 64-bit hashes within one document)."""

    def same(x: Column, y: Column) -> Column:
        equal = x["h"] == y["h"]
        for k in range(3):
            equal = equal & (F.get(words, x["i"] + k) == F.get(words, y["i"] + k))
        return F.coalesce(equal, F.lit(False))

    found = F.filter(windows, lambda x, j: same(x, F.get(windows, j - 1)) | same(x, F.get(windows, j + 1)))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_signs"]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and its counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_upper, n_signs (long). A null text counts as an empty one: all zero."""
    t = F.coalesce(F.col(text), F.lit(""))
    at = docs.withColumn("_words", F.array_remove(F.split(t, WORD_GAP), ""))
    at = at.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    at = at.withColumn("_marks", F.regexp_replace(t, r"[\p{L}\p{M}\x20\x09-\x0D]+", ""))
    at = at.withColumn("_windows", _windows(F.col("_words")))
    at = at.withColumn("_at", _repeated(F.col("_windows"), F.col("_words")))
    symbols = F.length(F.regexp_replace("_marks", r"[^#*$%&|<>]+", ""))
    reach = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(3))))
    return at.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(reach, F.lit(0), lambda a, b: a + b).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length("_marks").cast("long").alias("n_signs"),
    )


def base_failed() -> Column:
    """Too few words, or too many of them repeat."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Each rate in whole millionths; 0 where the size is 0."""
    return {name: F.coalesce(F.floor(F.try_divide(F.col(count) * F.lit(float(UNIT)), F.col(size).cast("double"))), F.lit(0)).cast("long") for name, (count, size) in RATES.items()}


def _places(x: Column) -> Column:
    """Binary digits of x that its bucket leaves out."""
    return F.greatest(F.length(F.bin(x)) - BITS, F.lit(0))


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rate, bucket, n): one mergeable sketch for each group and rate, of the
    documents that pass the base rules; a bucket is its least value, that of zeros is 0."""
    cells = F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("x")) for k, v in rates().items()])
    # counted, not filtered: a filter would move below the counts and take them apart again
    rows = counted.select(F.col(lang).alias("lang"), F.col(source).alias("source"), (~base_failed()).cast("int").alias("passes"), F.explode(cells).alias("c")).select("lang", "source", "passes", "c.rate", "c.x")
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("x"), _places(F.col("x"))), _places(F.col("x")))
    return rows.groupBy("lang", "source", "rate", bucket.alias("bucket")).agg(F.sum("passes").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Of merged sketches: keys, rate, total (documents), rest (those with a rate above zero) and
    the fence over that rest, null where it is empty. A quantile is the largest value of the
    bucket that it lies in."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "rate")
    high = F.col("bucket") + F.call_function("shiftleft", F.lit(1).cast("long"), _places(F.col("bucket"))) - 1
    some = F.when(F.col("bucket") > 0, F.col("n")).otherwise(F.lit(0).cast("long"))
    upto = merged.select(*keys, "rate", high.alias("high"), F.sum(some).over(by.orderBy("bucket")).alias("upto"), F.sum(some).over(by).alias("rest"), F.sum("n").over(by).alias("total"))
    at = lambda q: F.min(F.when((F.col("upto") > 0) & (4 * F.col("upto") >= q * F.col("rest")), F.col("high")))
    quartiles = upto.groupBy(*keys, "rate").agg(F.max("total").alias("total"), F.max("rest").alias("rest"), at(1).alias("low"), at(3).alias("high"))
    return quartiles.select(*keys, "rate", "total", "rest", (F.col("high") + REACH * (F.col("high") - F.col("low"))).cast("double").alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source), as t_lang and t_source: max_ and the name of each rate.
    With n documents that have a rate, a fence counts n / (n + PRIOR), the fence of the next
    larger group the rest; null where no document of the corpus has the rate."""
    own, lang, all_ = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    l = lang.select(F.col("lang").alias("l_lang"), F.col("rate").alias("l_rate"), F.col("rest").alias("l_rest"), F.col("fence").alias("l_fence"))
    a = all_.select(F.col("rate").alias("a_rate"), F.col("fence").alias("a_fence"))
    joined = own.join(l, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate"))).join(a, F.col("rate") == F.col("a_rate"))

    def drawn(n: Column, fence: Column, wider: Column) -> Column:
        n = n.cast("double")
        return (n * F.coalesce(fence, F.lit(0.0)) + PRIOR * wider) / (n + PRIOR)

    fence = drawn(F.col("rest"), F.col("fence"), drawn(F.col("l_rest"), F.col("l_fence"), F.col("a_fence")))
    return joined.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*[F.max(F.when(F.col("rate") == k, fence)).alias(f"max_{k}") for k in RATES])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: its columns, the counts of ``with_counts``,
    base_failed and kept (never null), and the thresholds that held (max_...).

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT % of them repeat.
    kept: not base_failed, and no rate above the fence of its language and source.
    Null languages and sources form groups of their own; empty and null texts fail; equal
    rows are judged alike; an empty table gives an empty one. Columns of docs named like
    one of the results are replaced by it. Without keep_text the text column is left out,
    so that only counts are written between the two passes.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    made = {*COUNTS, "base_failed", "kept", "t_lang", "t_source", *(f"max_{k}" for k in RATES)}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made or c in ("_words", "_lines", "_marks", "_windows", "_at")])
    counted = with_counts(docs, text)
    counted = scratch.save(counted if keep_text else counted.drop(text), "counted")
    held = scratch.save(thresholds(sketches(counted, lang, source)), "fences")
    failed = base_failed()
    beyond = F.lit(False)
    for k, v in rates().items():
        beyond = beyond | F.coalesce(v > F.col(f"max_{k}"), F.lit(False))
    return (
        counted.join(bounded_broadcast(held), F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source")), "left")
        .select(*[c for c in docs.columns if keep_text or c != text], *COUNTS, failed.alias("base_failed"), (~failed & ~beyond).alias("kept"), *[f"max_{k}" for k in RATES])
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents, null and empty texts, ties and repeats as ``judge`` treats them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The kept rows (k) of documents as a query for DuckDB: the counts and the verdict.
KEPT_SQL = r"""
cut AS (
  SELECT *, row_number() OVER () AS k, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS g FROM cut, unnest(range(1, len(w) - 1)) AS u(i)
), repeated AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words
  FROM (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS many FROM grams) WHERE many > 1), range(0, 3) AS r(j) GROUP BY k
), counted AS (
  SELECT cut.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[\p{L}\p{M}\x20\x09-\x0D]+', '', 'g')) AS n_signs, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM cut LEFT JOIN repeated USING (k)
), cells AS (
  SELECT k, lang, source, base_failed, rate, coalesce(CAST(floor(n * 1000000.0::DOUBLE / nullif(size, 0)::DOUBLE) AS BIGINT), 0) AS x FROM (
    SELECT k, lang, source, base_failed, 'sign_rate' AS rate, n_signs AS n, word_chars AS size FROM counted
    UNION ALL SELECT k, lang, source, base_failed, 'dup_line_rate', n_dup_lines, n_lines FROM counted
    UNION ALL SELECT k, lang, source, base_failed, 'repeat_rate', n_repeat_words, n_words FROM counted
    UNION ALL SELECT k, lang, source, base_failed, 'upper_rate', n_upper, word_chars FROM counted
    UNION ALL SELECT k, lang, source, base_failed, 'word_length', word_chars, n_words FROM counted)
), sketch AS (
  SELECT lang, source, rate, ((x >> p) << p) + (1 << p) - 1 AS high, x > 0 AS has, count(*) AS n
  FROM (SELECT *, greatest(length(bin(x)) - 8, 0) AS p FROM cells WHERE NOT base_failed) GROUP BY ALL
), levels AS (
  SELECT 0 AS level, lang, source, rate, high, has, n FROM sketch UNION ALL SELECT 1, lang, NULL, rate, high, has, n FROM sketch UNION ALL SELECT 2, NULL, NULL, rate, high, has, n FROM sketch
), upto AS (
  SELECT level, lang, source, rate, high, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY high) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS rest
  FROM (SELECT level, lang, source, rate, high, sum(n) AS n FROM levels WHERE has GROUP BY ALL)
), fence AS (
  SELECT level, lang, source, rate, max(rest)::DOUBLE AS rest,
         CAST(min(high) FILTER (WHERE 4 * upto >= 3 * rest) + 3 * (min(high) FILTER (WHERE 4 * upto >= 3 * rest) - min(high) FILTER (WHERE 4 * upto >= rest)) AS DOUBLE) AS fence
  FROM upto GROUP BY ALL
), held AS (
  SELECT c.lang, c.source, c.rate, (coalesce(o.rest, 0) * coalesce(o.fence, 0) + 20 * ((coalesce(l.rest, 0) * coalesce(l.fence, 0) + 20 * a.fence) / (coalesce(l.rest, 0) + 20))) / (coalesce(o.rest, 0) + 20) AS fence
  FROM (SELECT DISTINCT lang, source, rate FROM cells) c LEFT JOIN fence o ON o.level = 0 AND o.rate = c.rate AND o.lang IS NOT DISTINCT FROM c.lang AND o.source IS NOT DISTINCT FROM c.source
  LEFT JOIN fence l ON l.level = 1 AND l.rate = c.rate AND l.lang IS NOT DISTINCT FROM c.lang JOIN fence a ON a.level = 2 AND a.rate = c.rate
), beyond AS (
  SELECT k FROM cells c JOIN held h ON h.rate = c.rate AND h.lang IS NOT DISTINCT FROM c.lang AND h.source IS NOT DISTINCT FROM c.source GROUP BY k HAVING bool_or(x > fence)
), judged AS (
  SELECT *, NOT base_failed AND k NOT IN (SELECT k FROM beyond) AS kept FROM counted
)"""
OP5_SQL = f"WITH {KEPT_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
