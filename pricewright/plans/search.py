"""Ranked search of a table of queries in a catalog of products.

queries: (query_id, text); catalog: (product). Queries and products meet in equi-joins on words
and on short pieces of their texts, so both tables may grow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_text, standardize_name, words
from ..shipping import ship_package

#: Least ratio of a fuzzy match.
FUZZY = 0.78
#: Characters of the pieces under which variants meet the names that hold them.
PIECE = 3


def expand_queries(queries: DataFrame, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_id, variant): the normalised text, its word key and the synonyms of either."""
    known = F.create_map(*[x for k, v in (synonyms or {"": []}).items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    text = normalize_text(F.col("text"))
    key = F.coalesce(standardize_name(F.col("text")), F.lit(""))
    more = lambda c: F.transform(F.coalesce(known[c], F.array().cast("array<string>")), normalize_text)
    every = F.array_distinct(F.concat(F.array(text, key), more(text), more(key)))
    return queries.select("query_id", F.explode(F.filter(every, lambda v: v != "")).alias("variant"))


def pieces(text: Column, n: int) -> Column:
    """The pieces of n characters of a text, from left to right."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def holding(products: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, variant, product, name) of names that hold the variant: they hold all its
    pieces, so both meet under the one that the fewest names hold."""
    index = products.select("product", "name", F.explode(F.array_distinct(F.concat(*[pieces(F.col("name"), n) for n in range(1, PIECE + 1)]))).alias("piece"))
    names = index.groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    longest = F.when(F.length("variant") >= PIECE, pieces(F.col("variant"), PIECE)).otherwise(F.array("variant"))
    sought = asked.select("query_id", "variant", F.explode(F.array_distinct(longest)).alias("piece")).join(names, "piece")
    rarest = sought.groupBy("query_id", "variant").agg(F.min(F.struct("names", "piece")).alias("m")).select("query_id", "variant", F.col("m.piece").alias("piece"))
    return rarest.join(index, "piece").where(F.contains(F.col("name"), F.col("variant"))).drop("piece")


def named(catalog: DataFrame) -> DataFrame:
    """(product, name), the normalised product; a name that the catalog has already stays."""
    return catalog.select("product", F.col("name") if "name" in catalog.columns else normalize_text(F.col("product")).alias("name"))


def matches(variants: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, product, match_rank, score), the best match of each: equal names 0; all the
    variant's words among the product's 1; the variant inside the name 2, by its share of it."""
    products = named(catalog)
    products = products.withColumn("tokens", F.array_distinct(words(F.col("name"))))
    asked = variants.withColumn("wanted", F.array_distinct(words(F.col("variant"))))
    per_word = products.select("product", "name", F.explode("tokens").alias("word"))
    hit = asked.select("query_id", "variant", F.size("wanted").alias("n"), F.explode("wanted").alias("word")).join(per_word, "word")
    whole = hit.groupBy("query_id", "variant", "n", "product", "name").agg(F.count(F.lit(1)).alias("k")).where("k = n")
    by_words = whole.select("query_id", "product", F.when(F.col("name") == F.col("variant"), 0).otherwise(1).alias("match_rank"), F.when(F.col("name") == F.col("variant"), 1.0).otherwise(0.99).alias("score"))
    inside = holding(products, asked)
    by_text = inside.select("query_id", "product", F.lit(2).alias("match_rank"), (F.length("variant").cast("double") / F.length("name")).alias("score"))
    best = by_words.union(by_text).groupBy("query_id", "product").agg(F.min(F.struct("match_rank", (-F.col("score")).alias("s"))).alias("m"))
    return best.select("query_id", "product", F.col("m.match_rank").alias("match_rank"), (-F.col("m.s")).alias("score"))


def pairs_told(text: Column, short: int) -> Column:
    """The pairs of neighbouring characters of a text, numbered where one comes again, and of
    a text shorter than short its single characters too."""
    at = pieces(text, 2)
    told = F.transform(at, lambda p, i: F.concat(p, F.size(F.filter(F.slice(at, 1, i + 1), lambda x: x == p)).cast("string")))
    return F.concat(told, F.when(F.length(text) < short, F.array_distinct(pieces(text, 1))).otherwise(F.array().cast("array<string>")))


def fuzzy_candidates(variants: DataFrame, products: DataFrame, least: float) -> DataFrame:
    """(query_id, variant, product, name): all that may have the ratio, and few others.

    A ratio r of lengths a and b matches r (a + b) / 2 characters and leaves (1 - r) (a + b);
    each of these parts at most one pair of matched neighbours. So (a + b) (1.5 r - 1) - 1 pairs
    at least are common; of the variant's pairs all but one fewer than that, the rarest, find
    every product. Texts too short for a common pair share a character."""
    if least <= 2 / 3:
        raise ValueError("texts share pairs of characters only above a ratio of 2 / 3")
    slope = 1.5 * least - 1
    short = int(1 / slope + 1e-9)
    index = products.select("product", "name", F.explode(F.array_distinct(pairs_told(F.col("name"), short))).alias("piece"))
    names = index.groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    b = F.length("variant")
    common = F.greatest(F.ceil((b + b * least / (2 - least)) * slope - 1 - 1e-9), F.lit(1))
    sought = variants.select("query_id", "variant", F.when(b < short, F.lit(1)).otherwise(common).alias("common"), F.explode(F.array_distinct(pairs_told(F.col("variant"), short))).alias("piece"))
    by = W.partitionBy("query_id", "variant")
    place = F.row_number().over(by.orderBy(F.coalesce("names", F.lit(0)), "piece"))
    ranked = sought.join(names, "piece", "left").select("query_id", "variant", "piece", "common", place.alias("place"), F.count(F.lit(1)).over(by).alias("n"))
    lengths = 2 * F.least(F.length("name"), b) >= least * (F.length("name") + b) - 1e-9
    met = ranked.where(F.col("place") <= F.col("n") - F.col("common") + 1).select("query_id", "variant", "piece").join(index, "piece").where(lengths)
    return met.select("query_id", "variant", "product", "name").distinct()


def fuzzy_matches(variants: DataFrame, catalog: DataFrame, least: float = FUZZY) -> DataFrame:
    """(query_id, product, match_rank 3, score) by the sequence ratio of the names. The edit
    distance bounds the ratio from above, so few pairs reach Python."""
    ship_package(catalog.sparkSession)
    products = named(catalog)
    near = F.levenshtein("name", "variant") <= (1 - least) * (F.length("name") + F.length("variant")) + 1e-9
    pairs = fuzzy_candidates(variants, products, least).where(near)
    scored = pairs.select("query_id", "product", sequence_ratio()("variant", "name").alias("score")).where(F.col("score") >= least)
    return scored.groupBy("query_id", "product").agg(F.max("score").alias("score")).select("query_id", "product", F.lit(3).alias("match_rank"), "score")


def sequence_ratio():
    """Twice the matched characters over all (Ratcliff and Obershelp), on Arrow batches."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return ratio


def search_rank(queries: DataFrame, catalog: DataFrame, limit: int | None = None, synonyms: dict | None = None) -> DataFrame:
    """(query_id, product, match_rank, score, place): all matches of each query in order: tier,
    score, fewer words, name. Products that no earlier tier hit go to the fuzzy tier."""
    variants = expand_queries(queries, synonyms)
    found = matches(variants, catalog)
    fuzzy = fuzzy_matches(variants, catalog).join(found, ["query_id", "product"], "left_anti")
    every = found.union(fuzzy)
    order = W.partitionBy("query_id").orderBy("match_rank", F.desc("score"), F.size(words(F.lower("product"))), "product")
    ranked = every.withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= limit) if limit else ranked


def search_groups(ranked: DataFrame) -> DataFrame:
    """(query_id, n_safe, products): the products of each query in order, in one row."""
    return ranked.groupBy("query_id").agg(F.count_if(F.col("match_rank") <= 1).alias("n_safe"), F.transform(F.array_sort(F.collect_list(F.struct("place", "product"))), lambda x: x["product"]).alias("products"))
