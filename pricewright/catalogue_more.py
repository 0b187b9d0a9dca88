"""Registered queries over rows that are filtered, repaired and listed."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import BASKETS, PRODUCT, basket_inputs, latest_sql, pivot_sql, query
from .functions import profiles as PR
from .plans import accounting, baskets, listings, matching, sections, standardize
from .sources import bindings as B
from .sources import groceries as G


@query("needs_review", f"WITH {latest_sql('source_product_name, source_name')}, {pivot_sql(PRODUCT)} SELECT source_product_name, comparison_confidence FROM compared WHERE n_sources = 2 AND comparison_confidence <> 'high'", "o")
def _(spark, d):
    """The catalog's rows whose comparison needs a review."""
    return accounting.by_coverage(matching.coverage_catalog(B.observations(spark, d)), "needs_review").select(PRODUCT, "comparison_confidence")


_DEAREST = "ORDER BY price DESC, run_id, line_number, source_product_id, supplier_id"


@query("top_then_category", f"SELECT run_id, line_number, source_product_name, CAST(price AS DOUBLE) AS price FROM (SELECT * FROM obs {_DEAREST} LIMIT 50) WHERE category_name = 'PROMO'", "o")
def _(spark, d):
    """Of the 50 dearest observations those of one category: the filter comes after the limit."""
    order = [F.desc("price"), "run_id", "line_number", "source_product_id", "supplier_id"]
    rows = accounting.top_then_category(B.observations(spark, d), "PROMO", 50, order)
    return rows.select("run_id", "line_number", "source_product_name", F.col("price").cast("double").alias("price"))


@query("top_of_category", f"SELECT run_id, line_number, source_product_name, CAST(price AS DOUBLE) AS price FROM (SELECT * FROM obs WHERE category_name = 'PROMO' {_DEAREST} LIMIT 50)", "o")
def _(spark, d):
    """The 50 dearest observations of one category."""
    order = [F.desc("price"), "run_id", "line_number", "source_product_id", "supplier_id"]
    rows = accounting.top_then_category(B.observations(spark, d), "PROMO", 50, order, filter_first=True)
    return rows.select("run_id", "line_number", "source_product_name", F.col("price").cast("double").alias("price"))


@query("shopping_list", f"WITH {BASKETS} SELECT basket_id, source_name, item_no, product, CAST(price AS DOUBLE) AS price FROM rec WHERE status = 'ok'", "o")
def _(spark, d):
    """What to buy where."""
    rows = baskets.shopping_list(baskets.recommendations(*basket_inputs(spark, d)))
    return rows.withColumn("price", F.col("price").cast("double"))


def repeated(spark, d):
    """Order lines as raw events, of which each order has one for each source, and a child of each."""
    event = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    lines = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), (F.col("l_suppkey") % 2).alias("source"), event.alias("event_id"), "l_partkey").agg((-F.max("l_extendedprice")).alias("child"))
    return standardize.dedupe_history(lines.select("run_id", "source", "event_id"), lines.select("event_id", "child", "l_partkey"), ["run_id", "source"], "event_id", [F.col("child"), F.col("l_partkey")])


_REPEATED = """WITH raw AS (SELECT l_orderkey AS run_id, l_suppkey % 2 AS source, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS event_id, -max(l_extendedprice) AS child, l_partkey FROM lineitem GROUP BY ALL), first AS (SELECT run_id, source, min(event_id) AS canonical FROM raw GROUP BY ALL)"""


@query("raw_once", f"{_REPEATED} SELECT run_id, source, canonical AS event_id FROM first")
def _(spark, d):
    return repeated(spark, d)[0]


@query("children_once", f"{_REPEATED} SELECT canonical AS event_id, child, l_partkey FROM raw JOIN first USING (run_id, source) QUALIFY 1 = row_number() OVER (PARTITION BY canonical ORDER BY child, l_partkey)")
def _(spark, d):
    """Children of repeated events, repointed to the one that stays, the first of each."""
    return repeated(spark, d)[1]


@query("repaired_names", """WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, 'i', 'i' || chr(775)) ELSE p_name || ' ' || p_brand END || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_brand ELSE '' END AS name FROM part),
  f AS (SELECT name, replace(name, 'i' || chr(775), 'i') AS fixed FROM n), free AS (SELECT fixed, min(name) AS was FROM f WHERE fixed <> name AND fixed NOT IN (SELECT name FROM n) GROUP BY 1)
SELECT f.name AS was, CASE WHEN free.was IS NULL THEN f.name ELSE f.fixed END AS name FROM f LEFT JOIN free ON free.was = f.name""")
def _(spark, d):
    """Names with a separate dot over i, repaired where no other product has the name."""
    part = B.table(spark, d, "part")
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 2 == 0, F.replace("p_name", F.lit("i"), F.lit("i̇"))).otherwise(F.concat_ws(" ", "p_name", "p_brand")), F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("p_brand"))).otherwise(""))
    return standardize.repair_names(part.select(name.alias("name")).distinct().withColumn("was", F.col("name"))).select("was", "name")


_FAMILIES = [("salatalik", ["salatalik"]), ("salatalik", ["hiyar"]), ("muz", ["muz"]), ("elma", ["elma"]), ("oil_aycicek", ["aycicek", "yagi"]), ("oil_zeytinyagi", ["zeytinyagi"]), ("oil_zeytinyagi", ["zeytin", "yagi"]), ("coffee_turk", ["turk", "kahvesi"])]


@query("name_facts", rf"""WITH {G.CAPTURED_SQL}, {G.NAMES_SQL} SELECT product_name, TRY_CAST(regexp_extract(norm, '\b([0-9]+)\s*''?\s*(?:adet|li|lu)\b', 1) AS DOUBLE) AS pieces, rolls,
  coalesce(TRY_CAST(replace(regexp_extract(norm, '([0-9]+(?:[.,][0-9]+)?)\s*ml\b', 1), ',', '.') AS DOUBLE) / 1000, TRY_CAST(replace(regexp_extract(norm, '([0-9]+(?:[.,][0-9]+)?)\s*l\b', 1), ',', '.') AS DOUBLE)) AS liters,
  CASE {' '.join(f"WHEN list_has_all(tok, {w}) THEN '{f}'" for f, w in _FAMILIES)} END AS family FROM told""")
def _(spark, d):
    """Counts and the family that a name gives."""
    names = G.captured(spark, d).select("product_name").distinct()
    return names.select("product_name", PR.counts_in(F.col("product_name")).alias("c"), PR.family_id(F.col("product_name")).alias("family")).select("product_name", "c.pieces", "c.rolls", "c.liters", "family")


# Sections of a category ------------------------------------------------------------------------

_TEXTS = {"PROMO": "bulaşık deterjanı", "LARGE": "parlatıcı", "STANDARD": "temizlik"}
_RESULTS = """results AS (SELECT p_type AS query_id, p_partkey AS place, p_name || ' ' || p_partkey // 3 AS name, nullif(['fairy', 'pril', 'bingo', 'src_a', '', 'abc', 'ace'][p_partkey % 7 + 1], '') AS brand,
    nullif(['dishwashing_liquid', 'dishwasher_tablet', '', 'bleach'][(p_partkey // 7) % 4 + 1], '') AS subtype, nullif(['litre', 'adet', '', 'kg', 'adet'][(p_partkey // 28) % 5 + 1], '') AS unit FROM part),
  kinds AS (SELECT query_id, coalesce(CASE query_id WHEN 'PROMO' THEN 'dishwashing_liquid' WHEN 'LARGE' THEN 'rinse_aid' END, arg_max(subtype, (n, subtype))) AS kind FROM (SELECT query_id, subtype, count(*) FILTER (WHERE subtype IS NOT NULL) AS n FROM results GROUP BY ALL) GROUP BY 1),
  fit AS (SELECT r.*, kind, kind IS NULL OR coalesce(subtype = kind, false) AS fits FROM results r JOIN kinds USING (query_id)),
  units AS (SELECT query_id, arg_max(unit, (unit = CASE kind WHEN 'dishwashing_liquid' THEN 'litre' WHEN 'dishwasher_tablet' THEN 'adet' WHEN 'bleach' THEN 'litre' WHEN 'rinse_aid' THEN 'litre' ELSE '' END, n, unit)) AS first_unit FROM (SELECT query_id, kind, unit, count(*) AS n FROM fit WHERE fits AND unit IS NOT NULL GROUP BY ALL) GROUP BY 1),
  parts AS (SELECT f.*, first_unit, CASE WHEN fits AND (first_unit IS NULL OR coalesce(unit = first_unit, false)) THEN 'primary' ELSE 'secondary' END AS section FROM fit f LEFT JOIN units USING (query_id)),
  brands AS (SELECT query_id, brand, count(*) AS n, min(place) AS first, CASE WHEN kind = 'dishwashing_liquid' THEN list_position(['fairy', 'pril', 'bingo'], brand) WHEN kind = 'dishwasher_tablet' THEN list_position(['finish', 'fairy', 'pril'], brand) END AS rank FROM parts WHERE section = 'primary' AND brand IS NOT NULL AND brand NOT IN ('src_a', 'src_b') GROUP BY ALL)"""


def category_results(spark, d):
    """Parts as results of their types, and a text for each type."""
    k = F.col("p_partkey")
    pick = lambda listed, by: F.nullif(F.element_at(F.array(*map(F.lit, listed)), (F.floor(k / by) % len(listed) + 1).cast("int")), F.lit(""))
    part = B.table(spark, d, "part")
    results = part.select(
        F.col("p_type").alias("query_id"), k.alias("place"), F.concat_ws(" ", "p_name", F.floor(k / 3).cast("string")).alias("standardized_product_name"), pick(["fairy", "pril", "bingo", "src_a", "", "abc", "ace"], 1).alias("brand"),
        pick(["dishwashing_liquid", "dishwasher_tablet", "", "bleach"], 7).alias("subtype"), pick(["litre", "adet", "", "kg", "adet"], 28).alias("best_unit"),
    )
    texts = F.create_map(*[F.lit(x) for kv in _TEXTS.items() for x in kv])
    return results, part.select(F.col("p_type").alias("query_id"), texts[F.col("p_type")].alias("text")).distinct()


@query("category_sections", f"WITH {_RESULTS} SELECT query_id, place, kind AS primary_subtype, first_unit AS primary_unit, section FROM parts")
def _(spark, d):
    return sections.sectioned(*category_results(spark, d)).select("query_id", "place", "primary_subtype", "primary_unit", "section")


@query("category_chips", f"""WITH {_RESULTS} SELECT query_id, 0 AS chip_no, 'all' AS chip, count(*) AS n_results FROM parts WHERE section = 'primary' GROUP BY 1
UNION ALL SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, first, brand) AS chip_no, brand, n FROM brands b WHERE rank IS NOT NULL OR NOT EXISTS (SELECT 1 FROM brands c WHERE c.query_id = b.query_id AND c.rank IS NOT NULL) QUALIFY chip_no <= 4""")
def _(spark, d):
    return sections.chips(sections.sectioned(*category_results(spark, d)))


_SPECIFIC = {"PROMO": "finish power tableti 40", "LARGE": "Fairy limon bulaşık deterjanı 650 ml", "STANDARD": "elma kokulu omo new ring"}


@query("specific_listing", """WITH o AS (SELECT p_type AS query_id, p_partkey AS k, nullif(['fairy', 'finish', 'omo', ''][p_partkey % 4 + 1], '') AS brand, nullif(['power', 'limon', 'quantum', 'elma', ''][p_partkey % 5 + 1], '') AS more, nullif(['dishwasher_tablet', 'dishwashing_liquid', ''][p_partkey % 3 + 1], '') AS subtype, ['safe', 'single_market', 'review_required'][(p_partkey // 3) % 3 + 1] AS status, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice END AS unit_price, p_retailprice AS price, p_name FROM part WHERE p_type IN ('PROMO', 'LARGE', 'STANDARD')),
  n AS (SELECT *, concat_ws(' ', brand, p_name, more, k) AS name, string_split(concat_ws(' ', brand, p_name, more, k), ' ') AS has, CASE query_id WHEN 'PROMO' THEN 'finish' WHEN 'LARGE' THEN 'fairy' ELSE 'omo' END AS asked, CASE query_id WHEN 'PROMO' THEN ['power'] WHEN 'LARGE' THEN ['limon'] ELSE ['elma', 'new', 'ring'] END AS words, CASE query_id WHEN 'PROMO' THEN 'dishwasher_tablet' WHEN 'LARGE' THEN 'dishwashing_liquid' END AS kind FROM o),
  s AS (SELECT *, CASE WHEN brand = asked THEN 30 ELSE 0 END + CASE WHEN subtype = kind THEN 20 ELSE 0 END + 18 * len(list_intersect(words, has)) + CASE WHEN query_id <> 'PROMO' THEN 0 WHEN list_has_any(has, ['power', 'quantum', 'max']) THEN 34 ELSE -18 END + CASE status WHEN 'safe' THEN 6 WHEN 'single_market' THEN 3 ELSE 0 END AS score FROM n)
SELECT query_id, name AS standardized_product_name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_price * CASE status WHEN 'safe' THEN 0.99 WHEN 'review_required' THEN 1.01 ELSE 1.0 END NULLS LAST, unit_price NULLS LAST, price, name) AS place FROM s""")
def _(spark, d):
    """Parts as offers for a text of their type, in order of what they share with it."""
    k = F.col("p_partkey")
    pick = lambda listed, by=1: F.nullif(F.element_at(F.array(*map(F.lit, listed)), (F.floor(k / by) % len(listed) + 1).cast("int")), F.lit(""))
    brand, more = pick(["fairy", "finish", "omo", ""]), pick(["power", "limon", "quantum", "elma", ""])
    texts = F.create_map(*[F.lit(x) for kv in _SPECIFIC.items() for x in kv])[F.col("p_type")]
    offers = B.table(spark, d, "part").where(F.col("p_type").isin(list(_SPECIFIC))).select(
        F.col("p_type").alias("query_id"), texts.alias("text"), F.concat_ws(" ", brand, "p_name", more, k.cast("string")).alias("standardized_product_name"), brand.alias("brand"), pick(["dishwasher_tablet", "dishwashing_liquid", ""]).alias("subtype"),
        pick(["safe", "single_market", "review_required"], 3).alias("normalized_status"), F.when(k % 6 > 0, F.col("p_retailprice")).alias("best_unit_price"), F.col("p_retailprice").alias("best_price"),
    )
    return listings.specific_listing(offers, ["query_id"]).select("query_id", "standardized_product_name", "score", "place")
