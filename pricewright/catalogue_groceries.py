"""Registered queries over grocery rows: standardising, profiles, catalog and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import query
from .functions import canonical as C
from .functions import labels as L
from .functions import profiles as PR
from .plans import accounting, catalog, listings, pairs, standardize
from .sources import groceries as G

SOURCES = ["src_a", "src_b"]
VARIANTS = ["bambu", "deluxe", "ithal", "platinum", "plus", "quantum", "sizma", "yerli"]


@query("standardize_observations", f"WITH {G.STANDARD_SQL} SELECT run_id, line_number, product_id, sku, price, canonical_product_name, standardized_product_name, normalized_unit, normalized_quantity, price_per_unit, unit_price_label, suspicious_reason FROM standard")
def _(spark, d):
    return standardize.standardize_observations(G.captured(spark, d)).select("run_id", "line_number", "product_id", "sku", "price", "canonical_product_name", "standardized_product_name", "normalized_unit", "normalized_quantity", "price_per_unit", "unit_price_label", "suspicious_reason")


def loaded(spark, d):
    rows = G.captured(spark, d)
    products = spark.createDataFrame([], "product_id long, name string, category string")
    facts = spark.createDataFrame([], "event_id string, run_id long, source_name string, source_product_id string, product_id long, standardized_product_name string, price double, normalized_unit string, normalized_quantity double, price_per_unit double, category_name string, observed_at timestamp_ntz")
    # without rows by their plan, so that nothing is dealt out to meet them
    return standardize.load(rows, standardize.raw_events(rows).limit(0), products.limit(0), facts.limit(0))


_LOADED = f"""WITH {G.STANDARD_SQL}, once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source_name, product_id, sku, product_name, shown_price_tl, category_slug ORDER BY scraped_at, line_number) AS rn FROM (SELECT s.*, lower(p_type) AS category_slug FROM standard s JOIN part ON p_partkey = CAST(product_id AS BIGINT))) WHERE rn = 1
), reasons AS (
  SELECT *, CASE WHEN suspicious_reason IS NOT NULL THEN 'suspicious_record' WHEN normalized_quantity IS NULL THEN 'missing_normalized_quantity' WHEN standardized_product_name IS NULL THEN 'missing_standardized_product_name' END AS reason FROM once)"""


@query("load_facts", _LOADED + " SELECT run_id, source_name, standardized_product_name, price, normalized_unit, normalized_quantity, count(*) AS n FROM reasons WHERE reason IS NULL GROUP BY ALL")
def _(spark, d):
    facts = loaded(spark, d)["facts"]
    return facts.groupBy("run_id", "source_name", "standardized_product_name", "price", "normalized_unit", "normalized_quantity").agg(F.count(F.lit(1)).alias("n"))


@query("load_rejected", _LOADED + " SELECT reason AS reject_reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY 1")
def _(spark, d):
    return loaded(spark, d)["rejected"]


def names(spark, d):
    return G.captured(spark, d).select("product_name", "category_name").distinct()


@query("paper_profiles", rf"""WITH {G.CAPTURED_SQL}, {G.NAMES_SQL} SELECT product_name, kind, tok[1] AS brand, rolls, array_to_string(list_sort(list_distinct(list_filter(list_transform(tok, lambda t: CASE t WHEN 'bamboo' THEN 'bambu' ELSE t END), lambda t: t IN ('platinum', 'egzotik', 'biocare', 'deluxe', 'bambu', 'natural', 'inova', 'klasik', 'plus', 'soft')))), ' ') AS lines,
  list_has_any(tok, ['dev', 'jumbo', 'asilabilir', 'asmali', 'cekmeli', 'yaprak']) OR regexp_matches(norm, '\b1\s*=\s*[0-9]') AS special FROM told""")
def _(spark, d):
    p = PR.paper_profile(F.col("product_name"), F.col("category_name"))
    return names(spark, d).select("product_name", p.alias("p")).select("product_name", "p.kind", "p.brand", "p.rolls", F.array_join("p.lines", " ").alias("lines"), "p.special")


@query("cleaning_profiles", rf"""WITH {G.CAPTURED_SQL}, {G.NAMES_SQL}, t AS (
  SELECT product_name, norm, list_filter(string_split(translate(norm, '-&', '  '), ' '), lambda x: x <> '') AS w FROM told
), b AS (SELECT *, coalesce(list_filter(w, lambda x: x IN ('ariel', 'domestos', 'fairy', 'finish', 'omo', 'pril', 'cif', 'ace', 'bingo'))[1], w[1]) AS brand, list_filter(w, lambda x: x IN ('elma', 'limon', 'portakal', 'platinum'))[1] AS variant FROM t)
SELECT product_name, brand, variant, CASE WHEN list_has_all(w, ['camasir', 'suyu']) THEN 'bleach'
  WHEN list_has_any(w, ['tablet', 'tableti']) AND brand = 'finish' THEN 'dishwasher_tablet'
  WHEN brand IN ('fairy', 'pril') OR list_has_all(w, ['bulasik', 'deterjani']) THEN 'dishwashing_liquid'
  WHEN list_has_all(w, ['camasir', 'deterjani']) THEN CASE WHEN list_contains(w, 'sivi') THEN 'laundry_liquid' ELSE 'laundry_powder' END
  WHEN brand = 'domestos' THEN 'bleach' END AS subtype,
  list_has_any(w, ['bulasik', 'camasir', 'deterjani', 'makinesi', 'sivi', 'tablet', 'tableti', 'toz', 'yikama']) OR brand IN ('ariel', 'domestos', 'fairy', 'finish', 'omo', 'pril') AS is_cleaning FROM b""")
def _(spark, d):
    return names(spark, d).select("product_name", PR.cleaning_profile(F.col("product_name")).alias("p")).select("product_name", "p.brand", "p.variant", "p.subtype", "p.is_cleaning")


@query("measure_labels", f"""WITH {G.STANDARD_SQL}, m AS (SELECT DISTINCT product_name, normalized_unit, normalized_quantity AS q FROM standard),
  t AS (SELECT *, CASE WHEN contains(lower(product_name), 'paket') THEN ' paket' ELSE '' END AS pack FROM m)
SELECT product_name, normalized_unit, CASE WHEN normalized_unit = 'kg' AND q < 1 THEN CAST(CAST(round(q * 1000) AS INTEGER) AS VARCHAR) || ' g' || pack WHEN normalized_unit = 'kg' THEN rtrim(rtrim(printf('%.3f', q), '0'), '.') || ' kg' || pack
  WHEN normalized_unit = 'piece' THEN CAST(CAST(q AS INTEGER) AS VARCHAR) || ' adet' WHEN normalized_unit = 'roll' THEN CAST(CAST(q AS INTEGER) AS VARCHAR) || ' rulo' WHEN normalized_unit = 'liter' THEN CAST(CAST(q AS INTEGER) AS VARCHAR) || ' l' ELSE CAST(CAST(q AS INTEGER) AS VARCHAR) || ' ml' END AS label FROM t""")
def _(spark, d):
    rows = G.history(spark, d).select("source_product_name", "normalized_unit", "normalized_quantity").distinct()
    return rows.select(F.col("source_product_name").alias("product_name"), "normalized_unit", L.measure_label(F.col("normalized_quantity"), F.col("normalized_unit"), F.col("source_product_name")).alias("label"))


def _rule_sql(r: C.Rule) -> str:
    q = lambda x: x.replace("'", "''")
    parts = [f"contains(lower(standardized_product_name), '{q(x)}')" for x in r.has]
    parts += ["(" + " OR ".join(f"contains(lower(standardized_product_name), '{q(x)}')" for x in listed) + ")" for listed in r.any_of]
    parts += [f"NOT contains(lower(standardized_product_name), '{q(x)}')" for x in r.lacks]
    if r.raw:
        parts.append("(" + " OR ".join(f"contains(lower(source_product_name), '{x}')" for x in r.raw) + ")")
    if r.equals:
        parts.append("standardized_product_name IN (" + ", ".join(f"'{x}'" for x in r.equals) + ")")
    if r.pattern:
        parts.append("(standardized_product_name = 'su' OR starts_with(standardized_product_name, 'su ') OR ends_with(standardized_product_name, ' su') OR contains(standardized_product_name, ' suyu'))")
    if r.measure:
        parts.append(f"normalized_unit = '{r.measure[0]}' AND normalized_quantity = {r.measure[1]}")
    name = f"'{r.name}'"
    first = lambda c: f"nullif(trim(lower(split_part({c}, ' ', 1))), '')"
    if r.prefix == "dish":
        some = lambda listed, other: "CASE " + " ".join(f"WHEN contains(standardized_product_name, '{x}') THEN '{x}'" for x in listed) + f" ELSE {other} END"
        name = f"concat_ws(' ', {some(C.DISH_BRANDS, first('standardized_product_name'))}, {some(C.DISH_KINDS, 'NULL')}, {name})"
    elif r.prefix == "brand":
        name = f"concat_ws(' ', {first('source_product_name')}, {name})"
    return f"WHEN {' AND '.join(parts)} THEN {name}"


_LEFT_OUT = ", ".join(f"'{x}'" for x in C.LEFT_OUT)
_NUMBER = "([0-9]+(?:[.,][0-9]+)?)"
_MEASURE = "CASE " + " ".join(f"WHEN regexp_matches(lower(source_product_name), '{_NUMBER} *{p}') THEN {{}}" for p, _, _ in C.MEASURES)
_UNIT_SQL = _MEASURE.format(*[f"'{u}'" for _, u, _ in C.MEASURES]) + " ELSE normalized_unit END"
_QUANTITY_SQL = _MEASURE.format(*[f"CAST(replace(regexp_extract(lower(source_product_name), '{_NUMBER} *{p}', 1), ',', '.') AS DOUBLE) / {by}" for p, _, by in C.MEASURES]) + " ELSE normalized_quantity END"
_EGGS = "coalesce(nullif(regexp_extract(standardized_product_name, '([1-9][0-9]?)\\s*[''’]', 1), ''), nullif(regexp_extract(standardized_product_name, '([1-9][0-9]?)\\s*adet', 1), ''))"
_TEXT = "rtrim(rtrim(printf('%.4f', {}), '0'), '.')"
_W = "list_filter(string_split_regex(lower(source_product_name), '\\s+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+(?:[.,][0-9]+)?') AND x NOT IN ('kg', 'g', 'gram', 'ml', 'l', 'lt', 'adet', 'demet', 'paket'))"
LATEST_SQL = rf"""{G.STANDARD_SQL}, newest AS (
  SELECT * FROM (SELECT *, product_name AS source_product_name, row_number() OVER (PARTITION BY source_name, product_name ORDER BY scraped_at DESC, run_id DESC, line_number DESC, product_id DESC, sku DESC, price DESC) AS rn FROM standard WHERE standardized_product_name IS NOT NULL) WHERE rn = 1
), grouped AS (
  SELECT *, CASE {' '.join(_rule_sql(r) for r in C.RULES)} ELSE coalesce(nullif(array_to_string(list_filter(string_split(standardized_product_name, ' '), lambda x: NOT regexp_full_match(x, '[0-9]+(?:[.,][0-9]+)?') AND x NOT IN ({_LEFT_OUT})), ' '), ''), standardized_product_name) END AS canonical,
    CASE WHEN contains(standardized_product_name, 'yumurta') AND {_EGGS} IS NOT NULL THEN 'piece' ELSE {_UNIT_SQL} END AS u,
    CASE WHEN contains(standardized_product_name, 'yumurta') AND {_EGGS} IS NOT NULL THEN CAST({_EGGS} AS DOUBLE) ELSE {_QUANTITY_SQL} END AS q FROM newest
), latest AS (
  SELECT *, CASE WHEN canonical = 'ekmek' AND standardized_product_name IN ('ekmek', 'ekmek sofra') THEN NULL ELSE u END AS gu,
    CASE WHEN canonical = 'ekmek' AND standardized_product_name IN ('ekmek', 'ekmek sofra') OR canonical = 'mantar' AND u = 'kg' THEN NULL ELSE q END AS gq,
    CASE WHEN u = 'kg' AND q > 0 THEN {G.per_unit('price', 'q')} ELSE price END AS comparison_price, {_W} AS words FROM grouped
), shown AS (
  SELECT canonical, gu, gq, CASE WHEN canonical IN ('sogan', 'sogan taze', 'arpacik sogan') THEN canonical
    WHEN gu = 'roll' AND gq IS NOT NULL AND (ends_with(canonical, 'tuvalet kagidi') OR ends_with(canonical, 'kagit havlu')) THEN canonical || ' ' || CAST(gq AS INTEGER) || ' roll'
    WHEN gu = 'liter' AND gq IS NOT NULL AND ends_with(canonical, 'bulasik deterjani') THEN canonical || ' ' || {_TEXT.format('gq')} || ' l'
    WHEN canonical IN ({', '.join(f"'{x}'" for x in C.SIZED)}) AND gu IS NOT NULL AND gq IS NOT NULL THEN canonical || ' ' || CASE gu WHEN 'kg' THEN {_TEXT.format('gq * 1000')} || ' g' WHEN 'liter' THEN {_TEXT.format('gq')} || ' l' WHEN 'piece' THEN CAST(gq AS INTEGER) || ' adet' ELSE {_TEXT.format('gq')} || ' ' || gu END
    WHEN count(DISTINCT standardized_product_name) > 1 THEN canonical ELSE max(standardized_product_name) END AS display FROM latest GROUP BY canonical, gu, gq
), chosen AS (
  SELECT * FROM (SELECT l.*, display, row_number() OVER (PARTITION BY display, source_name ORDER BY CASE WHEN coalesce(nullif(array_to_string(list_sort(words), ' '), ''), lower(source_product_name)) = display THEN 0 ELSE 1 END,
    len(list_filter(list_distinct(string_split_regex(lower(source_product_name), '\s+')), lambda x: x IN ({', '.join(f"'{v}'" for v in VARIANTS)}) AND NOT list_contains(string_split(lower(l.canonical), ' '), x))),
    len(list_filter(list_distinct(words), lambda x: NOT list_contains(string_split(standardized_product_name, ' '), x))), len(list_filter(string_split_regex(source_product_name, '\s+'), lambda x: x <> '')),
    scraped_at DESC, run_id DESC, line_number DESC, product_id DESC, sku DESC, price DESC) AS k
  FROM latest l JOIN shown s ON l.canonical = s.canonical AND l.gu IS NOT DISTINCT FROM s.gu AND l.gq IS NOT DISTINCT FROM s.gq) WHERE k = 1
), wide AS (
  SELECT display, count(DISTINCT source_name) AS source_count, string_agg(DISTINCT source_name, ', ' ORDER BY source_name) AS available_sources,
    {', '.join(f"max({c}) FILTER (WHERE source_name = '{s}') AS {s}_{n}" for s in SOURCES for c, n in (('product_name', 'name'), ('u', 'u'), ('q', 'q'), ('price', 'p'), ('comparison_price', 'cp')))} FROM chosen GROUP BY 1
), flagged AS (
  SELECT *, coalesce(source_count = 2 AND src_a_u = src_b_u, false) AS fu, coalesce(source_count = 2 AND (src_a_q = src_b_q OR (display = 'mantar' AND src_a_q IS NOT NULL AND src_b_q IS NOT NULL AND src_a_u = 'kg' AND src_b_u = 'kg')), false) AS fq,
    {', '.join(f"string_split(regexp_replace(trim(strip_accents(translate(lower({s}_name), 'ı', 'i'))), ' +', ' ', 'g'), ' ') AS {s}_t" for s in SOURCES)} FROM wide
), papered AS (
  SELECT *, coalesce(list_has_all(src_a_t, ['tuvalet', 'kagidi']) AND list_has_all(src_b_t, ['tuvalet', 'kagidi']), false) AS paper, coalesce(src_a_t[1] = src_b_t[1], false) AS brand,
    {', '.join(f"list_filter(['platinum', 'egzotik', 'bambu', 'deluxe', 'natural', 'soft'], lambda x: list_contains({s}_t, x))[1] AS {s}_l" for s in SOURCES)} FROM flagged
), catalog AS (
  SELECT *, CASE WHEN source_count < 2 THEN 'single_source' WHEN fu AND fq AND paper AND brand AND src_a_l IS NULL AND src_b_l IS NULL THEN 'medium' WHEN fu AND fq THEN 'high' WHEN fu THEN 'medium' ELSE 'low' END AS comparison_confidence,
    CASE WHEN source_count = 1 THEN 'only_' || available_sources WHEN fu AND fq AND (NOT paper OR (brand AND coalesce(src_a_l = src_b_l, false))) THEN 'comparable' ELSE 'comparison_review_required' END AS coverage_status,
    CASE WHEN fu AND src_a_q IS NOT NULL AND src_b_q IS NOT NULL THEN src_a_u END AS comparison_price_unit FROM papered)"""


def catalog_of(spark, d):
    return catalog.build_catalog(G.latest_history(spark, d), VARIANTS, SOURCES, G.TIE)


@query("canonical_names", f"WITH {LATEST_SQL} SELECT source_name, source_product_name, canonical AS canonical_search_name, u AS unit, q AS quantity, gu AS grouping_unit, gq AS grouping_quantity, comparison_price FROM latest")
def _(spark, d):
    rows = catalog.latest_sources(G.latest_history(spark, d), G.TIE)
    return rows.select("source_name", "source_product_name", "canonical_search_name", F.col("normalized_unit").alias("unit"), F.col("normalized_quantity").alias("quantity"), "grouping_unit", "grouping_quantity", "comparison_price")


@query("display_names", f"WITH {LATEST_SQL} SELECT canonical AS canonical_search_name, display AS display_name FROM shown")
def _(spark, d):
    return catalog.display_names(catalog.latest_sources(G.latest_history(spark, d), G.TIE)).select("canonical_search_name", "display_name")


@query("public_catalog", f"""WITH {LATEST_SQL} SELECT display AS standardized_product_name, source_count, available_sources, src_a_name AS src_a_source_product_name, src_b_name AS src_b_source_product_name, src_a_p AS src_a_raw_price, src_b_p AS src_b_raw_price,
  src_a_cp AS src_a_comparison_price, src_b_cp AS src_b_comparison_price, src_a_q AS src_a_normalized_quantity, src_b_q AS src_b_normalized_quantity, comparison_price_unit, fu AS same_unit_flag, fq AS same_quantity_flag, comparison_confidence, coverage_status FROM catalog""")
def _(spark, d):
    return catalog_of(spark, d).drop("src_a_normalized_unit", "src_b_normalized_unit")


@query("latest_canonical_prices", f"""WITH {LATEST_SQL} SELECT display AS standardized_product_name, source_count, src_a_p AS src_a_price, src_b_p AS src_b_price, comparison_confidence FROM catalog WHERE contains(display, 'sogan') OR contains(display, 'mantar')""")
def _(spark, d):
    history = G.latest_history(spark, d)
    rows = catalog.build_catalog(history, VARIANTS, SOURCES, G.TIE).select(F.col("standardized_product_name").alias("name")).where("contains(name, 'sogan') or contains(name, 'mantar')")
    return catalog.latest_prices(history, rows, VARIANTS, SOURCES, G.TIE).select("standardized_product_name", "source_count", "src_a_price", "src_b_price", "comparison_confidence")


@query("supplement_rows", rf"""WITH {LATEST_SQL} SELECT regexp_replace(trim(strip_accents(translate(lower(source_product_name), 'ı', 'i'))), '\s+', ' ', 'g') AS standardized_product_name, source_name AS cheaper_source, price FROM newest
  WHERE contains(lower(source_product_name), 'fairy') OR contains(lower(source_product_name), 'omo') OR (contains(lower(source_product_name), 'havlu') AND NOT regexp_matches(lower(source_product_name), 'tuvalet|mendil|pecete|islak'))""")
def _(spark, d):
    wanted = G.captured(spark, d).select(F.col("product_name").alias("name")).where("name like 'Fairy%' or name like 'Omo%' or name like 'Papia%'").distinct()
    rows = catalog.supplement_rows(G.history(spark, d), wanted, SOURCES, G.TIE)
    return rows.select("standardized_product_name", "cheaper_source", F.coalesce("src_a_price", "src_b_price").alias("price"))


def priced(spark, d):
    return catalog_of(spark, d).withColumnsRenamed({f"{s}_raw_price": f"{s}_price" for s in SOURCES})


@query("paper_rules", f"""WITH {LATEST_SQL}, t AS (SELECT *, src_a_p IS NOT NULL AND src_b_p IS NOT NULL AND fu AND fq AND paper AS ok FROM catalog)
SELECT display AS standardized_product_name, CASE WHEN NOT ok THEN comparison_confidence WHEN NOT brand THEN 'low' WHEN src_a_l = src_b_l THEN 'high' ELSE 'medium' END AS comparison_confidence,
  CASE WHEN NOT ok THEN NULL WHEN NOT brand THEN 'brand_mismatch' WHEN src_a_l IS NULL OR src_b_l IS NULL THEN 'product_line_unknown' WHEN src_a_l <> src_b_l THEN 'product_line_mismatch' END AS comparison_review_reason FROM t WHERE NOT contains(display, 'havlu')""")
def _(spark, d):
    return pairs.apply_paper_rules(priced(spark, d), SOURCES).where("not contains(standardized_product_name, 'havlu')").select("standardized_product_name", "comparison_confidence", "comparison_review_reason")


@query("cleaning_rules", f"""WITH {LATEST_SQL}, t AS (SELECT *, src_a_p IS NOT NULL AND src_b_p IS NOT NULL AS priced, list_filter(['fairy', 'pril', 'finish', 'omo', 'ariel', 'domestos'], lambda x: list_contains(src_a_t, x) AND list_contains(src_b_t, x))[1] AS shared FROM catalog)
SELECT display AS standardized_product_name, CASE WHEN priced AND shared = 'fairy' AND src_a_u = 'liter' AND src_b_u = 'liter' AND abs(src_a_q - src_b_q) <= 0.2 * greatest(src_a_q, src_b_q) THEN 'high' ELSE comparison_confidence END AS comparison_confidence FROM t""")
def _(spark, d):
    return pairs.apply_cleaning_rules(priced(spark, d), SOURCES).select("standardized_product_name", "comparison_confidence")


@query("safety_list", f"""WITH {LATEST_SQL} SELECT display AS standardized_product_name, CASE WHEN fu AND fq AND NOT paper THEN 'high' WHEN fu THEN 'medium' ELSE 'low' END AS comparison_confidence FROM catalog WHERE source_count = 2""")
def _(spark, d):
    return catalog.safety_list(catalog_of(spark, d).where("source_count = 2"), SOURCES).select("standardized_product_name", "comparison_confidence")


@query("display_prices", f"""WITH {LATEST_SQL}, e AS (
  SELECT display, src_a_p, src_b_p, {', '.join(f"CASE WHEN {s}_p IS NOT NULL AND {s}_q > 0 THEN {s}_p / {s}_q END AS {s}_d, CASE WHEN {s}_p IS NOT NULL AND {s}_q > 0 THEN CASE {s}_u WHEN 'liter' THEN 'litre' WHEN 'piece' THEN 'adet' WHEN 'roll' THEN 'rulo' ELSE {s}_u END END AS {s}_x" for s in SOURCES)} FROM catalog
), f AS (SELECT *, CASE WHEN src_a_x = src_b_x THEN src_a_x WHEN src_b_p IS NULL THEN src_a_x WHEN src_a_p IS NULL THEN src_b_x END AS unit FROM e
), g AS (SELECT *, CASE WHEN unit IS NULL THEN src_a_p ELSE src_a_d END AS a, CASE WHEN unit IS NULL THEN src_b_p ELSE src_b_d END AS b FROM f)
SELECT display AS standardized_product_name, unit AS price_display_unit, a AS src_a_display_price, b AS src_b_display_price, CASE WHEN unit IS NOT NULL AND (b IS NULL OR a < b) THEN 'src_a' WHEN unit IS NOT NULL AND (a IS NULL OR b < a) THEN 'src_b' WHEN unit IS NOT NULL THEN 'same' END AS display_recommended_source FROM g""")
def _(spark, d):
    rows = catalog_of(spark, d)
    asked = rows.select("standardized_product_name", *[F.col(f"{s}_raw_price").alias(f"{s}_price") for s in SOURCES], F.lit(None).cast("string").alias("recommended_source"), F.lit(None).cast("double").alias("recommended_price"), F.lit(False).alias("force_review"))
    return catalog.display_prices(asked, rows, SOURCES).select("standardized_product_name", "price_display_unit", "src_a_display_price", "src_b_display_price", "display_recommended_source")


@query("best_offers", f"""WITH {LATEST_SQL}, o AS (SELECT display, 'src_a' AS source, src_a_p AS p, CASE WHEN src_a_q > 0 AND src_a_u IN ('liter', 'kg', 'piece', 'roll') THEN src_a_p / src_a_q WHEN comparison_price_unit IS NOT NULL THEN src_a_cp END AS up FROM catalog WHERE src_a_p IS NOT NULL
  UNION ALL SELECT display, 'src_b', src_b_p, CASE WHEN src_b_q > 0 AND src_b_u IN ('liter', 'kg', 'piece', 'roll') THEN src_b_p / src_b_q WHEN comparison_price_unit IS NOT NULL THEN src_b_cp END FROM catalog WHERE src_b_p IS NOT NULL)
SELECT display AS standardized_product_name, source AS best_source, p AS best_price, up AS best_unit_price FROM (SELECT *, row_number() OVER (PARTITION BY display ORDER BY up IS NULL, up, p, source) AS k FROM o) WHERE k = 1""")
def _(spark, d):
    return listings.best_offer(catalog_of(spark, d), SOURCES).select("standardized_product_name", "best_source", "best_price", "best_unit_price")


@query("run_accounting", f"""WITH {G.STANDARD_SQL} SELECT run_id, count(*) AS records_scraped, count(*) FILTER (WHERE suspicious_reason IS NOT NULL) AS records_suspicious, CASE WHEN count(*) = 0 THEN 'failed' ELSE 'success' END AS status FROM standard GROUP BY 1""")
def _(spark, d):
    rows = standardize.standardize_observations(G.captured(spark, d))
    return accounting.finished_runs(rows).select("run_id", "records_scraped", "records_suspicious", "status")
