"""Captured rows to standardised observations, and their load: raw, staging, products, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import prices as P
from ..functions import text as T
from ..functions.labels import unit_label
from ..functions.profiles import rolls_in
from ..operators.rows import absent, first_per_key, insert_absent, product_keys
from ..shared import shared_folder


def told_names(rows: DataFrame) -> DataFrame:
    """What follows from each name and category of rows."""
    keys = ["product_name", "category_name"]
    return rows.select(*keys).distinct().select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        rolls_in(F.col("product_name"), F.col("category_name")).alias("_rolls"), T.weight_in(F.col("product_name")).alias("_weight"),
        T.canonicalize_name(F.col("product_name")).alias("canonical_product_name"), T.standardize_name(F.col("product_name")).alias("standardized_product_name"),
    )


def held_names(rows: DataFrame) -> DataFrame:
    """``told_names`` from the shared folder: they are computed once, and Spark knows how many
    there are before the rows meet them, so rows are not dealt out by a name that very many have."""
    return _held(told_names(rows), "names")


def _held(df: DataFrame, label: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def standardize_observations(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """From captured rows (product_name, category_name, unit, unit_amount, shown_price_tl,
    regular_price_tl, ...): price, regular_price, currency, normalized_unit and _quantity,
    price_per_unit, unit_price_label, canonical_ and standardized_product_name, is_suspicious
    and suspicious_reason are added. Rolls named by paper products count before the listed
    unit, a weight in the name before pieces. What follows from a name is computed for each
    name and category once and joined back; names, if given, has it for all of rows' names."""
    told = told_names(rows) if names is None else names
    met = rows.join(told, F.col("product_name").eqNullSafe(F.col("_product_name")) & F.col("category_name").eqNullSafe(F.col("_category_name"))).drop("_product_name", "_category_name")
    listed = P.normalize_unit(F.col("unit"), F.col("unit_amount"))
    row = lambda unit, q: F.struct(F.lit(unit).alias("unit"), q.cast("double").alias("quantity"))
    by_piece = F.coalesce(listed["unit"].isin("piece", "adet", "ad"), F.lit(True))
    measure = F.when(F.col("_rolls").isNotNull(), row("roll", F.col("_rolls"))).when(by_piece & F.col("_weight").isNotNull(), row("kg", F.col("_weight"))).otherwise(listed)
    price = F.col("shown_price_tl").cast("double")
    why = P.suspicion(price, F.col("product_name"))
    return (
        met.withColumn("_m", measure)
        .withColumns({"price": price, "regular_price": F.col("regular_price_tl").cast("double"), "currency": F.lit("TRY"), "normalized_unit": F.col("_m.unit"), "normalized_quantity": F.col("_m.quantity")})
        .withColumns({"price_per_unit": P.unit_price(F.col("price"), F.col("normalized_quantity")), "unit_price_label": unit_label(F.col("normalized_unit")), "suspicious_reason": why, "is_suspicious": why.isNotNull()})
        .drop("_m", "_rolls", "_weight")
    )


RAW_KEYS = ["run_id", "source_name", "raw_hash"]


def raw_events(rows: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Captured rows with raw_hash and the whole row as JSON (raw_payload); observed_at is the
    capture time, else loaded_at, the load's."""
    return rows.select("*", _hash().alias("raw_hash"), F.to_json(F.struct(*rows.columns)).alias("raw_payload"), _observed(loaded_at).alias("observed_at"))


def _hash() -> Column:
    return P.row_hash(*[F.col(c) for c in ("product_id", "sku", "product_name", "shown_price_tl", "category_slug")])


def _observed(loaded_at: Column | None) -> Column:
    loaded_at = F.current_timestamp() if loaded_at is None else loaded_at
    return F.coalesce(F.col("scraped_at").cast("timestamp_ntz"), loaded_at.cast("timestamp_ntz"))


def first_order(events: DataFrame, columns: list[str]) -> list[Column]:
    """The order that tells the first of raw events of one hash: the time, then the columns that
    were captured."""
    maps = {f.name for f in events.schema.fields if isinstance(f.dataType, MapType)}
    return [F.col("observed_at"), *[F.to_json(c) if c in maps else F.col(c) for c in columns]]


def staged_rows(fresh: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """New raw events as staging rows: standardised, with event_id and the first reason why a
    row does not enter the facts."""
    staged = standardize_observations(fresh, names).withColumnRenamed("product_id", "source_product_id").withColumn("event_id", F.md5(F.concat_ws("|", *RAW_KEYS)))
    return staged.withColumn("reject_reason", P.reject_reason(F.col("is_suspicious")))


def product_names(staged: DataFrame) -> DataFrame:
    """(name, category, seen) of staging rows, as ``product_keys`` takes them: of a name and
    category the first time, by an aggregate that needs no rows in order."""
    named = staged.where("standardized_product_name is not null").select(F.col("standardized_product_name").alias("name"), F.col("category_name").alias("category"), F.col("observed_at").alias("seen"))
    return named.groupBy("name", "category").agg(F.min("seen").alias("seen"))


def load(rows: DataFrame, raw: DataFrame, products: DataFrame, facts: DataFrame, loaded_at: Column | None = None) -> dict[str, DataFrame]:
    """One run's load: captured rows to raw, staging, products, aliases, facts and rejected.

    Rows whose (run, source, hash) raw has already, or that stand twice, are left out; products
    get ids for new names; a row enters the facts if nothing speaks against it, else rejected
    with the first reason. Loading the same rows again adds nothing. raw, products and facts are
    what was there before; each result is the table after. The rows that are new are written once,
    to the shared folder, as they were captured, and all results are made from there."""
    names, seen = held_names(rows), Observation()
    # what is made of a row's own columns is neither sent nor written: rows are dealt out by what
    # their hash is, and their hash and payload are made where they lie
    dealt = rows.withColumn("observed_at", _observed(loaded_at)).repartition("run_id", "source_name", _hash())
    first = first_per_key(dealt.withColumn("raw_hash", _hash()), RAW_KEYS, first_order(dealt, rows.columns))
    fresh = absent(first, raw, RAW_KEYS).drop("raw_hash")
    nameless = F.col("run_id").isNull() | F.col("source_name").isNull()
    fresh = _held(fresh.observe(seen, F.count_if(nameless).alias("nameless")), "load")
    fresh = fresh.select(*rows.columns, _hash().alias("raw_hash"), F.to_json(F.struct(*rows.columns)).alias("raw_payload"), "observed_at")
    staged = staged_rows(fresh, names)
    known = product_keys(product_names(staged), products)
    # Spark knows how many they are, so rows are not dealt out by name
    ids = _held(known.select(F.col("name").alias("standardized_product_name"), "product_id"), "ids")
    admitted = staged.where("reject_reason is null").join(ids, "standardized_product_name")
    columns = facts.columns
    if seen.get["nameless"]:
        new = insert_absent(facts, admitted.select(*columns), ["event_id"], [F.col("observed_at")])
    else:
        # of rows with a run and a source each has an event of its own
        new = facts.unionByName(absent(admitted, facts, ["event_id"]).select(*columns))
    return {
        "raw": raw.unionByName(fresh.select(*raw.columns)),
        "staging": staged,
        "products": known,
        "aliases": known.select(F.col("name").alias("alias"), "product_id"),
        "facts": new,
        "rejected": staged.where("reject_reason is not null").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")),
    }


def dedupe_history(raw: DataFrame, children: DataFrame, keys: list[str], event: str, child_key: list) -> tuple[DataFrame, DataFrame]:
    """Historic duplicates of raw events: (raw, children) with one event of each of keys, the
    smallest, the children repointed to it, and of an event's children the first by child_key."""
    smallest = raw.groupBy(*keys).agg(F.min(event).alias("canonical"))
    names = raw.select(*keys, event).join(smallest, keys).select(event, "canonical")
    moved = children.join(names, event, "left").withColumn(event, F.coalesce("canonical", event)).drop("canonical")
    return raw.join(smallest.select(F.col("canonical").alias(event)), event, "left_semi"), first_per_key(moved, [event], child_key)


def repair_names(products: DataFrame, name: str = "name") -> DataFrame:
    """Names with a separate dot above i repaired, but for those that another product has."""
    fixed = products.withColumn("_new", T.repair_dotted_i(F.col(name)))
    changed = fixed.where(F.col("_new") != F.col(name))
    free = changed.join(products.select(F.col(name).alias("_new")), "_new", "left_anti")
    first = free.groupBy("_new").agg(F.min(name).alias("_was"))
    return fixed.join(first.select(F.col("_was").alias(name), F.lit(True).alias("_ok")), name, "left").withColumn(name, F.when(F.col("_ok"), F.col("_new")).otherwise(F.col(name))).select(*products.columns)
