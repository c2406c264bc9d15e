"""Offers: one row per store and package, grouped, ranked and merged.

An offer has game_id, store_id, store_name, original_name, final_price, source
and arrival_seq (anything that orders, and is unique): what comes first is
always decided by it and never by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions import names
from offerloom.functions.money import has_mark
from offerloom.functions.names import canonicalized
from offerloom.functions.text import normalized, squeezed

KEY = ["game_id", "canonical_key"]


def priced(offers: DataFrame) -> DataFrame:
    """Offers with a positive price."""
    return offers.filter((F.col("final_price") > 0) & ~F.isnan(F.col("final_price").cast("double")))


def group_offers(offers: DataFrame) -> DataFrame:
    """One row per game and package with price metrics; names come from the first arriving offer.

    Every aggregate combines before the shuffle; the count of stores takes one
    more pair (group, store) per task, so what goes along with it is small: of
    the first offer its name only, which says the rest again for each group.
    """
    groups = canonicalized(priced(offers)).groupBy(*KEY).agg(
        F.min_by("original_name", "arrival_seq").alias("first"),
        F.min(F.struct("final_price", "store_name")).alias("cheapest"),
        F.max("final_price").alias("highest_price"),
        F.count_distinct("store_id").alias("store_count"),
        F.count("*").alias("offer_count"),
        F.bool_or(F.col("source") == "live").alias("has_live_price"),
    )
    groups = names.packages(groups.withColumns({"_key": F.col("canonical_key"), "cheapest_price": F.col("cheapest.final_price")}), "first")
    saved = F.greatest(F.lit(0), F.col("highest_price") - F.col("cheapest_price"))
    return groups.select("game_id", F.col("_key").alias("canonical_key"), F.col("canonical_name").alias("name"), "package_type", "unit", "total_amount", "cheapest_price", F.col("cheapest.store_name").alias("cheapest_store"), "highest_price", saved.alias("savings"), "store_count", "offer_count", "has_live_price")


def cheapest_offers(offers: DataFrame, k: int) -> DataFrame:
    """The k first offers of each group by price, store name and arrival; Spark limits each group before the shuffle too."""
    order = Window.partitionBy(*KEY).orderBy("final_price", "store_name", "arrival_seq")
    return canonicalized(priced(offers)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sorted_groups(groups: DataFrame, by: str = "price-asc") -> DataFrame:
    """All groups with their place (from 1) in their game's list, in one of the orders offered to users.

    Ties go by cheapest price, then by key. An unknown order is price-asc. A
    game's groups are ranked by themselves, so no task sees all groups.
    """
    first = {"amount-asc": [F.col("total_amount").asc_nulls_last()], "stores-desc": [F.col("store_count").desc()], "savings-desc": [F.col("savings").desc()]}.get(by, [])
    order = Window.partitionBy("game_id").orderBy(*first, "cheapest_price", "canonical_key")
    return groups.withColumn("place", F.row_number().over(order))


def first_of_each(offers: DataFrame, scope: list[str]) -> DataFrame:
    """The first arriving offer of each name (letter case and blanks aside) and price within a scope."""
    name = squeezed(F.lower("original_name"))
    return _first_arrived(offers.withColumn("name_key", name), scope, offers.columns)


def _first_arrived(named: DataFrame, scope: list[str], columns: list[str]) -> DataFrame:
    """The first arriving row of each name_key and price within a scope. Prices lead, as sorting tells them apart at one look."""
    rest = [c for c in columns if c not in (*scope, "final_price", "arrival_seq")]
    return named.groupBy("final_price", *scope, "name_key").agg(F.min(F.struct("arrival_seq", *rest)).alias("_f")).select(*scope, "final_price", *(f"_f.{c}" for c in columns if c not in (*scope, "final_price")))


def with_fallback(live: DataFrame, catalog: DataFrame, selected: DataFrame) -> DataFrame:
    """Live offers, and catalogue offers of selected stores that have no live one."""
    missing = catalog.join(selected.select("store_id").distinct(), "store_id", "left_semi").join(live.select("store_id").distinct(), "store_id", "left_anti")
    return live.unionByName(missing, allowMissingColumns=True)


def type_facets(groups: DataFrame) -> DataFrame:
    """How many groups each package type has, units told apart for currencies."""
    key = F.when(F.col("package_type") == "currency", F.concat(F.lit("currency:"), F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", "-"))).otherwise(F.col("package_type"))
    return groups.groupBy(key.alias("facet")).agg(F.count("*").alias("groups"), F.min("cheapest_price").alias("from_price"))


# What users read for units and package types, and the places of types in their list.
UNIT_LABELS = {"CP": "Call of Duty Points (CP)", "VP": "Valorant Points (VP)"}
TYPE_LABELS = {
    "weekly-pass": ("Weekly Diamond Pass", 20), "weekly-card-plus": ("Weekly Card Plus", 25), "weekly-card": ("Weekly Card", 27), "starlight": ("Starlight Membership", 30), "membership": ("Membership", 40), "welkin": ("Welkin Moon", 50), "twilight": ("Twilight Pass", 60), "elite-bundle": ("Weekly Elite Bundle", 70), "epic-bundle": ("Monthly Epic Bundle", 80), "battle-pass": ("Battle Pass", 90), "monthly-pass": ("Monthly Pass", 100), "express-supply-pass": ("Express Supply Pass", 110), "inter-knot-membership": ("Inter-Knot Membership", 120), "coronomicon-monthly": ("Coronomicon Monthly Package", 130), "special-data": ("Special Data", 140), "zero-data": ("Zero Data", 150), "lunite-subscription": ("Lunite Subscription", 160), "other": ("Lainnya", 999),
}
CURRENCIES, UNKNOWN = 10, 500


def labelled_facets(groups: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, facet, label, place, groups): the kinds of packages that a user may choose among, in their order within a scope.

    Currencies are told apart by unit; one whose unit is not known has it read
    off its name again, else it is counted in nominals. Labels of equal places
    are in the order of Indonesian. A facet's label is that of its first name.
    """
    unit = F.nullif(F.trim(F.coalesce("unit", F.lit(""))), F.lit(""))
    read = names.unit_of(F.coalesce("name", F.lit("")))
    unit = F.coalesce(F.nullif(unit, F.lit("Item")), read, F.lit("Nominal"))
    known = F.create_map(*(F.lit(x) for pair in UNIT_LABELS.items() for x in pair))
    types = F.create_map(*(x for k, (label, place) in TYPE_LABELS.items() for x in (F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(place).alias("place")))))
    kind = F.coalesce("package_type", F.lit("other"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", "-"), "^-|-$", "")
    of = types[kind]
    rows = groups.select(
        *scope,
        F.when(kind == "currency", F.concat(F.lit("currency:"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("nominal")))).otherwise(kind).alias("facet"),
        F.when(kind == "currency", F.coalesce(known[unit], unit)).otherwise(F.coalesce(of["label"], F.replace(F.coalesce("name", kind), F.lit("-"), F.lit(" ")))).alias("label"),
        F.when(kind == "currency", CURRENCIES).otherwise(F.coalesce(of["place"], F.lit(UNKNOWN))).alias("order"),
    )
    facets = rows.groupBy(*scope, "facet").agg(F.min("label").alias("label"), F.min("order").alias("order"), F.count("*").alias("groups"))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("order", F.expr("collate(label, 'id')"), "facet"))
    return facets.withColumn("place", place).select(*scope, "facet", "label", "place", "groups")


def page_of(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A page of rows by offset and limit (1 to 20)."""
    return rows.orderBy(order).offset(max(0, offset)).limit(min(20, max(1, limit)))


def first_strict(offers: DataFrame, scope: list[str]) -> DataFrame:
    """The first arriving offer of each normalised name and price within a scope; no names and prices under 100 go."""
    named = offers.filter((F.col("original_name") != "") & (F.col("final_price") >= 100)).withColumn("name_key", normalized(F.col("original_name")))
    return _first_arrived(named, scope, offers.columns)


def sanitized(offers: DataFrame, page_text: str) -> DataFrame:
    """Offers of 100 rupiah at least whose price text, or else page, speaks of rupiah; foreign amounts go."""
    return offers.filter((F.col("final_price") >= 100) & (F.coalesce(F.lower("price_text").rlike(r"(?<![A-Za-z0-9_])(?:idr(?![A-Za-z0-9_])|rp)"), F.lit(False)) | has_mark(F.col(page_text))))


def as_live(offers: DataFrame, strategy: str, replace: bool = False) -> DataFrame:
    """What was read from a page is live; where it was found moves to extraction_source, and the strategy stays if there is one (unless replaced)."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    own = F.lit(strategy) if replace else F.coalesce(blank("access_strategy"), F.lit(strategy))
    return offers.withColumns({"extraction_source": F.coalesce(blank("extraction_source"), blank("source"), F.lit(strategy)), "source": F.lit("live"), "access_strategy": own})


def visible_groups(offers: DataFrame, stores: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """Groups as a user sees them: stores (a table of store_id) are chosen within groups, so that metrics follow and empty groups vanish, then package types."""
    groups = group_offers(offers if stores is None else offers.join(stores, "store_id", "left_semi"))
    return groups.filter(F.col("package_type").isin(types)) if types else groups


def totals(offers: DataFrame, groups: DataFrame, checked_stores: int) -> DataFrame:
    """One row of counts over a search's offers and groups."""
    own = offers.agg(F.count_if(F.col("source") == "live").alias("live_offer_count"), F.count("*").alias("offer_count"), F.count_distinct("store_id").alias("store_count"))
    packages = groups.agg(F.count("*").alias("package_count"))
    return own.crossJoin(packages).withColumn("checked_store_count", F.lit(checked_stores).cast("bigint"))  # one row each


def capped(rows: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many rows of each key in order of arrival; Spark limits each group before the shuffle too."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def registered(adapters: DataFrame, registry: DataFrame) -> DataFrame:
    """Adapters with category and verification of the registry; a store it doesn't know is a partner known by its feed."""
    known = adapters.join(registry.select("store_id", "category", "verification"), "store_id", "left")
    return known.withColumns({"category": F.coalesce("category", F.lit("partner")), "verification": F.coalesce("verification", F.lit("feed"))})


def _laid_over(own: Column, over: Column) -> Column:
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.when(over.isNull(), own).when(own.isNull(), over).otherwise(F.map_concat(kept, over))


def overridden(stores: DataFrame, overrides: DataFrame) -> DataFrame:
    """Stores with what an override says in place of their own; a map keeps the keys that it doesn't name."""
    out = stores.alias("s").join(overrides.alias("o"), "store_id", "left")
    columns = ["store_id"]
    for f in stores.schema:
        if f.name == "store_id":
            continue
        if f.name not in overrides.columns:
            columns.append(F.col(f"s.{f.name}"))
        elif f.dataType.typeName() == "map":
            columns.append(_laid_over(F.col(f"s.{f.name}"), F.col(f"o.{f.name}")).alias(f.name))
        else:
            columns.append(F.coalesce(F.col(f"o.{f.name}"), F.col(f"s.{f.name}")).alias(f.name))
    return out.select(*columns)


def store_pages(games: DataFrame, stores: DataFrame) -> DataFrame:
    """(game_id, store_id, url, code) for each game and store: its address, or that none is configured. Games hold a map of addresses by store."""
    listed = games.select("game_id", F.explode_outer("stores").alias("store_id", "url"))
    chosen = games.select("game_id").crossJoin(F.broadcast(stores.select("store_id")))  # the registry of stores, a few hundred rows of one id
    return chosen.join(listed, ["game_id", "store_id"], "left").withColumn("code", F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.lit("NOT_CONFIGURED")))
