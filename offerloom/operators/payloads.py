"""Product rows in JSON payloads of stores' interfaces: which array holds them, and what each row says."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions import money
from offerloom.functions.text import bound, normalized
from offerloom.sources.tables import settled

# Fields of a row that hold a name or a price, in order of precedence; where payloads keep their rows; fields that name a row's game.
ROW_NAMES = ["name", "productName", "product_name", "title", "denomination", "label", "packageName", "package_name", "itemName", "item_name"]
ROW_PRICES = ["finalPrice", "final_price", "sellingPrice", "selling_price", "sellPrice", "sell_price", "salePrice", "sale_price", "discountPrice", "discount_price", "price", "amount"]
ROW_PLACES = ["products", "data.products", "data.items", "data", "items", "result.products", "result.items", "result"]
ROW_GAMES = ["game", "gameName", "game_name", "gameId", "game_id", "categoryName", "category_name"]
#: How deep arrays are looked for, how many entries of an array are looked into, and how many rows decide its score.
DEPTH, ENTRIES, JUDGED = 5, 30, 8
#: Fixed value: offers that are kept of one payload.
MOST = 200


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def at_path(v: Column, path: str) -> Column:
    """The value at a dotted path with [n] for places of arrays; null where it is missing."""
    return F.try_variant_get(v, f"$.{path}", "variant")


def first_defined(v: Column, fields: list[str]) -> Column:
    """The first of some fields of an object that is there, is not null and not blank; fields with dots or brackets are paths."""
    there = lambda x: x.isNotNull() & (F.schema_of_variant(x) != "VOID") & ((F.schema_of_variant(x) != "STRING") | F.try_variant_get(x, "$", "string").rlike(r"\S"))
    out: list[Column] = []
    for paths, some in groupby(fields, lambda f: "." in f or "[" in f):
        some = list(some)
        # The fields of a row are laid out once, not once for each name.
        found = F.array(*(at_path(v, f) for f in some)) if paths else bound(F.try_variant_get(v, "$", "map<string,variant>"), lambda held: F.transform(F.array(*map(F.lit, some)), lambda k: held[k]))  # noqa: B023
        out.append(F.get(F.filter(found, there), F.lit(0)))
    return F.coalesce(*out)


def row_score(v: Column) -> Column:
    """How much an array looks like product rows: 3 for each name and each price in its first rows."""
    rows = F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, JUDGED)
    each = F.transform(rows, lambda r: F.when(is_object(r), F.when(first_defined(r, ROW_NAMES).isNotNull(), 3).otherwise(0) + F.when(first_defined(r, ROW_PRICES).isNotNull(), 3).otherwise(0)).otherwise(0))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(0))


def containers(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, depth, path, v): a payload and the objects and arrays in it, DEPTH levels down; path has the places taken, fields in the order of their names."""
    node = "array<struct<path array<int>, v variant>>"
    rows = docs.select(id_col, F.array().cast("array<int>").alias("path"), "v")
    for level in range(DEPTH):
        v, path = F.col("v"), F.col("path")
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: e["value"])
        items = F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, ENTRIES)
        below = F.transform(F.coalesce(items, fields), lambda x, k: F.struct(F.array_append(path, k).alias("path"), x.alias("v")))  # noqa: B023
        below = F.coalesce(F.filter(below, lambda c: is_array(c["v"]) | is_object(c["v"])).cast(node), F.array().cast(node))
        here = F.array(F.struct(path.alias("path"), v.alias("v"))).cast(node)
        # Only what was reached in the step before opens; the rest goes by as it is.
        rows = rows.select(id_col, F.explode(F.when(F.size(path) == level, F.concat(here, below)).otherwise(here)).alias("n")).select(id_col, "n.*")
    return rows.select(id_col, F.size("path").alias("depth"), "path", "v")


def best_arrays(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, score, path, v): of each payload the array of the highest score, the first in order of breadth of equal ones; payloads without one give no row."""
    scored = settled(containers(docs, id_col).filter(is_array(F.col("v"))), score=row_score(F.col("v"))).filter("score > 0")
    order = F.struct((-F.col("score")).alias("s"), "depth", "path")
    # A variant can't be compared, so it travels beside the order, never in it.
    return scored.groupBy(id_col).agg(F.min_by(F.struct("score", "path", "v"), order).alias("b")).select(id_col, "b.score", "b.path", "b.v")


def product_rows(docs: DataFrame, id_col: str, result_path: str | None = None) -> DataFrame:
    """(id, pos, row): rows of each payload's array: the one at result_path, else the payload itself, else the first known place whose rows score, else the best array."""
    v = F.col("v")
    if result_path:
        chosen = docs.select(id_col, at_path(v, result_path).alias("v")).filter(is_array(F.col("v")))
    else:
        places = F.array(*(at_path(v, p) for p in ROW_PLACES))
        known = F.coalesce(F.when(is_array(v), v), F.get(F.filter(places, lambda x: is_array(x) & (row_score(x) > 0)), F.lit(0)))
        direct = settled(docs, _at=known)
        chosen = direct.filter("_at is not null").select(id_col, F.col("_at").alias("v")).union(best_arrays(direct.filter("_at is null").select(id_col, "v"), id_col).select(id_col, "v"))
    return chosen.select(id_col, F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "row"))


def matches_game(row: Column, identities: Column) -> Column:
    """Whether a row's game is one of the normalised identities (of 3 letters or more), or holds or is held by one; rows that name no game match."""
    held = F.try_variant_get(row, "$", "map<string,variant>")
    kinds = "^(?:STRING|BIGINT|DOUBLE|DECIMAL|FLOAT)"
    texts = F.filter(F.transform(F.array(*map(F.lit, ROW_GAMES)), lambda k: held[k]), lambda x: F.schema_of_variant(x).rlike(kinds))
    said = F.filter(F.transform(texts, lambda x: normalized(F.try_variant_get(x, "$", "string"))), lambda s: s != "")
    long = F.filter(identities, lambda i: F.char_length(i) >= 3)
    return (F.size(said) == 0) | F.exists(said, lambda s: F.exists(long, lambda i: F.contains(s, i) | F.contains(i, s)))


def payload_offers(docs: DataFrame, id_col: str, identities: Column | None = None, scale: float = 1.0, result_path: str | None = None) -> DataFrame:
    """(id, pos, original_name, final_price) of the first MOST rows with a name and a price above nothing, of the wanted game if identities are given.

    Payloads that are null, or hold no array, give no
    row; a price's number is multiplied by scale.
    """
    rows = product_rows(docs, id_col, result_path)
    text = lambda x: F.try_variant_get(x, "$", "string")
    if identities is not None:
        rows = rows.filter(matches_game(F.col("row"), identities))
    name = F.btrim(text(first_defined(F.col("row"), ROW_NAMES)))
    offers = settled(rows, original_name=name, final_price=money.api_price(text(first_defined(F.col("row"), ROW_PRICES)), F.lit(float(scale))))
    offers = offers.filter("original_name is not null and final_price > 0").select(id_col, "pos", "original_name", "final_price")
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    return offers.withColumn("_k", place).filter(F.col("_k") <= MOST).drop("_k")
