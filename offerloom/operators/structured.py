"""Offers in the JSON documents that pages carry.

A document is walked once, in Arrow batches, one document at a time; each of its
objects that a price may belong to becomes a row with its path and what is said
of that price, so that work grows with the objects there are and nothing is sent.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import money, pages, text
from offerloom.sources.tables import settled

# Fields that hold a name, a price or an address, in order of precedence, and those whose objects hold a product's price.
NAME_KEYS = ["name", "product_name", "productName", "denomination", "title", "label", "package_name", "packageName", "item_name", "itemName"]
PRICE_KEYS = ["price", "selling_price", "sellingPrice", "sell_price", "sellPrice", "sale_price", "salePrice", "nominal_price", "nominalPrice", "final_price", "finalPrice", "discount_price", "discountPrice", "total_price", "totalPrice", "lowPrice", "highPrice"]
URL_KEYS = ["url", "link", "href", "purchaseUrl", "purchase_url"]
NESTED = ["offers", "offer", "priceSpecification", "price_specification", "pricing", "variant", "variants"]
#: How deep a document is walked, and how far below its product a price may stand.
DEPTH, BELOW = 18, 3

_STEP = "struct<key string, pos int>"


def documents(rows: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, doc, v): the JSON scripts of each page in their order; what doesn't parse is left out."""
    script = rows.select(id_col, F.posexplode(pages.scripts(F.col(html_col))).alias("doc", "s"))
    kind = F.col("s.type").rlike(r"application/(?:ld\+json|json)") | F.col("s.id").rlike(r"(?i)^__(?:NEXT|NUXT)_DATA__$")
    return settled(script.filter(kind), v=pages.json_document(F.col("s.body"))).filter("v is not null").select(id_col, "doc", "v")


def _price(text: Column, number: Column) -> Column:
    """A number above nothing rounded, or the price that a text says."""
    whole = F.floor(number + 0.5).cast("bigint")
    return F.when(text.isNotNull(), money.structured(text)).when(whole > 0, whole)


def _said(held: dict, keys: list[str]) -> str | None:
    """The first of some fields that holds a text that is not blank, its ends trimmed."""
    for k in keys:
        if isinstance(held.get(k), str) and (found := held[k].strip(" \t\r\n\u00a0")):
            return found
    return None


def _number(x) -> float | None:
    try:
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 1e15 else None
    except OverflowError:
        return None


def _walk(value, path: tuple, names: tuple) -> Iterator[tuple[tuple, tuple, dict]]:
    """(path, names of the objects around it, object) of every object, DEPTH levels down, fields in their order."""
    if isinstance(value, dict):
        yield path, names, value
        below = [((k, -1), v) for k, v in value.items()]
        own = _said(value, NAME_KEYS)
        names = names + (own,) if own else names
    else:
        below = [((None, k), v) for k, v in enumerate(value)]
    if len(path) < DEPTH:
        for step, v in below:
            if isinstance(v, (dict, list)):
                yield from _walk(v, (*path, step), names)


def _told(held: dict, deep: int, below: int = BELOW) -> list[list[tuple]]:
    """What an object's fields say of its price, and what the objects in its fields for prices say, outer before inner and in the order of those fields."""
    there = [held[k] for k in PRICE_KEYS if k in held]
    own = [(x, None) if isinstance(x, str) else (None, _number(x)) for x in there if isinstance(x, str) or _number(x) is not None]
    out = [own] if own else []
    for k in NESTED if below else ():
        v = held.get(k)
        if isinstance(v, dict) and deep < DEPTH:
            out += _told(v, deep + 1, below - 1)
        elif isinstance(v, list) and deep + 1 < DEPTH:
            for x in v:
                if isinstance(x, dict):
                    out += _told(x, deep + 2, below - 1)
    return out


def objects(docs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, doc, path, names, name, url, prices): the objects of the documents that have something said of their price, by themselves or in their fields for prices.

    prices has an array for each object that says something, in their order.
    names are those of the objects around one without a name, from inside out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def lists(rows: list, values: pa.Array) -> pa.Array:
        """Values that follow one another as lists as long as the rows."""
        return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(2).to_pylist()):
                value = json.loads(t)
                for path, names, held in _walk(value, (), ()) if isinstance(value, (dict, list)) else ():
                    told = _told(held, len(path))
                    if told:
                        name = _said(held, NAME_KEYS)
                        rows.append((i, path, () if name else names[::-1], name, _said(held, URL_KEYS), told))
            if rows:
                at, paths, around, name, url, told = zip(*rows)
                at, each = pa.array(at, pa.int64()), list(itertools.chain.from_iterable(told))
                keys, places = zip(*itertools.chain.from_iterable(paths)) if any(paths) else ((), ())
                texts, numbers = zip(*itertools.chain.from_iterable(each))
                step = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32())], names=["key", "pos"])
                said = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(numbers, pa.float64())], names=["text", "number"])
                columns = [lists(paths, step), lists(around, pa.array(list(itertools.chain.from_iterable(around)), pa.string())), pa.array(name, pa.string()), pa.array(url, pa.string()), lists(told, lists(each, said))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=[id_col, "doc", "path", "names", "name", "url", "prices"])

    shape = f"{id_col} {kind}, doc int, path array<{_STEP}>, names array<string>, name string, url string, prices array<array<struct<text string, number double>>>"
    return docs.filter("v is not null").select(id_col, "doc", F.to_json("v")).mapInArrow(scan, shape)


def structured_offers(docs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, doc, path, original_name, final_price, url) of objects that name a product and have a price.

    An object without a name takes that of the nearest object around it that
    names a product. Its price is its own, or else the first one up to three
    levels down through the fields for prices, outer before inner and in the
    order of those fields. Documents that are null hold nothing; fields of one
    object are walked in the order of their names.
    """
    first = lambda told: F.get(F.filter(F.transform(told, lambda p: _price(p["text"], p["number"])), lambda x: x.isNotNull()), F.lit(0))
    price = F.get(F.filter(F.transform("prices", first), lambda x: x > 0), F.lit(0))
    # Names of one object in their order of precedence: the first that is a product counts, its own alone if it has one.
    name = F.get(F.filter(F.when(F.col("name").isNull(), F.col("names")).otherwise(F.array("name")), lambda n: text.is_product(n)), F.lit(0))
    found = settled(objects(docs, id_col), original_name=name).filter("original_name is not null")
    return settled(found, final_price=price).filter("final_price is not null").select(id_col, "doc", "path", "original_name", "final_price", "url")
