"""Page scans: extractors as a registry of functions, their union, strategies chosen by a table, and why a page gave nothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from offerloom.functions import money, pages, text
from offerloom.operators import lines, serialized, structured
from offerloom.sources.tables import settled

Extractor = Callable[[DataFrame], DataFrame]
#: Offers kept of a page, and how many lines behind its product a price may stand unless a store says otherwise.
MOST, DISTANCE = 200, 8
SHAPE = ["page_id", "pos", "original_name", "final_price"]


def from_lines(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    return lines.list_offers(lines.listed(rows), distance).select(*SHAPE)


def from_scripts(rows: DataFrame) -> DataFrame:
    """Flat objects in any script; pos follows the scripts, then the objects."""
    bodies = rows.select("page_id", F.posexplode(pages.scripts(F.col("html"))).alias("at", "s")).select("page_id", "at", F.col("s.body").alias("body"))
    found = serialized.flat_objects(bodies, "body", ["page_id", "at"]).filter(text.is_product(F.col("name")))
    priced = settled(found, final_price=money.rupiah(F.col("price_text"))).filter("final_price > 0")
    return priced.select("page_id", (F.col("at") * 100_000 + F.col("pos")).cast("int").alias("pos"), F.col("name").alias("original_name"), "final_price")


def from_documents(rows: DataFrame) -> DataFrame:
    """Products of the JSON documents; pos follows their paths."""
    found = structured.structured_offers(structured.documents(rows))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("doc", "path", "final_price"))
    return found.select("page_id", place.alias("pos"), "original_name", "final_price")


#: What a strategy table may name. Others can be added by whoever runs a scan.
EXTRACTORS: dict[str, Extractor] = {"lines": from_lines, "scripts": from_scripts, "documents": from_documents}


def scanned(rows: DataFrame, extractors: Mapping[str, Extractor] = EXTRACTORS, watch: Mapping[str, Observation] | None = None, most: int = MOST) -> DataFrame:
    """(page_id, extractor, pos, original_name, final_price): what the extractors find on each page, in their order.

    Of offers with one name (but for case and blanks) and price the first stays,
    at most `most` a page. watch: an Observation for each extractor that is to
    be counted in the same pass (offers).
    """
    found = None
    for no, (name, extract) in enumerate(extractors.items()):
        own = extract(rows).select(*SHAPE).withColumns({"extractor": F.lit(name), "_no": F.lit(no)})
        if watch and name in watch:
            own = own.observe(watch[name], F.count("*").alias("offers"))
        found = own if found is None else found.unionByName(own)
    # One exchange by pages serves both orders.
    same = Window.partitionBy("page_id", F.lower(text.squeezed(F.col("original_name"))), "final_price").orderBy("_no", "pos")
    first = found.repartition("page_id").withColumn("_k", F.row_number().over(same)).filter("_k = 1")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("_no", "pos"))
    return first.withColumn("_k", place).filter(F.col("_k") <= most).select("page_id", "extractor", "pos", "original_name", "final_price")


def by_strategy(rows: DataFrame, strategies: DataFrame, extractors: Mapping[str, Extractor] = EXTRACTORS) -> DataFrame:
    """Offers of the first of each store's strategies that gives a page any: page_id, stage, extractor, pos, original_name, final_price.

    rows: page_id, store_id, html; strategies: store_id, stage, strategy. Each
    extractor runs over the pages of the stores that name it; strategies that
    nobody registered are passed over, and stores without any give no offers. An
    extractor hands page_id on as it is; here it is a page's id and stage in one.
    """
    found = None
    for name, extract in extractors.items():
        chosen = rows.join(strategies.filter(F.col("strategy") == name).groupBy("store_id").agg(F.min("stage").alias("stage")), "store_id")
        # The stage goes along within the page's id, so that pages are built once for each extractor.
        own = extract(chosen.select(F.struct("page_id", "stage").alias("page_id"), "html")).select("page_id.*", *SHAPE[1:]).withColumn("extractor", F.lit(name))
        found = own if found is None else found.unionByName(own)
    first = found.withColumn("_first", F.min("stage").over(Window.partitionBy("page_id")))
    return first.filter("stage = _first").select("page_id", "stage", "extractor", "pos", "original_name", "final_price")


def diagnosed(rows: DataFrame, kept, extractors: Mapping[str, Extractor] = EXTRACTORS) -> DataFrame:
    """(page_id, products, prices, documents, found, kept, reason) for each page, all counted on the page itself.

    products and prices are lines (a key in running text that ends like an
    amount is no product), documents JSON scripts, found the offers of
    all extractors, kept those for which the condition `kept` holds; pages that
    need no explanation have the reason of a partial match too, as a caller asks
    only about pages that disappointed.
    """
    line = F.col("line")
    counted = lines.page_lines(rows).groupBy("page_id").agg(F.count_if(text.is_product(line) & text.is_product(text.without_keys(line))).alias("products"), F.count_if(money.has_price(line)).alias("prices"))
    documents = structured.documents(rows).groupBy("page_id").agg(F.count("*").alias("documents"))
    offers = scanned(rows, extractors).groupBy("page_id").agg(F.count("*").alias("found"), F.count_if(kept).alias("kept"))
    out = rows.select("page_id", pages.dynamic_signals(F.col("html"))["likely_dynamic"].alias("_dynamic"))
    for part in (counted, documents, offers):
        out = out.join(part, "page_id", "left")
    out = out.fillna(0, ["products", "prices", "documents", "found", "kept"])
    reason = pages.parser_reason(F.col("found"), F.col("kept"), F.col("_dynamic"), F.col("products"), F.col("prices"), F.col("documents"))
    return out.select("page_id", "products", "prices", "documents", "found", "kept", reason.alias("reason"))
