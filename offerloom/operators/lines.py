"""Lines of pages: slices, scopes and the nearest price after a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions import money, text
from offerloom.functions.text import lines


def page_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, line) of every visible line."""
    return pages.select(id_col, F.posexplode(lines(F.col(html_col))).alias("pos", "line"))


def listed(pages: DataFrame, start: str | None = None, end: str | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, lines): the visible lines of each page in one row, with their places (pos, line); those between two marks if given, as slice_lines has them."""
    placed = F.transform(lines(F.col(html_col)), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    return pages.select(id_col, (placed if start is None else text.bound(placed, lambda held: _between(held, start, end))).alias("lines"))


def _between(held: Column, start: str, end: str) -> Column:
    """The lines after the first that fits start and before the next that fits end; a missing mark bounds nothing."""
    begin = F.array_position(F.transform(held, lambda x: x["line"].rlike(start)), True)
    after = text.bound(begin, lambda b: F.slice(held, b.cast("int") + 1, F.greatest(F.size(held), F.lit(1))))
    stop = lambda rest: F.array_position(F.transform(rest, lambda x: x["line"].rlike(end)), True).cast("int")
    return text.bound(after, lambda rest: text.bound(stop(rest), lambda s: F.when(s > 0, F.slice(rest, 1, s - 1)).otherwise(rest)))


def slice_lines(rows: DataFrame, start: str, end: str, id_col: str = "page_id") -> DataFrame:
    """Lines after the first that fits start and before the next that fits end; a missing mark bounds nothing."""
    page = Window.partitionBy(id_col)
    begin = F.min(F.when(F.col("line").rlike(start), F.col("pos"))).over(page)
    rows = rows.withColumn("_begin", F.coalesce(begin, F.lit(-1)))
    stop = F.min(F.when(F.col("line").rlike(end) & (F.col("pos") > F.col("_begin")), F.col("pos"))).over(page)
    return rows.withColumn("_stop", stop).filter("pos > _begin and (_stop is null or pos < _stop)").drop("_begin", "_stop")


def in_scope(rows: DataFrame, mark: str, within: int, id_col: str = "page_id") -> DataFrame:
    """Lines at most `within` lines after one that fits mark."""
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("line").rlike(mark), F.col("pos"))).over(so_far)
    return rows.withColumn("since", F.col("pos") - last).filter(F.col("since") <= within)


# Headings under which pages show other things than the one asked for, and how many lines belong to it.
OTHERS = r"(?i)^(?:game lainnya|other games|produk lainnya|other products|rekomendasi game|game rekomendasi|game populer|popular games|you may also like|related games|rekomendasi|recommendations)$"
BEFORE, AFTER = 2, 90


def section(rows: DataFrame, anchor, ends=None, before: int = BEFORE, after: int = AFTER, id_col: str = "page_id") -> DataFrame:
    """Lines around the first for which anchor holds, up to the next for which ends holds (OTHERS unless given); pages without an anchor give none."""
    page = Window.partitionBy(id_col)
    ends = F.trim("line").rlike(OTHERS) if ends is None else ends
    rows = rows.withColumn("_at", F.min(F.when(anchor, F.col("pos"))).over(page))
    stop = F.min(F.when(ends & (F.col("pos") > F.col("_at")), F.col("pos"))).over(page)
    kept = rows.withColumn("_stop", F.least(F.coalesce(stop, F.col("_at") + after), F.col("_at") + after))
    return kept.filter((F.col("pos") >= F.col("_at") - before) & (F.col("pos") < F.col("_stop"))).drop("_at", "_stop")


def nearest_following(rows: DataFrame, key: str, order: list[str], is_product, price, distance: int) -> DataFrame:
    """Products with the first price in the next `distance` rows that comes before the next product."""
    by = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumns({"_product": is_product.cast("int"), "_price": price}).withColumn("segment", F.sum("_product").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ahead = Window.partitionBy(key, "segment").orderBy(*order).rowsBetween(Window.currentRow, distance)
    return rows.withColumn("price", F.first("_price", ignorenulls=True).over(ahead)).filter("_product = 1 and price is not null").drop("_product", "_price")


def line_offers(rows: DataFrame, distance: int, id_col: str = "page_id") -> DataFrame:
    """list_offers of lines that are rows (id, pos, line)."""
    return list_offers(rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines")), distance, id_col)


def list_offers(rows: DataFrame, distance: int, id_col: str = "page_id") -> DataFrame:
    """(id, pos, original_name, final_price, price_text): products with the nearest price at or after their line.

    rows: id and lines of each page (listed). A price lies at most `distance`
    lines away (one line for a named package) and before the next product.
    Instructions, marketing and rounded prices are passed over, and a price must
    carry its currency. Of equal names and prices of a page the first stays.
    Only lines that are a product or hold a price are kept, so that a product's
    price is in its own line or in the next one kept.
    """
    marks = rf"{text.WORD}(?:idr{text.END}|rp)"

    def read(line: Column, low: Column) -> Column:
        """A line's kind and price. One that is a price and nothing else needs no other rule."""
        price = F.when(text.speaks_of_rupiah(low) & low.rlike(marks) & ~text.is_marketing(line), money.rupiah(line))
        whole = F.struct(text.product_kind(line).alias("kind"), price.alias("price"))
        return text.bound(money.bare_number(low), lambda n: F.when(n != "", F.struct(F.lit(0).alias("kind"), money.token(n).alias("price"))).otherwise(whole))

    marked = F.transform("lines", lambda x, i: F.struct(i.alias("at"), x["pos"].alias("pos"), x["line"].alias("line"), text.bound(F.lower(x["line"]), lambda low: read(x["line"], low)).alias("said")))
    # Kept of a page: its products and prices in their order.
    marked = F.transform(F.filter(marked, lambda x: (x["said"]["kind"] > 0) | (x["said"]["price"] > 0)), lambda x: F.struct(x["at"].alias("at"), x["pos"].alias("pos"), x["line"].alias("line"), x["said"]["kind"].alias("kind"), x["said"]["price"].alias("price")))

    def met(own: Column, next_: Column) -> Column:
        near = (next_["kind"] == 0) & (next_["at"] - own["at"] <= F.when(own["kind"] == 2, 1).otherwise(distance))
        priced = F.when(own["price"] > 0, own).when(near, next_)
        return F.when(own["kind"] > 0, F.struct(own["pos"].alias("pos"), own["line"].alias("name"), priced["price"].alias("price"), priced["line"].alias("text")))

    pairs = text.bound(marked, lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), met))
    found = rows.select(id_col, F.explode(F.filter(pairs, lambda o: o["price"].isNotNull())).alias("o"))
    offers = found.select(id_col, "o.pos", F.col("o.name").alias("original_name"), F.col("o.price").alias("final_price"), F.col("o.text").alias("price_text"))
    first = Window.partitionBy(id_col, F.lower(text.squeezed(F.col("original_name"))), "final_price").orderBy("pos")
    return offers.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def unit_near_price(rows: DataFrame, is_unit, id_col: str = "page_id", within: int = 5) -> DataFrame:
    """(id, paired): whether a page has a line of a unit with an exact price in it or in the next few lines."""
    line = F.col("line")
    ahead = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.currentRow, within)
    price = F.bool_or(money.has_price(line) & ~money.is_start_price(line)).over(ahead)
    return rows.withColumn("_paired", is_unit & price).groupBy(id_col).agg(F.bool_or("_paired").alias("paired"))
