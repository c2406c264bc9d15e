"""Names and prices in serialised text: where they stand, and which belong together.

Spark's own pattern functions don't say where a match stands, so texts are
walked in Arrow batches, one text at a time, and everything after that is a
relation of places: the nearest price by an equi-join on blocks of places, the
object around a name by the innermost pair of braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import money
from offerloom.functions.text import bound, decoded
from offerloom.sources.tables import settled

# Fields that hold a name or a price in serialised state, and how a currency stands before its number.
# Each begins with what its first character can be, so that most places of a text are passed by one look.
NAME_FIELD = r"""(?i)(?=["'pdvitln])["']?(?:productName|product_name|denomination|variantName|variant_name|itemName|item_name|title|label|name)["']?\s*[:=]\s*["']([^"'\\]{2,180})["']"""
PRICE_FIELD = r"""(?i)(?=["'sfdp])["']?(?:sellingPrice|selling_price|sellPrice|sell_price|salePrice|sale_price|finalPrice|final_price|discountPrice|discount_price|productPrice|product_price|price)["']?\s*[:=]\s*["']?([0-9][0-9.,]*)["']?"""
CURRENCY_FIELD = r"""(?i)["']?(?:currency|currencyCode|currency_code|priceCurrency|price_currency)["']?\s*[:=]\s*["']([^"']+)["']"""
MARKED_PRICE = r"(?i)(?=[ir])((?:(?<![A-Za-z0-9_])IDR(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])Rp\s*\.?)\s*[:=\-]?\s*[0-9][0-9.,]*)"
# Variables that pages keep their state in, and escapes of serialised text with what they stand for.
STATE = ["__INITIAL_STATE__", "__PRELOADED_STATE__", "__INITIAL_DATA__", "__APOLLO_STATE__", "__NUXT__", "__NEXT_DATA__"]
ESCAPES = [(r"(?i)\\u00a0", " "), (r"(?i)\\u0020", " "), (r"(?i)\\u0026", "&"), (r"(?i)\\u003a", ":"), (r"(?i)\\u002c", ","), (r"(?i)\\u002e", "."), (r"(?i)\\x3c", "<"), (r"(?i)\\x3e", ">"), (r"(?i)\\x26", "&"), (r"\\n|\\r|\\t", "\n"), (r'\\"', '"'), (r"\\/", "/"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:div|p|li|span|section|article|button|h[1-6])>", "\n"), (r"<[^>]+>", " ")]
# How far before and after a name its price may stand, and how far from a name its object may reach.
BEFORE, AFTER, FORWARD, REACH = 220, 420, 650, 2400

_OPENS = {"}": "{", "]": "["}
_SPECIAL = re.compile(r"""["'\\{}\[\]]""")
_BRACE = re.compile("[{}]")
FLUSH = 20_000


def walked(rows: DataFrame, text_col: str, keep: list[str], walk: Callable[[str], Iterator[tuple]], shape: str) -> DataFrame:
    """keep and the columns of `shape` of everything that walk finds in a row's text; a null text holds nothing."""
    names = [c.strip().split(" ")[0] for c in shape.split(",")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [pa.field(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.strip().split(" ")[1]]) for n, c in zip(names, shape.split(","))]

            def out(at: list[int], found: list[tuple], batch=batch, types=types) -> pa.RecordBatch:
                kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array([f[k] for f in found], t.type) for k, t in enumerate(types))], names=[*keep, *names])

            at: list[int] = []
            found: list[tuple] = []
            for i in range(batch.num_rows):
                for hit in walk(batch.column(len(keep))[i].as_py() or ""):
                    at.append(i)
                    found.append(hit)
                    if len(at) >= FLUSH:
                        yield out(at, found)
                        at, found = [], []
            if at:
                yield out(at, found)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, text_col).mapInArrow(scan, f"{kinds}, {shape}")


def _without(mark: str, patterns: list[tuple[str, str]]) -> Callable[[Column], Column]:
    def without(text: Column) -> Column:
        taken = text
        for pattern, value in patterns:
            taken = F.regexp_replace(taken, pattern, value)
        return F.when(F.contains(text, F.lit(mark)), taken).otherwise(text)

    return without


def serialized(text: Column) -> Column:
    """Serialised text as plain text: escapes and tags taken off, then entities; no script is run."""
    # Escapes hold a backslash and tags a `<`, which an escape may have stood for; most texts hold neither.
    for mark, of_tags in (("\\", False), ("<", True)):
        text = bound(text, _without(mark, [e for e in ESCAPES if ("<" in e[0]) == of_tags]))
    return F.replace(decoded(text), F.lit("\r"), F.lit("\n"))


def found_at(rows: DataFrame, text_col: str, keep: list[str], patterns: list[tuple[int, str]]) -> DataFrame:
    """(keep, kind, start, end, found): each match of each pattern, in characters; `found` is its first group, or all of it."""
    compiled = [(kind, re.compile(p, re.ASCII)) for kind, p in patterns]

    def walk(text: str) -> Iterator[tuple]:
        for kind, pattern in compiled:
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end(), m[1] if pattern.groups else m[0]

    return walked(rows, text_col, keep, walk, "kind int, start long, end long, found string")


def prices_at(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, confidence, start, end, found, price): prices with their currency (3) and in a field for prices (2)."""
    all_ = found_at(rows, text_col, keep, [(3, MARKED_PRICE), (2, PRICE_FIELD)]).withColumnRenamed("kind", "confidence")
    price = F.when(F.col("confidence") == 3, money.recovered(F.col("found"))).otherwise(money.rupiah(F.col("found")))
    return settled(all_, price=price).filter("price > 0")


def nearest(names: DataFrame, prices: DataFrame, keep: list[str], before: int = BEFORE, after: int = AFTER, by_distance: bool = True) -> DataFrame:
    """names with the best price that lies whole between `before` characters before and `after` behind them.

    names: keep, start, end, found; prices: keep, start, end, price, confidence
    (and more). The higher confidence wins, then the smaller distance from the
    name's middle to the price's start (by_distance) or the earlier start; ties
    go to the earlier one. A price is in one block of before + after characters
    and a name in the two or three that its window touches, so the join is by
    equality, and a text of many prices is many keys.
    """
    width = before + after
    window = names.withColumns({"_from": F.greatest(F.lit(0), F.col("start") - before), "_to": F.col("end") + after})
    window = window.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))))
    known = prices.select(*keep, F.floor(F.col("start") / width).alias("_block"), F.struct("start", "end", "price", "confidence").alias("_p"))
    met = window.join(known, [*keep, "_block"]).filter("_p.start >= _from and _p.end <= _to")
    # Twice the distance from the middle, so that it is a whole number.
    far = F.abs(2 * F.col("_p.start") - F.col("start") - F.col("end")) if by_distance else F.col("_p.start")
    order = F.struct((-F.col("_p.confidence")).alias("c"), far.alias("d"), F.col("_p.start").alias("s"), F.col("_p.price").alias("price"), F.col("_p.confidence").alias("confidence"))
    best = met.groupBy(*keep, "start", "end", "found").agg(F.min(order).alias("_b"))
    return best.select(*keep, "start", "end", F.col("found").alias("original_name"), F.col("_b.price").alias("final_price"), F.col("_b.confidence").alias("confidence"), F.col("_b.s").alias("price_start"))


def balanced(text: str, start: int) -> int | None:
    """Where the object or array that opens at start ends; None if it never does. Brackets in strings of either quote don't count."""
    stack, quote, skip = [], "", -1
    for m in _SPECIAL.finditer(text, start):
        c, at = m[0], m.start()
        if at == skip:
            continue
        if quote:
            if c == "\\":
                skip = at + 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "{[":
            stack.append(c)
        elif c in _OPENS:
            if not stack or stack.pop() != _OPENS[c]:
                return None
            if not stack:
                return m.end()
    return None


def outermost(text: str) -> Iterator[tuple[int, int]]:
    """Balanced objects and arrays that lie in no other, from left to right.

    A value that breaks off at a wrong bracket, or at a string without an end,
    is given up there and those that were whole within it stand for themselves,
    so each character is passed once, and once more for each string without an end.
    """
    at = 0
    while True:
        stack, done, quote, skip, cut = [], [], None, -1, len(text)
        for m in _SPECIAL.finditer(text, at):
            c, k = m[0], m.start()
            if k == skip:
                continue
            if quote:
                if c == "\\":
                    skip = k + 1
                elif c == text[quote]:
                    quote = None
            elif c in "\"'":
                quote = k if stack else None
            elif c in "{[":
                stack.append((c, k))
            elif c in _OPENS:
                if not stack:
                    continue
                c0, k0 = stack.pop()
                if c0 != _OPENS[c]:
                    cut = k + 1
                    break
                while done and done[-1][0] > k0:
                    done.pop()
                done.append((k0, k + 1))
        yield from done
        if quote is not None and cut == len(text):
            at = quote + 1
        elif cut < len(text):
            at = cut
        else:
            return


def values(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, start, end, document): the outermost balanced objects and arrays of each text."""
    return walked(rows, text_col, keep, lambda t: ((a, b, t[a:b]) for a, b in outermost(t)), "start long, end long, document string")


def assigned(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep, variable, start, end, document): what scripts assign to the variables of STATE, if it is balanced; in their order by variable, then place."""
    patterns = [(v, re.compile(rf"{v}\s*=\s*")) for v in STATE]  # what may stand before a variable decides nothing

    def walk(text: str) -> Iterator[tuple]:
        for variable, pattern in patterns:
            for m in pattern.finditer(text) if variable in text else ():
                end = balanced(text, m.end()) if text[m.end() : m.end() + 1] in ("{", "[") else None
                if end:
                    yield variable, m.end(), end, text[m.end() : end]

    return walked(rows, text_col, keep, walk, "variable string, start long, end long, document string")


def enclosing(rows: DataFrame, text_col: str, keep: list[str], patterns: list[str], reach: int = REACH) -> DataFrame:
    """(keep, start, found, object_start, object): each match with the innermost braces around its start, `reach` characters away at most.

    Braces are paired by a stack in one pass; strings are not looked at, as
    fragments may begin inside one. A match without braces around it is left out.
    """
    compiled = [re.compile(p, re.ASCII) for p in patterns]

    def walk(text: str) -> Iterator[tuple]:
        hits = sorted({(m.start(), m[0]) for p in compiled for m in p.finditer(text)})
        if not hits:
            return
        ends: dict[int, int] = {}
        stack: list[int] = []
        around: list[int | None] = []
        k = 0
        for m in _BRACE.finditer(text):
            while k < len(hits) and hits[k][0] < m.start():
                around.append(stack[-1] if stack else None)
                k += 1
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                ends[stack.pop()] = m.end()
        for (start, found), begin in zip(hits, around):
            end = ends.get(begin)
            if end and start - begin <= reach and end - start <= reach:
                yield start, found, begin, text[begin:end]

    return walked(rows, text_col, keep, walk, "start long, found string, object_start long, object string")


def _number(text: Column) -> Column:
    """A field's number in rupiah, of 100 at least; dots and commas are left out."""
    return bound(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), lambda price: F.when(price >= 100, price))


def object_price(fragment: Column, speaks: Column) -> Column:
    """Price within an object's own text: marked, or else its first price field if the object's currency, or the page without one, is rupiah."""
    known = bound(F.regexp_extract(fragment, CURRENCY_FIELD, 1), lambda currency: F.when(currency != "", money.is_rupiah_code(currency)).otherwise(speaks))
    return F.coalesce(money.first_strict(fragment), F.when(known, _number(F.regexp_extract(fragment, PRICE_FIELD, 1))))


def fragment_offers(rows: DataFrame, text_col: str, keep: list[str], patterns: list[str]) -> DataFrame:
    """(keep, start, original_name, final_price): names with the price of the innermost object that holds them, never of another; the first of equal ones stays."""
    marked = rows.withColumn("_speaks", money.has_mark(F.col(text_col)).cast("string"))
    found = enclosing(marked, text_col, [*keep, "_speaks"], patterns)
    priced = settled(found, final_price=object_price(F.col("object"), F.col("_speaks") == "true")).filter("final_price is not null")
    return priced.groupBy(*keep, F.col("found").alias("original_name"), "final_price").agg(F.min("start").alias("start"))


# Fields of a flat object that hold its name or its price, in order of precedence.
FLAT_NAMES = ["name", "product_name", "productName", "denomination", "title", "label"]
FLAT_PRICES = ["price", "selling_price", "sellingPrice", "sell_price", "sellPrice", "sale_price", "salePrice", "nominal_price", "final_price", "finalPrice", "discount_price", "discountPrice", "total_price", "totalPrice"]


def flat_objects(rows: DataFrame, script_col: str, keep: list[str]) -> DataFrame:
    """(keep, pos, name, price_text): objects of up to 900 characters without braces inside, in scripts that speak of prices.

    The name is the first of FLAT_NAMES that holds a string, the price the first
    of FLAT_PRICES that is there at all (null: none).
    """
    speaks = F.col(script_col).rlike("(?i)price|sellingPrice|productName|denomination")
    objects = F.regexp_extract_all(F.col(script_col), F.lit(r"(\{[^{}]{0,900}\})"), F.lit(1))
    each = rows.filter(speaks).select(*keep, F.posexplode(objects).alias("pos", "_o"))
    each = settled(each, _m=F.try_variant_get(F.try_parse_json("_o"), "$", "map<string,variant>")).filter("_m is not null")
    text = lambda k: F.when(F.schema_of_variant(F.col("_m")[k]) == "STRING", F.try_variant_get(F.col("_m")[k], "$", "string"))
    name = F.coalesce(*(text(F.lit(k)) for k in FLAT_NAMES))
    there = F.get(F.filter(F.array(*map(F.lit, FLAT_PRICES)), lambda k: F.map_contains_key("_m", k)), F.lit(0))
    return settled(each, name=name, _k=there).filter("name is not null and _k is not null").select(*keep, "pos", "name", F.try_variant_get(F.col("_m")[F.col("_k")], "$", "string").alias("price_text"))
