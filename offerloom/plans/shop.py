"""Queries over pages and payloads that are made of the given line items: each order is a page of offers.

What a page says is known from its items, so the SQL never reads the pages: it
works out from the items and the lengths of the texts what must be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions import money, pages, text
from offerloom.functions.names import dotted
from offerloom.operators import crawl, payloads, serialized
from offerloom.sources.tables import settled, table

QUERIES, ORACLES = {}, {}

# Fixed values of the mapping: what the items count, and the packages without a number.
UNITS = ["Diamonds", "UC", "Genesis Crystals", "Robux", "Tokens", "Points", "Coins", "Vouchers"]
PACKAGES = ["Weekly Diamond Pass", "Starlight Membership", "Twilight Pass", "Blessing of the Welkin Moon"]
HEAD, TAIL = "<html><script>window.__INITIAL_STATE__ = ", ";var z={};</script><p>{not closed</p></html>"
NOTE = r'"note":"a } b { \" ]"'
COUNTED = [rf"(?i)(?<![A-Za-z0-9_])\d[\d.,]*\s*(?:{'|'.join(UNITS)})(?![A-Za-z0-9_])", rf"(?i)(?:{'|'.join(PACKAGES)})(?:\s*[x×]\s*\d+)?"]


def _s(c: str):
    return F.col(c).cast("string")


def items(spark, sf) -> DataFrame:
    """Items of each order with their place k, a name and a price."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pick = lambda names, n: F.array(*map(F.lit, names))[n.cast("int")]
    part = F.col("l_partkey")
    name = F.when(part % 5 == 4, pick(PACKAGES, F.floor(part / 5) % len(PACKAGES))).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), pick(UNITS, part % len(UNITS))))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), part.alias("pk"), F.col("l_suppkey").alias("sk"), F.row_number().over(by).alias("k"), name.alias("name"), F.floor(F.col("l_extendedprice") + 0.5).cast("bigint").alias("price"))


#: The same items in SQL.
ITEMS = f"""items AS (SELECT l_orderkey AS page_id, l_partkey AS pk, l_suppkey AS sk, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS k,
 CASE WHEN l_partkey % 5 = 4 THEN {PACKAGES}[1 + (l_partkey // 5) % {len(PACKAGES)}] ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ' || {UNITS}[1 + l_partkey % {len(UNITS)}] END AS name, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS price FROM lineitem)"""
DOTTED = "replace(format('{:,}', price), ',', '.')"


def _joined(rows: DataFrame, piece, between: str = "") -> DataFrame:
    """One text of each page's pieces in their order."""
    whole = F.array_join(F.sort_array(F.collect_list(F.struct("k", piece.alias("t")))).getField("t"), between)
    return rows.groupBy("page_id").agg(whole.alias("text"))


def _parts(rows: DataFrame, pieces: dict) -> DataFrame:
    """Several texts of each page's pieces in their order, gathered at once."""
    held = F.sort_array(F.collect_list(F.struct("k", *(p.alias(n) for n, p in pieces.items()))))
    return rows.groupBy("page_id").agg(held.alias("_held")).select("page_id", *(F.array_join(F.col("_held")[n], "").alias(n) for n in pieces))


def state_pages(spark, sf) -> DataFrame:
    """Pages whose script assigns a state: names with their price, with a price in another currency or in an outer object only."""
    k = F.col("k") % 3
    price = F.concat(F.lit('","currency":"'), F.when(F.col("pk") % 2 == 1, "USD").otherwise("IDR"), F.lit('","price":"'), _s("price"), F.lit('"}'))
    item = (
        F.when(k == 0, F.concat(F.lit('{"price":"Rp 1.000","info":{"name":"'), "name", F.lit('"}}')))
        .when(k == 1, F.concat(F.lit('{"name":"'), "name", F.lit('","price":"Rp '), dotted(F.col("price")), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"name":"'), "name", price))
    )
    whole = F.concat(F.lit(HEAD + '{"page":'), _s("page_id"), F.lit(f',{NOTE},"items":['), "text", F.lit("]}" + TAIL))
    return _joined(items(spark, sf), item, ",").select("page_id", whole.alias("html"))


_ITEM = f"""CASE k % 3 WHEN 0 THEN '{{"price":"Rp 1.000","info":{{"name":"' || name || '"}}}}' WHEN 1 THEN '{{"name":"' || name || '","price":"Rp ' || {DOTTED} || '"}}' ELSE '{{"name":"' || name || '","currency":"' || CASE WHEN pk % 2 = 1 THEN 'USD' ELSE 'IDR' END || '","price":"' || price || '"}}' END"""
STATES = f"""{ITEMS}, states AS (SELECT page_id, '{{"page":' || page_id || ',{NOTE},"items":[' || string_agg({_ITEM}, ',' ORDER BY k) || ']}}' AS document FROM items GROUP BY page_id)"""


def assigned_documents(spark, sf):
    return serialized.assigned(state_pages(spark, sf), "html", ["page_id"])


def page_values(spark, sf):
    """Outermost JSON-like values of the raw pages and of the pages of states."""
    raw = table(spark, sf, "pages").select(F.lit("raw").alias("kind"), "page_id", "html")
    both = raw.union(state_pages(spark, sf).select(F.lit("state"), "page_id", "html"))
    return serialized.values(both, "html", ["kind", "page_id"])


def fragment_offers(spark, sf):
    return serialized.fragment_offers(state_pages(spark, sf), "html", ["page_id"], COUNTED).select("page_id", "original_name", "final_price")


def flat_offers(spark, sf):
    """Offers in flat objects of scripts."""
    bodies = state_pages(spark, sf).select("page_id", F.explode(pages.scripts(F.col("html"))).alias("s")).select("page_id", F.col("s.body").alias("body"))
    found = serialized.flat_objects(bodies, "body", ["page_id"]).filter(text.is_product(F.col("name")))
    return settled(found, final_price=money.rupiah(F.col("price_text"))).filter("final_price > 0").select("page_id", "pos", F.col("name").alias("original_name"), "final_price")


QUERIES |= {"assigned_documents": assigned_documents, "page_values": page_values, "fragment_offers": fragment_offers, "flat_offers": flat_offers}
ORACLES |= {
    "assigned_documents": f"WITH {STATES} SELECT page_id, '__INITIAL_STATE__' AS variable, CAST({len(HEAD)} AS BIGINT) AS start, CAST({len(HEAD)} + length(document) AS BIGINT) AS \"end\", document FROM states",
    "page_values": f"""WITH {STATES} SELECT 'raw' AS kind, page_id, CAST(instr(html, '{{') - 1 AS BIGINT) AS start, CAST(instr(html, '}}') AS BIGINT) AS "end", substr(html, instr(html, '{{'), instr(html, '}}') - instr(html, '{{') + 1) AS document FROM pages WHERE html LIKE '%{{%'
 UNION ALL SELECT 'state', page_id, {len(HEAD)}, {len(HEAD)} + length(document), document FROM states UNION ALL SELECT 'state', page_id, {len(HEAD)} + length(document) + {TAIL.index('{')}, {len(HEAD)} + length(document) + {TAIL.index('{')} + 2, '{{}}' FROM states""",
    "fragment_offers": f"WITH {ITEMS} SELECT DISTINCT page_id, name AS original_name, price AS final_price FROM items WHERE (k % 3 = 1 OR (k % 3 = 2 AND pk % 2 = 0)) AND price >= 100",
    "flat_offers": f"WITH {ITEMS} SELECT page_id, k AS pos, name AS original_name, price AS final_price FROM items WHERE k % 3 > 0 AND price > 0",
}


def run_pages(spark, sf) -> DataFrame:
    """Pages of one running text: named fields, and prices of several kinds at changing distances, before the next name or not at all."""
    k, gap = F.col("k") % 4, lambda n, most: F.expr(f"repeat('~', cast(1 + {n} % {most} as int))")
    price = F.when(k == 0, F.concat(F.lit("Rp "), dotted(F.col("price")))).when(k == 1, F.concat(F.lit('price: "'), _s("price"), F.lit('"'))).when(k == 3, F.concat(F.lit("IDR "), _s("price"))).otherwise("")
    return _joined(items(spark, sf), F.concat(F.lit('name: "'), "name", F.lit('"'), gap("pk", 300), price, gap("sk", 250)))


RUNS = f"""{ITEMS}, bits AS (SELECT *, 'name: "' || name || '"' AS field, CASE k % 4 WHEN 0 THEN 'Rp ' || {DOTTED} WHEN 1 THEN 'price: "' || price || '"' WHEN 3 THEN 'IDR ' || price ELSE '' END AS bit FROM items),
 laid AS (SELECT *, sum(length(field) + 2 + pk % 300 + length(bit) + sk % 250) OVER (PARTITION BY page_id ORDER BY k) - (length(field) + 2 + pk % 300 + length(bit) + sk % 250) AS a FROM bits),
 named AS (SELECT page_id, k, name, a, a + length(field) AS b FROM laid), priced AS (SELECT page_id, price, CASE k % 4 WHEN 1 THEN 2 ELSE 3 END AS confidence, a + length(field) + 1 + pk % 300 AS p, a + length(field) + 1 + pk % 300 + length(bit) AS q FROM laid WHERE bit <> '' AND price > 0)"""


def serialized_offers(spark, sf):
    """Names with the best price on either side."""
    run = run_pages(spark, sf).withColumn("text", serialized.serialized(F.col("text")))
    names = serialized.found_at(run, "text", ["page_id"], [(1, serialized.NAME_FIELD)])
    return serialized.nearest(names, serialized.prices_at(run, "text", ["page_id"]), ["page_id"]).select("page_id", "start", "original_name", "final_price", "confidence")


def forward_offers(spark, sf):
    """Names with the first price behind them, one with its currency before any other."""
    run = run_pages(spark, sf)
    behind = F.col("start") + F.char_length("found")
    names = serialized.found_at(run, "text", ["page_id"], [(1, serialized.NAME_FIELD)]).withColumns({"start": behind, "end": behind})
    return serialized.nearest(names, serialized.prices_at(run, "text", ["page_id"]), ["page_id"], 0, serialized.FORWARD, by_distance=False).select("page_id", "start", "original_name", "final_price", "confidence")


def number_words(spark, sf):
    """Numbers in documents with the nearest word, one with a capital before any other; a word's price is its length."""
    docs = table(spark, sf, "documents")
    numbers = serialized.found_at(docs, "text", ["doc_id"], [(1, r"(?<![^ \t\n\r])[0-9]+(?![^ \t\n\r])")])
    words = serialized.found_at(docs, "text", ["doc_id"], [(3, r"(?<![^ \t\n\r])[A-Z][a-z]*(?![^ \t\n\r])"), (2, r"(?<![^ \t\n\r])[a-z]+(?![^ \t\n\r])")])
    rated = words.withColumnRenamed("kind", "confidence").withColumn("price", F.char_length("found").cast("bigint"))
    return serialized.nearest(numbers, rated, ["doc_id"]).select("doc_id", "start", "original_name", "final_price", "confidence", "price_start")


_BEST = lambda condition, order, keep: f"SELECT {keep} FROM (SELECT n.*, p.price, p.confidence, p.p, row_number() OVER (PARTITION BY n.page_id, n.k ORDER BY p.confidence DESC, {order}, p.p) AS best FROM named n JOIN priced p ON n.page_id = p.page_id AND {condition}) WHERE best = 1"
QUERIES |= {"serialized_offers": serialized_offers, "forward_offers": forward_offers, "number_words": number_words}
ORACLES |= {
    "serialized_offers": f"WITH {RUNS} " + _BEST("p.p >= n.a - 220 AND p.q <= n.b + 420", "abs(2 * p.p - n.a - n.b)", "page_id, CAST(a AS BIGINT) AS start, name AS original_name, price AS final_price, CAST(confidence AS INT) AS confidence"),
    "forward_offers": f"WITH {RUNS} " + _BEST("p.p >= n.a + length(n.name) AND p.q <= n.a + length(n.name) + 650", "p.p", "page_id, CAST(a + length(name) AS BIGINT) AS start, name AS original_name, price AS final_price, CAST(confidence AS INT) AS confidence"),
    "number_words": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+'), 1) AS i FROM documents),
 laid AS MATERIALIZED (SELECT *, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS BIGINT) AS a FROM t),
 n AS (SELECT doc_id, w, a, a + length(w) AS b FROM laid WHERE regexp_full_match(w, '[0-9]+')), p AS (SELECT doc_id, a AS p, a + length(w) AS q, CAST(length(w) AS BIGINT) AS price, CASE WHEN w[1:1] BETWEEN 'A' AND 'Z' THEN 3 ELSE 2 END AS c FROM laid WHERE regexp_full_match(w, '[A-Za-z][a-z]*'))
 SELECT doc_id, a AS start, w AS original_name, price AS final_price, CAST(c AS INT) AS confidence, p AS price_start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, a ORDER BY c DESC, abs(2 * p - a - b), p) AS k FROM n JOIN p USING (doc_id) WHERE p >= a - 220 AND q <= b + 420) WHERE k = 1""",
}


def payload_docs(spark, sf) -> DataFrame:
    """Payloads of stores' interfaces: rows at the root, at a known place, or somewhere among other arrays."""
    row = F.when(F.col("k") % 2 == 0, F.concat(F.lit('{"name":"'), "name", F.lit('","price":'), _s("price"), F.lit("}"))).otherwise(F.concat(F.lit('{"title":" '), "name", F.lit(' ","selling_price":"Rp '), dotted(F.col("price")), F.lit('"}')))
    # Fixed values of the mapping: what stands around the rows, by page.
    around = [("[", "]"), ('{"data":{"products":[', "]}}"), ('{"a":{"list":[{"id":1},{"id":2,"name":""}]},"z":[', "]}"), ('{"meta":{"names":["x"]},"shelf":{"rows":[', ']},"side":{"rows":[{"name":"n"}]}}')]
    kind = F.col("page_id") % 4
    whole = F.concat(*(F.element_at(F.array(*(F.lit(a[j]) for a in around)), (kind + 1).cast("int")) if j < 2 else F.col("text") for j in (0, 2, 1)))
    return _joined(items(spark, sf), row, ",").select("page_id", F.parse_json(whole).alias("v"))


def payload_offers(spark, sf):
    return payloads.payload_offers(payload_docs(spark, sf), "page_id")


def best_arrays(spark, sf):
    found = payloads.best_arrays(payload_docs(spark, sf), "page_id")
    return found.select("page_id", "score", F.array_join(F.transform("path", lambda k: k.cast("string")), ".").alias("path"), F.size(F.try_variant_get("v", "$", "array<variant>")).alias("rows"))


QUERIES |= {"payload_offers": payload_offers, "best_arrays": best_arrays}
ORACLES |= {
    "payload_offers": f"WITH {ITEMS} SELECT page_id, k - 1 AS pos, name AS original_name, price AS final_price FROM items WHERE price > 0",
    "best_arrays": f"WITH {ITEMS} SELECT page_id, CAST(6 * least(8, count(*)) AS INT) AS score, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '0.0' WHEN 2 THEN '1' ELSE '1.0' END AS path, CAST(count(*) AS INT) AS rows FROM items GROUP BY page_id",
}


def page_crawl(spark, sf):
    """From every page along its links, best first, up to 12 pages or a short page; a link's text decides its score, its address the page it leads to."""
    from offerloom.functions.urls import links

    found = table(spark, sf, "pages")
    size = found.agg((F.max("page_id") + 1).alias("n"))
    target = F.conv(F.substring(F.md5("href"), 1, 8), 16, 10).cast("bigint") % F.col("n")
    edges = links(found).join(F.broadcast(size)).select(F.col("page_id").alias("page"), target.alias("target"), (10 * F.char_length("text")).alias("score"), "pos")
    starts = found.select(F.col("page_id").alias("start"), F.array("page_id").alias("seeds"))
    goals = found.filter(F.char_length("html") < 1400).select(F.col("page_id").alias("page"))
    return crawl.crawl(starts, crawl.best_links(edges), goals).select("start", "step", "page")


def bind(links_sql: str) -> None:
    """SQL that starts from the links of the catalogue's own SQL."""
    ORACLES["page_crawl"] = f"""WITH RECURSIVE e AS (SELECT page_id AS page, CAST('0x' || substr(md5(href), 1, 8) AS BIGINT) % (SELECT max(page_id) + 1 FROM pages) AS target, 10 * length(text) AS score, pos FROM ({links_sql})),
 one AS (SELECT * FROM e WHERE score >= 20 QUALIFY row_number() OVER (PARTITION BY page, target ORDER BY score DESC, pos) = 1),
 best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) <= 6), nexts AS (SELECT page, list(target ORDER BY score DESC, pos) AS next FROM best GROUP BY page),
 walk AS (SELECT page_id AS start, [page_id] AS queue, CAST([] AS BIGINT[]) AS seen FROM pages
 UNION ALL SELECT start, CASE WHEN (SELECT length(html) < 1400 FROM pages WHERE page_id = queue[1]) THEN [] ELSE list_concat(list_filter(coalesce(next, []), lambda x: NOT list_contains(queue, x) AND NOT list_contains(seen, x)), queue[2:]) END, list_append(seen, queue[1]) FROM walk LEFT JOIN nexts ON page = queue[1] WHERE len(queue) > 0 AND len(seen) < 12),
 last AS (SELECT start, arg_max(seen, len(seen)) AS seen FROM walk GROUP BY start)
 SELECT start, CAST(i - 1 AS INT) AS step, seen[i] AS page FROM (SELECT start, seen, unnest(range(1, len(seen) + 1)) AS i FROM last)"""


QUERIES["page_crawl"] = page_crawl
