"""Queries of whole page scans over the orders as pages, and over the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import pages, text
from offerloom.functions.names import dotted
from offerloom.operators import probes, resolve, scan
from offerloom.plans.shop import ITEMS, _parts, items
from offerloom.sources.tables import kept, table

QUERIES, ORACLES = {}, {}


def mixed_pages(spark, sf):
    """Orders as pages that say items in three ways: all but every third as lines, every third in a script, and every second item once more in a document."""
    price = dotted(F.col("price"))
    rows = items(spark, sf)
    line = F.when(F.col("k") % 3 > 0, F.concat(F.lit("<p>"), "name", F.lit("</p><p>Rp "), price, F.lit("</p>"))).otherwise("")
    script = F.when(F.col("k") % 3 == 0, F.concat(F.lit('push({"name":"'), "name", F.lit('","price":"'), F.col("price").cast("string"), F.lit('"});'))).otherwise("")
    doc = F.when(F.col("k") % 2 == 0, F.concat(F.lit(',{"name":"'), F.upper("name"), F.lit('","list":{"x":1},"price":'), F.col("price").cast("string"), F.lit("}"))).otherwise("")
    return _parts(rows, {"a": line, "b": script, "c": doc}).select("page_id", F.concat(F.lit("<html>"), "a", F.lit("<script>"), "b", F.lit('</script><script type="application/json">[0'), "c", F.lit("]</script></html>")).alias("html"))


_WAYS = f"""{ITEMS}, ways AS (SELECT page_id, name, price, CASE WHEN k % 3 > 0 THEN 0 ELSE 1 END AS no, k, name AS shown FROM items UNION ALL SELECT page_id, name, price, 2, k, upper(name) FROM items WHERE k % 2 = 0)"""


def scanned_offers(spark, sf):
    """Offers of all extractors, the first of equal ones."""
    return scan.scanned(mixed_pages(spark, sf)).select("page_id", "extractor", "original_name", "final_price")


def strategy_offers(spark, sf):
    """Offers by the stores' own strategies: of suppliers by number, scripts then lines, an unknown one then documents, or none."""
    rows = mixed_pages(spark, sf).withColumn("store_id", F.col("page_id") % 50)
    stores = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("store_id"))
    listed = F.when(F.col("store_id") % 2 == 0, F.array(F.lit("scripts"), F.lit("lines"))).otherwise(F.array(F.lit("voodoo"), F.lit("documents")))
    strategies = stores.select("store_id", F.posexplode(listed).alias("stage", "strategy"))
    return scan.by_strategy(rows, strategies).select("page_id", "stage", "extractor", "original_name", "final_price")


def varied_pages(spark, sf):
    """Orders as pages that fail in different ways."""
    price = F.concat(F.lit("<p>Rp "), dotted(F.col("price")), F.lit("</p>"))
    both = _parts(items(spark, sf), {"text": F.concat(F.lit("<p>"), "name", F.lit("</p>"), F.when(F.col("page_id") % 6 == 0, price).otherwise("")), "prices": price})
    v = F.col("page_id") % 6
    html = F.when(v < 2, F.col("text")).when(v == 2, F.col("prices")).when(v == 3, '<div id="__next"></div><script src="/_next/x.js"></script>').when(v == 4, '<script type="application/json">{"about":1}</script><p>hi</p>').otherwise("<p>hello</p>")
    return both.select("page_id", html.alias("html"))


def page_reasons(spark, sf):
    """Why pages of orders, and the raw pages, gave no offers of Diamonds; counted on the pages."""
    raw = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html")
    return scan.diagnosed(varied_pages(spark, sf).union(raw), F.contains("original_name", F.lit("Diamond"))).withColumn("documents", F.col("documents").cast("int"))


def dynamic_pages(spark, sf):
    """Signs of pages filled in by scripts: of every part's page in one of six forms, and of the raw pages."""
    forms = ['<div id="__next"></div><script src="/_next/x.js"></script>', "<div id=\"app\"> </div> fetch('/api/v1/items') fetch(\"/graphql\") fetch('/api/v1/items')", "window.__NUXT__ = {}", "window.__NUXT__ = {sellingPrice: 5}", "plain price `/api/abc`", ""]
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.array(*map(F.lit, forms))[(F.col("p_partkey") % 6).cast("int")], F.lit(" "), "p_name").alias("html"))
    both = own.union(table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html"))
    s = both.select("page_id", pages.dynamic_signals(F.col("html")).alias("s"))
    return s.select("page_id", F.array_join("s.frameworks", "|").alias("frameworks"), F.array_join("s.api_hints", "|").alias("hints"), "s.empty_shell", "s.product_words", "s.likely_dynamic")


QUERIES |= {"scanned_offers": scanned_offers, "strategy_offers": strategy_offers, "page_reasons": page_reasons, "dynamic_pages": dynamic_pages}
ORACLES |= {
    "scanned_offers": f"WITH {_WAYS} SELECT page_id, ['lines', 'scripts', 'documents'][1 + no] AS extractor, shown AS original_name, price AS final_price FROM ways WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY page_id, name, price ORDER BY no, k) = 1 AND row_number() OVER (PARTITION BY page_id ORDER BY no, k) <= 200",
    "strategy_offers": f"""WITH {_WAYS}, s AS (SELECT *, page_id % 50 AS store FROM ways WHERE page_id % 50 < 25 AND price > 0), t AS (SELECT *, CASE WHEN store % 2 = 0 THEN CASE no WHEN 1 THEN 0 WHEN 0 THEN 1 END ELSE CASE no WHEN 2 THEN 1 END END AS stage FROM s),
 f AS (SELECT page_id, min(stage) AS stage FROM t WHERE stage IS NOT NULL GROUP BY page_id) SELECT page_id, CAST(stage AS INT) AS stage, ['lines', 'scripts', 'documents'][1 + no] AS extractor, shown AS original_name, price AS final_price FROM t JOIN f USING (page_id, stage) QUALIFY no > 0 OR row_number() OVER (PARTITION BY page_id, name, price ORDER BY k) = 1""",
    "page_reasons": f"""WITH {ITEMS}, c AS (SELECT page_id, page_id % 6 AS v, count(*) AS n, count(DISTINCT (name, price)) AS d, count(DISTINCT (name, price)) FILTER (name LIKE '%Diamond%') AS kept FROM items GROUP BY page_id)
 SELECT page_id, CASE WHEN v < 2 THEN n ELSE 0 END AS products, CASE WHEN v IN (0, 2) THEN n ELSE 0 END AS prices, CASE WHEN v = 4 THEN 1 ELSE 0 END AS documents, CASE WHEN v = 0 THEN d ELSE 0 END AS found, CASE WHEN v = 0 THEN kept ELSE 0 END AS kept, CASE v WHEN 0 THEN CASE WHEN kept = 0 THEN 'PRODUCTS_REJECTED_BY_GAME_VALIDATION' ELSE 'PARTIAL_MATCH_ONLY' END WHEN 1 THEN 'PRODUCT_FOUND_NO_PRICE' WHEN 2 THEN 'PRICE_FOUND_NO_PRODUCT' WHEN 3 THEN 'JS_RENDERED_CONTENT' WHEN 4 THEN 'JSON_DATA_FOUND_NO_MATCH' ELSE 'HTML_NO_PRODUCT' END AS reason FROM c
 UNION ALL SELECT -1 - page_id, 0, 0, 0, 0, 0, 'HTML_NO_PRODUCT' FROM pages""",
    "dynamic_pages": """SELECT p_partkey AS page_id, ['nextjs', 'spa-root', 'nuxt', 'nuxt', '', ''][1 + p_partkey % 6] AS frameworks, CASE p_partkey % 6 WHEN 1 THEN '/api/v1/items|/graphql' WHEN 4 THEN '/api/abc' ELSE '' END AS hints, p_partkey % 6 < 2 AS empty_shell, p_partkey % 6 IN (3, 4) AS product_words, p_partkey % 6 IN (0, 1, 3) AS likely_dynamic FROM part
 UNION ALL SELECT -1 - page_id, '', '', false, regexp_matches(html, '(?i)product|denomination|selling_?price|final_?price|price'), false FROM pages""",
}


# Probes and resolving over whole tables ---------------------------------------

# Fixed values of the mapping: the phase that an event stands for.
PHASE_OF = {"view": "direct", "click": "discovered", "purchase": "sitemap", "signup": "guessed", "error": "guessed"}


def probe_budget(spark, sf):
    """Events as candidates of their users: phases by type, seven addresses, every ninth a success or an end."""
    phase = F.create_map(*[F.lit(x) for pair in PHASE_OF.items() for x in pair])[F.col("event_type")]
    outcome = F.when(F.col("event_id") % 9 == 0, "success").when(F.col("event_id") % 9 == 1, "terminal").otherwise("continue")
    rows = table(spark, sf, "events").select("user_id", phase.alias("phase"), F.col("event_id").alias("pos"), F.concat(F.lit("u"), (F.floor("value") % 7).cast("string")).alias("url"), outcome.alias("outcome"))
    return probes.probed(rows, "user_id")


def title_resolution(spark, sf):
    """First three words of every document, resolved against all names of parts and the first two words of all documents."""
    words = F.split(text.normalized(F.substring("text", 1, 400)), " ")
    docs = kept(table(spark, sf, "documents").filter("text <> ''").select("doc_id", F.slice(words, 1, 3).alias("words")))  # read and normalised once
    queries = docs.select(F.array_join("words", " ").alias("query")).distinct()
    named = table(spark, sf, "part").groupBy(F.col("p_name").alias("entry")).agg(F.min("p_partkey").alias("registry_order")).withColumn("phrase", text.normalized(F.col("entry")))
    said = docs.select(F.array_join(F.slice("words", 1, 2), " ").alias("entry"), (1_000_000_000 + F.col("doc_id")).alias("registry_order")).groupBy("entry").agg(F.min("registry_order").alias("registry_order")).withColumn("phrase", F.col("entry"))
    return resolve.resolve(queries, named.unionByName(said)).select("query", "entry", "score")


_WORDS = "string_split(trim(regexp_replace(array_to_string(list_transform(string_split(lower(left(text, 400)), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), ''), '[^a-z0-9]+', ' ', 'g')), ' ')"
QUERIES |= {"probe_budget": probe_budget, "title_resolution": title_resolution}
ORACLES |= {
    # Every candidate in its order, one after the other, with what was spent, tried and ended so far.
    "probe_budget": """WITH RECURSIVE c AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS p, event_id AS pos, 'u' || CAST(floor(value) AS BIGINT) % 7 AS url, CASE event_id % 9 WHEN 0 THEN 'success' WHEN 1 THEN 'terminal' ELSE 'continue' END AS outcome FROM events),
 s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, pos) AS n FROM c),
 w AS (SELECT user_id, 0::BIGINT AS n, -1 AS p, 0 AS used, 0 AS spent, CAST([] AS VARCHAR[]) AS seen, false AS over, false AS hit, 0::BIGINT AS pos, '' AS url, '' AS outcome FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, n, p, used + hit::INT, CASE WHEN p = was THEN spent ELSE 0 END + hit::INT, CASE WHEN hit THEN list_append(seen, url) ELSE seen END, over OR (hit AND outcome <> 'continue'), hit, pos, url, outcome FROM (SELECT w.user_id, s.n, s.p, w.p AS was, used, spent, seen, over, s.pos, s.url, s.outcome,
  NOT over AND used < 3 AND CASE WHEN s.p = w.p THEN spent ELSE 0 END < CASE WHEN s.p = 0 THEN 3 ELSE 1 END AND NOT list_contains(seen, s.url) AS hit FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1))
 SELECT user_id, used AS attempt, ['direct', 'discovered', 'sitemap', 'guessed'][1 + p] AS phase, pos, url, outcome FROM w WHERE hit""",
    "title_resolution": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''), q AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS query FROM d),
 r AS (SELECT p_name AS entry, min(p_partkey) AS o, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM part GROUP BY p_name UNION ALL SELECT entry, min(o), entry FROM (SELECT array_to_string(w[1:2], ' ') AS entry, 1000000000 + doc_id AS o FROM d) GROUP BY entry),
 s AS (SELECT query, entry, o, round(greatest(CASE WHEN query = phrase THEN 100.0 WHEN starts_with(phrase, query) OR starts_with(query, phrase) THEN 82.0 WHEN contains(phrase, query) OR contains(query, phrase) THEN 68.0 ELSE 0.0 END::DOUBLE,
  len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(phrase, ' '))))::DOUBLE / greatest(len(list_distinct(string_split(query, ' '))), len(list_distinct(string_split(phrase, ' ')))) * 70.0), 6) AS score FROM q, r WHERE query <> '')
 SELECT query, arg_max(entry, ROW(score, -o)) AS entry, max(score) AS score FROM s GROUP BY query HAVING max(score) >= 45""",
}
