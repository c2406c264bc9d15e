"""Queries of single rules over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerloom.functions import pages
from offerloom.operators import offers
from offerloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def page_signals(spark, sf):
    """Titles, headings and scripts of pages."""
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.array_join(pages.tag_texts(html, "title"), " | ").alias("title"), F.array_join(pages.tag_texts(html, "h1", "h2"), " | ").alias("headings"), F.size(pages.scripts(html)).cast("bigint").alias("scripts"), F.array_join(F.transform(pages.scripts(html), lambda s: s["body"]), "\n").alias("code"))


def _plain(sql: str) -> str:
    """DuckDB: text between tags with entities decoded, as far as the tables hold any."""
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        sql = f"regexp_replace({sql}, '(?i)&{name};', '{value}', 'g')"
    return sql


_TEXTS = lambda tags: f"array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:{tags})\\b[^>]*>(.*?)</(?:{tags})>', 1), lambda x: trim(regexp_replace({_plain(chr(114) + 'egexp_replace(x, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\\s+', ' ', 'g'))), lambda x: x <> ''), ' | ')"
QUERIES["page_signals"] = page_signals
ORACLES["page_signals"] = f"SELECT page_id, {_TEXTS('title')} AS title, {_TEXTS('h1|h2')} AS headings, CAST(len(regexp_extract_all(html, '(?is)<script\\b[^>]*>.*?</script>')) AS BIGINT) AS scripts, array_to_string(list_transform(regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script>', 1), lambda x: trim(x)), chr(10)) AS code FROM pages"


def token_lines(spark, sf):
    own = table(spark, sf, "pages").select("page_id", pages.token_lines(F.col("html")).alias("l"))
    return own.select("page_id", F.size("l").cast("bigint").alias("lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


_BARE = "html"
for _tag in ("script", "style", "noscript", "svg"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
QUERIES["token_lines"] = token_lines
ORACLES["token_lines"] = f"SELECT page_id, CAST(len(l) AS BIGINT) AS lines, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT page_id, list_filter(list_transform(regexp_split_to_array({_plain('regexp_replace(' + _BARE + ', ' + chr(39) + '<[^>]+>' + chr(39) + ', chr(10), ' + chr(39) + 'g' + chr(39) + ')')}, '\\r?\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM pages)"


def phrase_counts(spark, sf):
    """How often documents of all languages say `the`."""
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", pages.phrase_count(F.col("text"), F.lit("The")).cast("bigint").alias("n"))


QUERIES["phrase_counts"] = phrase_counts
_SPLIT = "array_to_string(list_transform(string_split(lower(coalesce(text, '')), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || ' ' ELSE c END), '')"
ORACLES["phrase_counts"] = f"SELECT doc_id, CAST(len(regexp_extract_all(' ' || trim(regexp_replace({_SPLIT}, '[^a-z0-9]+', ' ', 'g')) || ' ', ' the ')) AS BIGINT) AS n FROM documents"


def _items(spark, sf):
    from offerloom.plans.catalogue import _offers

    return _offers(spark, sf)


def strict_dedupe(spark, sf):
    rows = _items(spark, sf).select("game_id", "store_id", "original_name", "final_price", "arrival_seq")
    return offers.first_strict(rows, ["game_id"]).select("game_id", "final_price", "original_name", "store_id")


def store_filter(spark, sf):
    """Metrics of the packages that a user sees who chose some stores and one type of package."""
    stores = table(spark, sf, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("store_id"))  # what a user ticked
    seen = offers.visible_groups(_items(spark, sf), stores, ["currency"])
    return seen.select("game_id", "canonical_key", "cheapest_price", "store_count", "offer_count")


def search_totals(spark, sf):
    rows = _items(spark, sf)
    return offers.totals(rows, offers.group_offers(rows), 8)


def capped_offers(spark, sf):
    """At most 15 offers of a store, in order of arrival."""
    return offers.capped(_items(spark, sf), ["store_id"], ["arrival_seq"], 15).select("store_id", "original_name", "final_price")


def top_links(spark, sf):
    """The four best of each page's links that reach the score of a discovered address."""
    from offerloom.plans.catalogue import QUERIES as known

    best = Window.partitionBy("page_id").orderBy(F.col("score").desc(), "pos")
    return known["link_scores"](spark, sf).withColumn("place", F.row_number().over(best)).filter("place <= 4")


QUERIES |= {"strict_dedupe": strict_dedupe, "store_filter": store_filter, "search_totals": search_totals, "capped_offers": capped_offers, "top_links": top_links}


def bind(offers_cte: str, groups_cte: str, merged_scores: str) -> None:
    """SQL that starts from what the catalogue's own SQL calls offers, groups and link scores."""
    ORACLES["strict_dedupe"] = rf"WITH {offers_cte}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id, trim(regexp_replace(lower(original_name), '[^a-z0-9]+', ' ', 'g')), final_price ORDER BY arrival_seq) AS k FROM offers WHERE original_name <> '' AND final_price >= 100) SELECT game_id, final_price, original_name, store_id FROM r WHERE k = 1"
    ORACLES["store_filter"] = f"WITH {groups_cte.replace('FROM offers WHERE final_price > 0', 'FROM offers WHERE final_price > 0 AND store_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)')} SELECT game_id, canonical_key, cheapest_price, store_count, offer_count FROM groups WHERE package_type = 'currency'"
    ORACLES["search_totals"] = f"WITH {groups_cte} SELECT (SELECT count(*) FROM offers WHERE source = 'live') AS live_offer_count, (SELECT count(*) FROM offers) AS offer_count, (SELECT count(DISTINCT store_id) FROM offers) AS store_count, (SELECT count(*) FROM groups) AS package_count, CAST(8 AS BIGINT) AS checked_store_count"
    ORACLES["capped_offers"] = f"WITH {offers_cte} SELECT store_id, original_name, final_price FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY arrival_seq) AS k FROM offers) WHERE k <= 15"
    ORACLES["top_links"] = f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS INT) AS place FROM ({merged_scores})) WHERE place <= 4"
