"""Queries of the offer operators over the tables of a folder, with the SQL that checks them.

The tables hold no offers, so each query maps what is there: line items become
offers, events become attempts or lines, pages stay pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import money, names, status, text, urls
from offerloom.operators import attempts, lines, offers, resolve
from offerloom.plans import forms, rules, scans, searches, shop
from offerloom.sources.tables import feed_offers, table
from offerloom.streaming.merge import merged

# Fixed values of the mapping: what is counted for each kind of part.
UNIT_OF = {"SMALL": "Diamonds", "MEDIUM": "UC", "LARGE": "Genesis Crystals", "ECONOMY": "Tokens", "STANDARD": "Weekly Diamond Pass", "PROMO": "Promo Box"}
SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
STORES = [("codashop", 0.98), ("unipin", 1.0), ("lapakgaming", 0.97), ("duniagames", 1.01)]


def _offers(spark, sf):
    item, part, supplier = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    joined = item.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    unit = F.create_map(*[F.lit(x) for pair in UNIT_OF.items() for x in pair])[F.col("p_type")]
    return joined.select(
        F.col("p_brand").alias("game_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("s_name").alias("store_name"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" "), unit).alias("original_name"),
        F.floor(F.col("l_extendedprice") + 0.5).cast("bigint").alias("final_price"),
        F.when(F.col("l_linestatus") == "O", "live").otherwise("fallback").alias("source"),
        F.struct(*SEQ).alias("arrival_seq"),
    )


_UNIT_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNIT_OF.items()) + " END"
_OFFERS = f"""offers AS (SELECT p_brand AS game_id, l_suppkey AS store_id, s_name AS store_name, CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ' || {_UNIT_CASE} AS original_name,
  CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS final_price, CASE WHEN l_linestatus = 'O' THEN 'live' ELSE 'fallback' END AS source, ROW({", ".join(SEQ)}) AS arrival_seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _ladder(column, rows, value, default):
    cases = " ".join(f"WHEN regexp_matches({column}, '{r[1]}') THEN '{r[value]}'" for r in rows)
    return f"CASE {cases} ELSE {default} END"


def _canon(source):
    """CTEs a (parts of names) and c (canonical columns) of a table with original_name."""
    number = lambda p, k: f"try_cast(replace(regexp_extract(dotted, '{p}', {k}), '.', '') AS BIGINT)"
    base = ", ".join(number(p, 1) for p in [*names.TWO_AMOUNTS, names.ONE_AMOUNT])
    bonus = ", ".join(number(p, 2) for p in names.TWO_AMOUNTS)
    return rf"""
a0 AS (SELECT *, trim(coalesce(original_name, '')) AS nm, lower(trim(coalesce(original_name, ''))) AS low, lower(replace(trim(coalesce(original_name, '')), ',', '.')) AS dotted FROM {source}),
a1 AS (SELECT *, {_ladder("low", names.SPECIAL_TYPES, 0, "NULL")} AS special, {_ladder("low", names.SPECIAL_TYPES, 2, "NULL")} AS label, {_ladder("low", names.UNITS, 0, "'Item'")} AS unit,
  greatest(1, coalesce(try_cast(regexp_extract(nm, '(?i)[x×]\s*(\d+)', 1) AS BIGINT), 1)) AS multiplier, coalesce({base}) AS base_amount, coalesce({bonus}) AS bonus0 FROM a0),
a2 AS (SELECT *, coalesce(bonus0, CASE WHEN base_amount IS NOT NULL THEN 0 END) AS bonus_amount FROM a1),
a AS (SELECT *, base_amount + bonus_amount AS total_amount FROM a2),
c AS (SELECT *, CASE WHEN special IS NOT NULL THEN special WHEN total_amount > 0 THEN 'currency' ELSE 'other' END AS package_type,
  CASE WHEN special IS NOT NULL THEN label || CASE WHEN multiplier > 1 THEN ' x' || multiplier ELSE '' END WHEN total_amount > 0 THEN replace(format('{{:,}}', total_amount), ',', '.') || ' ' || unit ELSE nm END AS canonical_name,
  CASE WHEN special IS NOT NULL THEN special || ':' || multiplier WHEN total_amount > 0 THEN 'currency:' || lower(unit) || ':' || total_amount ELSE 'other:' || {_norm("nm")} END AS canonical_key,
  CASE WHEN regexp_matches(low, '{names.CONDITIONAL}') THEN 'conditional' ELSE 'all-users' END AS eligibility FROM a)"""


def _norm(column, gap=" "):
    inner = f"regexp_replace(lower(coalesce({column}, '')), '([{text.ACCENTED}])', '\\1{gap}', 'g')"
    return f"trim(regexp_replace(translate({inner}, '{text.ACCENTED}', '{text.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


_GROUPS = f"""{_OFFERS}, {_canon("(SELECT * FROM offers WHERE final_price > 0)")},
g AS (SELECT game_id, canonical_key, arg_min(canonical_name, arrival_seq) AS name, arg_min(package_type, arrival_seq) AS package_type, arg_min(unit, arrival_seq) AS unit, arg_min(coalesce(total_amount, -1), arrival_seq) AS total0,
  min(final_price) AS cheapest_price, arg_min(store_name, ROW(final_price, store_name, arrival_seq)) AS cheapest_store, max(final_price) AS highest_price, max(final_price) - min(final_price) AS savings,
  count(DISTINCT store_id) AS store_count, count(*) AS offer_count, bool_or(source = 'live') AS has_live_price FROM c GROUP BY ALL),
groups AS (SELECT * EXCLUDE (total0), nullif(total0, -1) AS total_amount FROM g)"""

#: Names that show every rule of canonical names.
CASES = [
    "85 Diamonds (77 + 8 Bonus)",
    "77 Diamonds + 8 Bonus",
    "Weekly Diamond Pass",
    "Weekly Diamond Pass x2",
    "Weekly Diamond Pass 2x",
    "300 + 30 Genesis Crystals",
    "1,000 UC",
    "1.5 UC",
    "80 Call of Duty Points",
    "Starlight Member Plus",
    "Special Data",
    "5 UCxyz",
    "First Top Up 12 Tokens",
    "Gift Box Max 5",
    "Pokémon Café",
    "inter-knot membership × 3",
    "  ",
]


def _case_names(spark):
    return spark.createDataFrame([(c,) for c in CASES], "original_name string")


_CASES = "v(original_name) AS (VALUES " + ", ".join(f"('{c}')" for c in CASES) + ")"


def group_offers(spark, sf):
    return offers.group_offers(_offers(spark, sf))


def canonicalize_names(spark, sf):
    own = _offers(spark, sf).select("original_name").distinct().union(_case_names(spark))
    return offers.canonicalized(own)


def cheapest_offers(spark, sf):
    found = offers.cheapest_offers(_offers(spark, sf), 3)
    return found.select("game_id", "canonical_key", "rank", "store_id", "store_name", "original_name", "final_price")


def _ordered(by):
    def query(spark, sf):
        return offers.sorted_groups(offers.group_offers(_offers(spark, sf)), by)

    return query


_COLUMNS = "game_id, canonical_key, name, package_type, unit, total_amount, cheapest_price, cheapest_store, highest_price, savings, store_count, offer_count, has_live_price"
_ORDERS = {"price-asc": "", "amount-asc": "total_amount ASC NULLS LAST, ", "stores-desc": "store_count DESC, ", "savings-desc": "savings DESC, "}


def facet_counts(spark, sf):
    return offers.type_facets(offers.group_offers(_offers(spark, sf)))


def store_facet(spark, sf):
    return _offers(spark, sf).groupBy("store_id", "store_name").agg(F.count("*").alias("offers"), F.min("final_price").alias("from_price"))


def dedupe_first(spark, sf):
    return offers.first_of_each(_offers(spark, sf), ["game_id"]).select("game_id", "final_price", "original_name", "store_id", "source")


def fallback_union(spark, sf):
    """Stores with a negative balance stand for those whose live fetch failed."""
    rows = _offers(spark, sf)
    failed = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("store_id"))
    live = rows.filter("source = 'live'").join(failed, "store_id", "left_anti")
    catalog = rows.filter("source = 'fallback'")
    chosen = table(spark, sf, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("store_id"))
    return offers.with_fallback(live, catalog, chosen).groupBy("store_id", "source").agg(F.count("*").alias("offers"), F.sum("final_price").alias("total"))


def batch_merge(spark, sf):
    """Offers merged batch by batch give the groups of all of them."""
    rows = _offers(spark, sf)
    state = None
    for k in range(4):
        batch = rows.filter(F.col("arrival_seq.l_orderkey") % 4 == k)
        state = merged(batch.limit(0) if state is None else state, batch)
    return offers.group_offers(state)


_MERGED = f"""WITH {_GROUPS.replace("FROM offers WHERE final_price > 0", "FROM (SELECT DISTINCT ON (game_id, store_id, original_name, final_price) * FROM offers ORDER BY game_id, store_id, original_name, final_price, arrival_seq) WHERE final_price > 0")}
SELECT {_COLUMNS} FROM groups"""


def paging(spark, sf):
    return offers.page_of(table(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 16, 8)


def fallback_price(spark, sf):
    """Prices of a synthetic catalogue: four stores with a multiplier each, varied by place and name length."""
    stores = spark.createDataFrame(STORES, "store string, multiplier double")  # four rows
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    vary = 1.0 + ((F.col("p_partkey") + F.length("store")) % 5 - 2) * F.lit(0.006)
    price = F.floor(F.col("p_retailprice") * F.col("multiplier") * vary / 100.0 + 0.5).cast("bigint") * 100
    return part.crossJoin(F.broadcast(stores)).select("p_partkey", "store", F.greatest(F.lit(500), price).alias("price"))


def parse_rupiah(spark, sf):
    item = table(spark, sf, "lineitem")
    whole = F.floor(F.col("l_extendedprice")).cast("bigint")
    dotted = names.dotted(whole)
    forms = [F.concat(F.lit("Rp "), dotted), F.concat(F.lit("Rp . "), dotted, F.lit(",00")), F.concat(F.lit("IDR: "), F.format_number(whole, 0), F.lit(".50")), F.concat(dotted, F.lit(" Rupiah")), F.concat(whole.cast("string"), F.lit(".75")), F.concat(whole.cast("string"), F.lit(" Diamonds"))]
    text_of = F.array(*forms)[(F.col("l_orderkey") % 6).cast("int")]
    return item.select("l_orderkey", "l_linenumber", text_of.alias("shown")).distinct().withColumn("price", money.rupiah(F.col("shown")))


_RUPIAH = r"""
WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE l_orderkey % 6 WHEN 0 THEN 'Rp ' || d WHEN 1 THEN 'Rp . ' || d || ',00' WHEN 2 THEN 'IDR: ' || e || '.50' WHEN 3 THEN d || ' Rupiah' WHEN 4 THEN w || '.75' ELSE w || ' Diamonds' END AS shown
  FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS w, format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS e, replace(format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)), ',', '.') AS d FROM lineitem)),
t AS (SELECT *, lower(trim(shown)) AS x FROM f),
u AS (SELECT *, regexp_extract(x, '(?:(?:^|[^a-z0-9_])idr|(?:^|[^a-z0-9_])rp\s*\.?)\s*[:=\-]?\s*([0-9][0-9.,]*)', 1) AS b, regexp_extract(x, '([0-9][0-9.,]*)\s*(?:idr|rupiah)(?:$|[^a-z0-9_])', 1) AS s FROM t),
n AS (SELECT *, CASE WHEN b <> '' THEN b WHEN s <> '' THEN s WHEN regexp_matches(x, '^[0-9][0-9.,]*$') THEN x END AS tok FROM u)
SELECT l_orderkey, l_linenumber, shown, CASE WHEN tok IS NULL THEN NULL
  WHEN regexp_matches(tok, '^\d{1,3}(?:\.\d{3})+(?:,\d{2})?$') THEN try_cast(replace(regexp_replace(tok, ',\d{2}$', ''), '.', '') AS BIGINT)
  WHEN regexp_matches(tok, '^\d{1,3}(?:,\d{3})+(?:\.\d{2})?$') THEN try_cast(replace(regexp_replace(tok, '\.\d{2}$', ''), ',', '') AS BIGINT)
  WHEN regexp_matches(tok, '^\d+[.,]\d{2}$') THEN CAST(floor(CAST(replace(tok, ',', '.') AS DOUBLE) + 0.5) AS BIGINT)
  ELSE try_cast(regexp_replace(tok, '\D', '', 'g') AS BIGINT) END AS price FROM n"""


def _registry(spark, sf):
    part = table(spark, sf, "part")
    return part.groupBy(F.col("p_name").alias("entry")).agg(F.min("p_partkey").alias("registry_order")).withColumn("phrase", text.normalized(F.col("entry")))


def game_resolution(spark, sf):
    """Names typed in part, resolved against all distinct part names."""
    part = table(spark, sf, "part")
    typed = F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.lower("p_type"))
    queries = part.select(text.normalized(typed).alias("query")).distinct()
    return resolve.resolve(queries, _registry(spark, sf)).select("query", "entry", "score")


_RESOLVE = f"""
WITH q AS (SELECT DISTINCT {_norm("string_split(p_name, ' ')[-1] || ' ' || lower(p_type)")} AS query FROM part),
r AS (SELECT p_name AS entry, min(p_partkey) AS o, {_norm("p_name")} AS phrase FROM part GROUP BY p_name),
s AS (SELECT query, entry, o, round(greatest(CASE WHEN query = phrase THEN 100.0 WHEN starts_with(phrase, query) OR starts_with(query, phrase) THEN 82.0 WHEN contains(phrase, query) OR contains(query, phrase) THEN 68.0 ELSE 0.0 END::DOUBLE,
  len(list_intersect(list_distinct(string_split(query, ' ')), list_distinct(string_split(phrase, ' '))))::DOUBLE / greatest(len(list_distinct(string_split(query, ' '))), len(list_distinct(string_split(phrase, ' ')))) * 70.0), 6) AS score FROM q, r)
SELECT query, arg_max(entry, ROW(score, -o)) AS entry, max(score) AS score FROM s GROUP BY query HAVING max(score) >= 45"""


def autocomplete(spark, sf):
    return resolve.suggest(_registry(spark, sf), "Gi")


# Fixed values of the mapping: what an event stands for when it is read as an attempt.
CODE_OF = {"error": "PARSER_FAILED", "click": "ACCESS_BLOCKED", "view": "PAGE_NOT_FOUND", "signup": "TIMEOUT", "purchase": "RATE_LIMITED"}
_CODE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODE_OF.items()) + " END"
_PRIORITY_CASE = "CASE code " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in status.PRIORITY.items()) + " ELSE 0 END"


def _attempts(spark, sf):
    code = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])[F.col("event_type")]
    return table(spark, sf, "events").withColumn("code", code)


def provider_summary(spark, sf):
    """Outcomes by code of an HTTP status, with those worth a retry and the mean delay."""
    rows = table(spark, sf, "events").withColumn("http", F.array(*map(F.lit, (401, 404, 408, 410, 418, 429, 451, 500, 502, 504)))[(F.col("event_id") % 10).cast("int")])
    code = status.code_of_status(F.col("http"))
    again = status.is_retryable(code, F.col("http"))
    delay = status.retry_delay_ms(F.when(F.col("http") == 429, F.col("event_id") % 3), F.col("event_id") % 1000)
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("attempts"), F.count_if(again).alias("retryable"), F.sum(delay.cast("bigint")).alias("delay_ms"))


_SUMMARY = """
WITH e AS (SELECT event_id, [401, 404, 408, 410, 418, 429, 451, 500, 502, 504][event_id % 10 + 1] AS http FROM events),
c AS (SELECT *, CASE WHEN http IN (401, 403, 451) THEN 'ACCESS_BLOCKED' WHEN http IN (404, 410) THEN 'PAGE_NOT_FOUND' WHEN http IN (408, 504) THEN 'TIMEOUT' WHEN http = 429 THEN 'RATE_LIMITED' WHEN http >= 500 THEN 'UPSTREAM_ERROR' ELSE 'HTTP_ERROR' END AS code FROM e)
SELECT code, count(*) AS attempts, count(*) FILTER (code IN ('TIMEOUT', 'RATE_LIMITED') OR http IN (502, 503, 504)) AS retryable,
  CAST(sum(CASE WHEN http = 429 AND event_id % 3 > 0 THEN least(1500, event_id % 3 * 1000) ELSE greatest(150, least(750, CASE WHEN event_id % 1000 = 0 THEN 350 ELSE event_id % 1000 END)) END) AS BIGINT) AS delay_ms FROM c GROUP BY code"""


def error_priority(spark, sf):
    return attempts.strongest_error(_attempts(spark, sf), "user_id", "code", "event_id")


def strategy_chain(spark, sf):
    stops = status.stops_chain(F.lit("dedicated"), F.col("code"), F.lit(False), F.col("user_id") % 2 == 0)
    return attempts.cut_chain(_attempts(spark, sf), "user_id", ["ts", "event_id"], stops).select("user_id", "event_id", "code")


def candidate_fold(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 4).alias("r"), F.floor(F.col("value")).cast("bigint").alias("s"))
    best = attempts.fold_candidates(rows, "user_id", ["ts", "event_id"], "r", "s")
    return best.select("user_id", F.col("best.event_id").alias("event_id"), F.col("best.rank").alias("rank"), F.col("best.score").alias("score"))


_FOLD = """
WITH l AS (SELECT user_id, list({'e': event_id, 'r': event_id % 4, 's': CAST(floor(value) AS BIGINT)} ORDER BY ts, event_id) AS items FROM events GROUP BY user_id),
b AS (SELECT user_id, list_reduce(items, lambda a, x: CASE WHEN x.r > a.r OR x.s > a.s THEN x ELSE a END) AS best FROM l)
SELECT user_id, best.e AS event_id, best.r AS rank, best.s AS score FROM b"""


def nearest_following(spark, sf):
    rows = table(spark, sf, "events")
    price = F.when(F.col("event_type").isin("purchase", "error"), F.col("value"))
    found = lines.nearest_following(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "view", price, 4)
    return found.select("user_id", "event_id", "price")


_NEAREST = """
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events),
p AS (SELECT *, first_value(CASE WHEN event_type IN ('purchase', 'error') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS price FROM s)
SELECT user_id, event_id, price FROM p WHERE event_type = 'view' AND price IS NOT NULL"""


def json_props(spark, sf):
    """Numbers in the events' JSON, summed per user."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(k).alias("known"), F.sum(k).alias("total"), F.max(k).alias("most"))


def feed_products(spark, sf):
    """Offers read from JSON feeds, of which one is built for each supplier."""
    rows = table(spark, sf, "part").filter("p_partkey > 0")
    item = F.to_json(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("Rp "), F.floor("p_retailprice").cast("bigint").cast("string")).alias("price")))
    body = F.concat(F.lit('{"data":['), item, F.lit(',{"name":" ","price":"Rp 5"},{"title":"t","finalPrice":"0"}]}'))
    feeds = rows.select(F.col("p_partkey").alias("store_id"), F.col("p_brand").alias("game_id"), body.alias("payload"))
    return feed_offers(feeds).select("store_id", "game_id", "original_name", "final_price")


_DROP = "".join("regexp_replace(" for _ in text.DROPPED) + "html" + "".join(f", '(?is)<{t}(?:\\s[^>]*)?>.*?</{t}>', ' ', 'g')" for t in text.DROPPED)


def _decode(sql):
    for name, value in text.ENTITIES:
        sql = f"regexp_replace({sql}, '(?i)&{name};', '{value.replace(chr(39), chr(39) * 2)}', 'g')"
    return sql


_TAGLESS = f"regexp_replace(regexp_replace({_DROP}, '{text.BREAKS}', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
_LINES = rf"""l AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS pos, line FROM (SELECT page_id, k, trim(regexp_replace(x, '\s+', ' ', 'g')) AS line FROM
  (SELECT page_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS k FROM (SELECT page_id, regexp_split_to_array({_decode(_TAGLESS)}, '\r?\n') AS parts FROM pages))) WHERE line <> '')"""


def html_lines(spark, sf):
    return lines.page_lines(table(spark, sf, "pages"))


def html_entities(spark, sf):
    title = text.squeezed(text.decoded(F.regexp_extract("html", r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1)))
    return table(spark, sf, "pages").select("page_id", title.alias("title"))


def line_slice(spark, sf):
    return lines.slice_lines(lines.page_lines(table(spark, sf, "pages")), "^[A-M]", "&copy;")


def scoped_lines(spark, sf):
    return lines.in_scope(lines.page_lines(table(spark, sf, "pages")), "^(?:The|La|Le|Die)$", 8)


def page_links(spark, sf):
    return urls.links(table(spark, sf, "pages")).select("page_id", "pos", "href", "text")


def link_scores(spark, sf):
    found = urls.links(table(spark, sf, "pages"))
    name = text.normalized(F.regexp_extract(urls.host("url"), r"([^.]+)\.[^.]+\.[^.]+$", 1))
    scored = found.select("page_id", "pos", "href", urls.link_score(F.col("text"), F.col("href"), F.col("url"), name).cast("int").alias("score"))
    return scored.filter("score >= 85")


_HREF = r"""k AS (SELECT page_id, url, unnest(d) AS a, unnest(s) AS b, unnest(q) AS c, unnest(t) AS x, generate_subscripts(d, 1) - 1 AS pos FROM
  (SELECT page_id, url, regexp_extract_all(html, 'LINK', 1) AS d, regexp_extract_all(html, 'LINK', 2) AS s, regexp_extract_all(html, 'LINK', 3) AS q, regexp_extract_all(html, 'LINK', 4) AS t FROM pages)),
h AS (SELECT page_id, url, CAST(pos AS INT) AS pos, regexp_replace(DECODEH, '#.*$', '') AS h, trim(regexp_replace(DECODET, '\s+', ' ', 'g')) AS text,
  lower(regexp_extract(url, 'PARTS', 1)) AS sch, lower(regexp_extract(url, 'PARTS', 2)) AS hst, regexp_extract(url, 'PARTS', 3) AS pth FROM k),
f AS (SELECT page_id, url, pos, text, sch, hst, CASE WHEN regexp_matches(h, '^(?i:https?)://') THEN h WHEN starts_with(h, '//') THEN sch || ':' || h WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
  WHEN starts_with(h, '/') THEN sch || '://' || hst || h ELSE sch || '://' || hst || regexp_replace(pth, '[^/]*$', '') || h END AS href FROM h),
links AS (SELECT * FROM f WHERE href IS NOT NULL AND lower(regexp_extract(href, 'PARTS', 2)) <> '')""".replace("LINK", urls._LINK.replace("'", "''")).replace("PARTS", urls._PARTS).replace("DECODEH", _decode("coalesce(a, '') || coalesce(b, '') || coalesce(c, '')")).replace("DECODET", _decode("regexp_replace(coalesce(x, ''), '<[^>]+>', ' ', 'g')"))
_SCORES = f"""WITH {_HREF}, n AS (SELECT *, {_norm("text")} AS t, {_norm("href")} AS hr, {_norm("regexp_extract(lower(regexp_extract(url, '" + urls._PARTS + "', 2)), '([^.]+)[.][^.]+[.][^.]+$', 1)")} AS i FROM links),
m AS (SELECT *, replace(i, ' ', '') AS cp, length(replace(i, ' ', '')) AS ln, len(string_split(i, ' ')) >= 2 OR length(replace(i, ' ', '')) >= 4 AS strong FROM n),
s AS (SELECT page_id, pos, href, CAST(greatest(0, CASE WHEN i <> '' AND contains(' ' || t || ' ', ' ' || i || ' ') THEN CASE WHEN strong THEN 130 ELSE 72 END + ln END,
  CASE WHEN i <> '' AND contains(' ' || hr || ' ', ' ' || i || ' ') THEN CASE WHEN strong THEN 112 ELSE 62 END + ln END, CASE WHEN strong AND contains(replace(t, ' ', ''), cp) THEN ln + 118 END, CASE WHEN strong AND contains(replace(hr, ' ', ''), cp) THEN ln + 100 END)
  - CASE WHEN regexp_matches(concat_ws(' ', t, hr), '{urls.BAD_LINK}') THEN 100 ELSE 0 END
  - CASE WHEN lower(regexp_extract(href, '{urls._PARTS}', 1)) || '://' || lower(regexp_extract(href, '{urls._PARTS}', 2)) = sch || '://' || hst THEN 0 ELSE 70 END AS INT) AS score FROM m)
SELECT * FROM s WHERE score >= 85"""


def url_parts(spark, sf):
    url = F.col("url")
    site = urls.same_site(url, F.concat(F.lit("https://www."), F.regexp_extract(urls.host(url), r"([^.]+\.[^.]+)$", 1)))
    return table(spark, sf, "pages").select("page_id", urls.scheme(url).alias("scheme"), urls.host(url).alias("host"), urls.path(url).alias("path"), site.alias("same_site"))


def normalize_text(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", F.md5(text.normalized(F.col("text"))).alias("split"), F.md5(text.normalized(F.col("text"), "fold")).alias("folded"))


def product_lines(spark, sf):
    """Lines of documents, products and marketing sentences among them."""
    doc = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    amount = F.concat_ws(" ", "line", F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, F.lit("12 Diamonds")).when((F.col("doc_id") + F.col("pos")) % 7 == 0, F.lit("Rp 20 ribu")))
    short = F.when(F.char_length("line") < 40, amount).otherwise(F.col("line"))
    flagged = doc.select("doc_id", text.is_product(short).alias("product"), text.is_marketing(short).alias("marketing"))
    return flagged.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("product").alias("products"), F.count_if("marketing").alias("marketing"))


_MARKETING = rf"""(regexp_matches(x, '^(?:pilih|pilihkan|select|choose|silakan pilih|silahkan pilih|tentukan|masukkan|masukan|isi|klik)\b')
  OR regexp_matches(x, '\b{text.CHOICE}\b.{{0,40}}\batau\b.{{0,40}}\b{text.CHOICE}\b') OR regexp_matches(x, '\b(?:choose|select)\b.{{0,50}}\b{text.CHOICE}\b')
  OR regexp_matches(x, '(?:\brp\.?|\bidr\b)\s*\d[\d.,]*\s*(?:ribu(?:an)?|rb|k)\b')
  OR (regexp_matches(x, '^paket\b') AND contains(x, ':') AND regexp_matches(x, '\b(?:amankan|dapatkan|nikmati|stok|cuma|hanya|hemat|promo|termurah)\b'))
  OR amounts > 1 OR (words > 18 AND amounts >= 1) OR (words >= 8 AND regexp_matches(x, '^(?:(?:untuk|kamu|anda|dengan|jika|kalau|cukup|mulai)\b|top\s*up\s+\d)'))
  OR (words >= 10 AND (regexp_matches(x, '\b(?:kamu|anda)\s+(?:bisa|dapat|akan)\b') OR regexp_matches(x, '\b(?:bisa|dapat|dapatkan|mendapatkan|nikmati)\b.{{0,50}}\b{text.CURRENCY}\b'))))"""
_PACKAGE = "^(?:" + text.GAME + r"\s*[-–—:]?\s*)?" + text.NAMED + r"(?:\s*\$?\s*\d+(?:[.,]\d+)?)?(?:\s*[-–—:]?\s*" + text.GAME + ")?$"
_PRODUCTS = rf"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, CASE WHEN length(line) < 40 THEN concat_ws(' ', line, CASE WHEN (doc_id + pos) % 5 = 0 THEN '12 Diamonds' WHEN (doc_id + pos) % 7 = 0 THEN 'Rp 20 ribu' END) ELSE line END AS t FROM l),
w AS (SELECT doc_id, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS x FROM s),
c AS (SELECT doc_id, x, len(string_split(x, ' ')) AS words, len(regexp_extract_all(x, '\b\d[\d.,]*\s*(?:bonus\s*)?{text.PRODUCT_UNIT}\b')) AS amounts FROM w),
m AS (SELECT *, {_MARKETING} AS marketing FROM c),
f AS (SELECT doc_id, marketing, length(x) BETWEEN 2 AND 160 AND NOT marketing
  AND NOT regexp_matches(x, '^(?:image:|(?:dari|best seller|promo|diskon|pilih|harga|nominal|deskripsi|detail|lihat semua|pilih nominal|pilih produk|pilih diamond)$)') AND NOT regexp_matches(x, '^(?:rp\.?\s*)?\d[\d.,]*$')
  AND (regexp_matches(x, '\d[\d.,]*(?:\s*\+\s*\d[\d.,]*)?\s*(?:bonus\s*)?{text.PRODUCT_UNIT}\b') OR regexp_matches(x, '{_PACKAGE}')) AS product FROM m)
SELECT doc_id, count(*) AS lines, count(*) FILTER (product) AS products, count(*) FILTER (marketing) AS marketing FROM f GROUP BY doc_id"""

QUERIES = {
    "group_offers": group_offers,
    "canonicalize_names": canonicalize_names,
    "cheapest_offers": cheapest_offers,
    **{f"sorted_{k.replace('-', '_')}": _ordered(k) for k in _ORDERS},
    "facet_counts": facet_counts,
    "store_facet": store_facet,
    "dedupe_first": dedupe_first,
    "fallback_union": fallback_union,
    "batch_merge": batch_merge,
    "paging": paging,
    "fallback_price": fallback_price,
    "parse_rupiah": parse_rupiah,
    "game_resolution": game_resolution,
    "autocomplete": autocomplete,
    "provider_summary": provider_summary,
    "error_priority": error_priority,
    "strategy_chain": strategy_chain,
    "candidate_fold": candidate_fold,
    "nearest_following": nearest_following,
    "json_props": json_props,
    "feed_products": feed_products,
    "html_lines": html_lines,
    "html_entities": html_entities,
    "line_slice": line_slice,
    "scoped_lines": scoped_lines,
    "page_links": page_links,
    "link_scores": link_scores,
    "url_parts": url_parts,
    "normalize_text": normalize_text,
    "product_lines": product_lines,
}

_STOPS = "(code = 'RATE_LIMITED' OR (code = 'ACCESS_BLOCKED' AND user_id % 2 <> 0))"
ORACLES = {
    "group_offers": f"WITH {_GROUPS} SELECT {_COLUMNS} FROM groups",
    "canonicalize_names": f"WITH {_OFFERS}, {_CASES}, n AS (SELECT DISTINCT original_name FROM offers UNION ALL SELECT * FROM v), {_canon('n')} SELECT original_name, package_type, canonical_name, canonical_key, unit, multiplier, base_amount, bonus_amount, total_amount, eligibility FROM c",
    "cheapest_offers": f"WITH {_OFFERS}, {_canon('(SELECT * FROM offers WHERE final_price > 0)')} SELECT game_id, canonical_key, CAST(rank AS INT) AS rank, store_id, store_name, original_name, final_price FROM (SELECT *, row_number() OVER (PARTITION BY game_id, canonical_key ORDER BY final_price, store_name, arrival_seq) AS rank FROM c) WHERE rank <= 3",
    **{f"sorted_{k.replace('-', '_')}": f"WITH {_GROUPS} SELECT {_COLUMNS}, CAST(row_number() OVER (PARTITION BY game_id ORDER BY {o}cheapest_price, canonical_key) AS INT) AS place FROM groups" for k, o in _ORDERS.items()},
    "facet_counts": f"WITH {_GROUPS} SELECT CASE WHEN package_type = 'currency' THEN 'currency:' || regexp_replace(lower(unit), '[^a-z0-9]+', '-', 'g') ELSE package_type END AS facet, count(*) AS groups, min(cheapest_price) AS from_price FROM groups GROUP BY 1",
    "store_facet": f"WITH {_OFFERS} SELECT store_id, store_name, count(*) AS offers, min(final_price) AS from_price FROM offers GROUP BY ALL",
    "dedupe_first": rf"WITH {_OFFERS}, r AS (SELECT *, row_number() OVER (PARTITION BY game_id, trim(regexp_replace(lower(original_name), '\s+', ' ', 'g')), final_price ORDER BY arrival_seq) AS k FROM offers) SELECT game_id, final_price, original_name, store_id, source FROM r WHERE k = 1",
    "fallback_union": f"WITH {_OFFERS}, live AS (SELECT * FROM offers WHERE source = 'live' AND store_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)), u AS (SELECT * FROM live UNION ALL SELECT * FROM offers o WHERE source = 'fallback' AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o.store_id AND s_nationkey < 12) AND NOT EXISTS (SELECT 1 FROM live WHERE live.store_id = o.store_id)) SELECT store_id, source, count(*) AS offers, CAST(sum(final_price) AS BIGINT) AS total FROM u GROUP BY ALL",
    "batch_merge": _MERGED,
    "paging": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 8 OFFSET 16",
    "fallback_price": "SELECT p_partkey, store, greatest(500, CAST(floor(p_retailprice * multiplier * (CAST(1.0 AS DOUBLE) + ((p_partkey + length(store)) % 5 - 2) * CAST(0.006 AS DOUBLE)) / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) * 100) AS price FROM part, (VALUES " + ", ".join(f"('{s}', CAST({m} AS DOUBLE))" for s, m in STORES) + ") s(store, multiplier)",
    "parse_rupiah": _RUPIAH,
    "game_resolution": _RESOLVE,
    "autocomplete": "SELECT p_name AS entry, min(p_partkey) AS registry_order FROM part WHERE contains(lower(p_name), 'gi') GROUP BY 1 ORDER BY 2 LIMIT 5",
    "provider_summary": _SUMMARY,
    "error_priority": f"WITH a AS (SELECT *, {_CODE_CASE} AS code FROM events) SELECT user_id, arg_max(code, ROW({_PRIORITY_CASE}, -event_id)) AS code, max({_PRIORITY_CASE}) AS priority FROM a GROUP BY user_id",
    "strategy_chain": f"WITH a AS (SELECT *, {_CODE_CASE} AS code FROM events), s AS (SELECT *, max(CASE WHEN {_STOPS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM a) SELECT user_id, event_id, code FROM s WHERE coalesce(stopped, 0) = 0",
    "candidate_fold": _FOLD,
    "nearest_following": _NEAREST,
    "json_props": "SELECT user_id, count(k) AS known, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id",
    "feed_products": "SELECT p_partkey AS store_id, p_brand AS game_id, p_name AS original_name, CAST(floor(p_retailprice) AS BIGINT) AS final_price FROM part WHERE p_partkey > 0",
    "html_lines": f"WITH {_LINES} SELECT page_id, pos, line FROM l",
    "html_entities": rf"SELECT page_id, trim(regexp_replace({_decode(chr(32) + 'regexp_extract(html, ' + chr(39) + '(?is)<title(?:' + chr(92) + 's[^>]*)?>(.*?)</title>' + chr(39) + ', 1)')}, '\s+', ' ', 'g')) AS title FROM pages",
    "line_slice": f"WITH {_LINES}, b AS (SELECT *, coalesce(min(pos) FILTER (regexp_matches(line, '^[A-M]')) OVER (PARTITION BY page_id), -1) AS first FROM l), e AS (SELECT *, min(pos) FILTER (regexp_matches(line, '&copy;') AND pos > first) OVER (PARTITION BY page_id) AS stop FROM b) SELECT page_id, pos, line FROM e WHERE pos > first AND (stop IS NULL OR pos < stop)",
    "scoped_lines": f"WITH {_LINES}, m AS (SELECT *, pos - max(CASE WHEN regexp_matches(line, '^(?:The|La|Le|Die)$') THEN pos END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS since FROM l) SELECT page_id, pos, line, since FROM m WHERE since <= 8",
    "page_links": f"WITH {_HREF} SELECT page_id, pos, href, text FROM links",
    "link_scores": _SCORES,
    "url_parts": rf"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '{urls._PARTS}', 1)) AS scheme, lower(regexp_extract(url, '{urls._PARTS}', 2)) AS host, regexp_extract(url, '{urls._PARTS}', 3) AS path FROM pages),
s AS (SELECT *, regexp_replace(host, '^www\.', '') AS a, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS b FROM p)
SELECT page_id, scheme, host, path, a <> '' AND b <> '' AND (a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a)) AS same_site FROM s""",
    "product_lines": _PRODUCTS,
    "normalize_text": f"SELECT doc_id, md5({_norm('text')}) AS split, md5({_norm('text', '')}) AS folded FROM documents",
}

rules.bind(_OFFERS, _GROUPS, _SCORES)
shop.bind(ORACLES["page_links"])
searches.bind(_LINES, _GROUPS)
QUERIES |= rules.QUERIES | shop.QUERIES | forms.QUERIES | scans.QUERIES | searches.QUERIES
ORACLES |= rules.ORACLES | shop.ORACLES | forms.ORACLES | scans.ORACLES | searches.ORACLES
