"""Queries of the rules over whole tables: rows are written in the forms that a rule tells apart.

Which form a row has is a number of its key, so every form is met by many rows
with numbers of their own; the SQL states each form's result by arithmetic on
the row and shares no pattern with the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import failures, money, names, pages, text
from offerloom.functions.names import dotted
from offerloom.operators import games, lines, offers, structured
from offerloom.plans.shop import ITEMS, _joined, items
from offerloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def _pick(values: list, place):
    """The value at a place of a fixed list."""
    return F.array(*map(F.lit, values))[place.cast("int")]


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# Prices ---------------------------------------------------------------------


def price_texts(spark, sf):
    """Every item's price in one of twelve forms, read by each of the price rules."""
    item = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") + 0.5).cast("bigint").alias("p"), ((F.col("l_partkey") + F.col("l_linenumber")) % 12).alias("form"))
    plain, dots = F.col("p").cast("string"), dotted(F.col("p"))
    forms = [F.concat(F.lit("Rp "), dots), F.concat(F.lit("Rp. "), dots, F.lit(",50")), F.concat(F.lit("IDR "), plain), F.concat(F.lit("IDR"), plain), F.concat(plain, F.lit(" IDR")), F.concat(dots, F.lit(" Rupiah")), F.concat(plain, F.lit(" Diamonds")), F.concat(F.lit("mulai Rp "), dots), F.concat(F.lit("harga Rp:"), dots, F.lit(" dulu Rp "), dotted(F.col("p") + 1000)), F.format_number("p", 0), F.lit(""), F.concat(F.lit("USD "), plain, F.lit("."), F.lpad((F.col("p") % 100).cast("string"), 2, "0"))]
    rows = item.withColumn("t", F.element_at(F.array(*forms), (F.col("form") + 1).cast("int")))
    t = F.col("t")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p", money.rupiah(t).alias("price"), money.structured(t).alias("loose"), money.first_of_line(t).alias("first"), money.first_strict(t).alias("strict"), money.api_price(t, 1.0 + F.col("l_linenumber") % 3).alias("scaled"), money.has_mark(t).alias("speaks"), money.has_price(t).alias("priced"), money.is_start_price(t).alias("start"))


_CENTS = "CASE WHEN p >= 1000 THEN p ELSE p + 1 END"  # a price of three digits and `,50` is rounded up
QUERIES["price_texts"] = price_texts
ORACLES["price_texts"] = f"""WITH i AS (SELECT *, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS p, (l_partkey + l_linenumber) % 12 AS form FROM lineitem),
 r AS (SELECT *, CASE WHEN form IN (0, 2, 4, 5, 7, 8, 9) THEN p WHEN form = 1 THEN {_CENTS} END AS price FROM i)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p, price, CASE WHEN form IN (3, 6) THEN p WHEN form = 11 THEN p + CASE WHEN p % 100 >= 50 THEN 1 ELSE 0 END ELSE price END AS loose, CASE WHEN form IN (0, 2, 7, 8, 1) THEN price END AS first,
 CASE WHEN form = 1 AND p < 1000 THEN 100 * p + 50 WHEN form IN (0, 1, 2, 7, 8) AND p >= 100 THEN p END AS strict, CAST(price * (1 + l_linenumber % 3) AS BIGINT) AS scaled, form IN (0, 1, 2, 4, 5, 7, 8) AS speaks, form IN (0, 1, 2, 7, 8) AS priced, form = 7 AS start FROM r"""


# Lines and names ------------------------------------------------------------

# Fixed values of the mapping: units and named packages that lines are made of.
LINE_UNITS = ["Diamonds", "UC", "Genesis Crystals", "Robux", "Tokens", "Points", "Coins", "Vouchers", "Opals", "Lunites", "Starstones", "Origeometry", "Oneiric Shards", "Lunar Crystals", "Riftcrystals", "VP", "Credits", "Shells", "CP"]
LINE_PACKAGES = ["Weekly Diamond Pass", "Weekly Pass", "Weekly Card Plus", "Weekly Card", "Monthly Pass", "Membership Mingguan", "Starlight Membership", "Twilight Pass", "Welkin Moon", "Elite Bundle", "Battle Pass", "Honor Pass", "Royale Pass", "Kafra Monthly", "Express Supply Pass", "Inter-Knot Membership", "Special Data", "Zero Data", "Lunite Subscription", "Epic Bundle"]


def line_kinds(spark, sf):
    """Lines about every part: amounts, named packages, instructions, sentences and rounded prices."""
    turn = F.floor(F.col("p_partkey") / 12)
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 12).alias("form"), F.col("p_size").cast("string").alias("n"), (F.col("p_size") + 1).cast("string").alias("m"), _pick(LINE_UNITS, turn % len(LINE_UNITS)).alias("u"), _pick(LINE_PACKAGES, turn % len(LINE_PACKAGES)).alias("s"), "p_name")
    forms = ["{n} {u}", "{s}", "Pilih {n} {u}", "Rp {n} ribu", "{n} {u} dan {m} {u}", "Paket hemat: dapatkan {n} {u}", "{p_name} edition", "untuk kamu yang main tiap hari ada {n} {u}", "{n} + {m} Bonus {u}", "Mobile Legends - {s}", "{s} hari ini", "Top Up {n} {u} sekarang juga di toko kami"]
    whole = _pick(forms, F.col("form"))
    for c in ("n", "m", "u", "s", "p_name"):
        whole = F.replace(whole, F.lit("{" + c + "}"), F.col(c))
    rows = rows.withColumn("line", whole)
    x = F.col("line")
    return rows.select("p_partkey", "line", text.is_product(x).alias("product"), text.is_named_package(x).alias("named"), text.is_marketing(x).alias("marketing"), text.is_instruction(x).alias("instruction"), text.is_rounded_price(x).alias("rounded"), text.counted_products(x).cast("int").alias("amounts"))


QUERIES["line_kinds"] = line_kinds
ORACLES["line_kinds"] = f"""WITH r AS (SELECT p_partkey, p_partkey % 12 AS form, p_size AS n, p_name, {_sql_list(LINE_UNITS)}[1 + (p_partkey // 12) % {len(LINE_UNITS)}] AS u, {_sql_list(LINE_PACKAGES)}[1 + (p_partkey // 12) % {len(LINE_PACKAGES)}] AS s FROM part)
 SELECT p_partkey, CASE form WHEN 0 THEN n || ' ' || u WHEN 1 THEN s WHEN 2 THEN 'Pilih ' || n || ' ' || u WHEN 3 THEN 'Rp ' || n || ' ribu' WHEN 4 THEN n || ' ' || u || ' dan ' || (n + 1) || ' ' || u WHEN 5 THEN 'Paket hemat: dapatkan ' || n || ' ' || u WHEN 6 THEN p_name || ' edition' WHEN 7 THEN 'untuk kamu yang main tiap hari ada ' || n || ' ' || u WHEN 8 THEN n || ' + ' || (n + 1) || ' Bonus ' || u WHEN 9 THEN 'Mobile Legends - ' || s WHEN 10 THEN s || ' hari ini' ELSE 'Top Up ' || n || ' ' || u || ' sekarang juga di toko kami' END AS line,
 form IN (0, 1, 8, 9) AS product, form IN (1, 9) AS named, form IN (2, 3, 4, 5, 7, 11) AS marketing, form = 2 AS instruction, form = 3 AS rounded, CAST(CASE WHEN form IN (0, 2, 5, 7, 8, 11) THEN 1 WHEN form = 4 THEN 2 ELSE 0 END AS INT) AS amounts FROM r"""

# Fixed values of the mapping: every unit and every special package with the type it has.
NAME_UNITS = ["Lunar Crystals", "Genesis Crystals", "Oneiric Shards", "Riftcrystals", "Origeometry", "Starstones", "Monochrome", "Lunites", "Opals", "Robux", "Diamonds", "UC", "CP", "VP", "Crystals", "Tokens", "Points", "Coins", "Vouchers"]
SPECIAL = [("Weekly Diamond Pass", "weekly-pass"), ("Weekly Card Plus", "weekly-card-plus"), ("Weekly Card", "weekly-card"), ("Blessing of the Welkin Moon", "welkin"), ("Starlight Plus", "starlight"), ("Twilight Pass", "twilight"), ("Weekly Elite Bundle", "elite-bundle"), ("Monthly Epic Bundle", "epic-bundle"), ("Royale Pass", "battle-pass"), ("Kafra Monthly", "monthly-pass"), ("Express Supply Pass", "express-supply-pass"), ("Inter Knot Membership", "inter-knot-membership"), ("Coronomicon Monthly", "coronomicon-monthly"), ("My Special Data", "special-data"), ("Zero Data", "zero-data"), ("Lunite Subscription", "lunite-subscription"), ("Gold Member", "membership")]


def package_names(spark, sf):
    """Names of every unit and special package in the forms that sellers write, canonicalised."""
    turn = F.floor(F.col("p_partkey") / 5)
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("form"), F.col("p_size").cast("bigint").alias("n"), (F.col("p_partkey") % 9).alias("m"), _pick(NAME_UNITS, turn % len(NAME_UNITS)).alias("u"), _pick([s for s, _ in SPECIAL], turn % len(SPECIAL)).alias("s"), "p_name")
    n, m = F.col("n").cast("string"), F.col("m").cast("string")
    name = F.when(F.col("form") == 0, F.concat(n, F.lit(" "), "u")).when(F.col("form") == 1, F.concat(dotted(F.col("n") * 1000), F.lit(" "), "u")).when(F.col("form") == 2, F.concat((F.col("n") + F.col("m")).cast("string"), F.lit(" "), "u", F.lit(" ("), n, F.lit(" + "), m, F.lit(" Bonus)"))).when(F.col("form") == 3, F.concat("s", F.when(F.col("m") % 2 == 1, " x3").otherwise(""))).otherwise(F.col("p_name"))
    found = names.canonicalized(rows.withColumn("original_name", name))
    return found.select("p_partkey", "original_name", "package_type", "canonical_key", "multiplier", "total_amount", "bonus_amount", pages.has_ambiguous_unit(F.array("u")).alias("shared"))


QUERIES["package_names"] = package_names
ORACLES["package_names"] = f"""WITH r AS (SELECT p_partkey, p_partkey % 5 AS form, CAST(p_size AS BIGINT) AS n, p_partkey % 9 AS m, p_name, {_sql_list(NAME_UNITS)}[1 + (p_partkey // 5) % {len(NAME_UNITS)}] AS u, {_sql_list([s for s, _ in SPECIAL])}[1 + (p_partkey // 5) % {len(SPECIAL)}] AS s, {_sql_list([k for _, k in SPECIAL])}[1 + (p_partkey // 5) % {len(SPECIAL)}] AS kind FROM part),
 t AS (SELECT *, CASE form WHEN 0 THEN n WHEN 1 THEN 1000 * n WHEN 2 THEN n + m END AS total, CAST(CASE WHEN form = 3 AND m % 2 = 1 THEN 3 ELSE 1 END AS BIGINT) AS multiplier FROM r)
 SELECT p_partkey, CASE form WHEN 0 THEN n || ' ' || u WHEN 1 THEN replace(format('{{:,}}', 1000 * n), ',', '.') || ' ' || u WHEN 2 THEN (n + m) || ' ' || u || ' (' || n || ' + ' || m || ' Bonus)' WHEN 3 THEN s || CASE WHEN m % 2 = 1 THEN ' x3' ELSE '' END ELSE p_name END AS original_name,
 CASE WHEN form < 3 THEN 'currency' WHEN form = 3 THEN kind ELSE 'other' END AS package_type, CASE WHEN form < 3 THEN 'currency:' || lower(u) || ':' || total WHEN form = 3 THEN kind || ':' || multiplier ELSE 'other:' || p_name END AS canonical_key, multiplier, total AS total_amount, CASE form WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN m END AS bonus_amount, u IN ('Diamonds', 'Coins', 'Crystals', 'Points') AS shared FROM t"""


# Pages of lines -------------------------------------------------------------

OPENING, CLOSING = "<h1>Top Up</h1><p>99 Diamonds</p><p>Rp 1</p><p>Pilih Nominal Top Up</p>", "<p>Pilih pembayaran</p><p>5 UC</p><p>Rp 5</p>"
DISTANCE = 3


def line_pages(spark, sf):
    """Each order as a shop's page: its items' names, up to three lines between, the price and an older one."""
    item = F.concat(F.lit("<p>"), "name", F.lit("</p>"), F.expr("repeat('<p>Dari</p>', cast(sk % 4 as int))"), F.lit("<p>Rp. "), dotted(F.col("price")), F.lit("</p><p>Rp. 999.999.999</p>"))
    return _joined(items(spark, sf), item).select("page_id", F.concat(F.lit(OPENING), "text", F.lit(CLOSING)).alias("html"))


def listed_offers(spark, sf):
    """Offers of each page's list of packages, within three lines."""
    rows = lines.listed(line_pages(spark, sf), "(?i)pilih nominal", "(?i)pilih pembayaran")
    return lines.list_offers(rows, DISTANCE).select("page_id", "original_name", "final_price")


def unit_pages(spark, sf):
    """Whether a page's list has a line of UC with an exact price soon after it."""
    rows = lines.listed(line_pages(spark, sf), "(?i)pilih nominal", "(?i)pilih pembayaran").select("page_id", F.inline("lines"))
    return lines.unit_near_price(rows, text.contains_phrase(text.normalized(F.col("line")), F.lit("uc")))


_SEEN = f"sk % 4 + 1 <= CASE WHEN pk % 5 = 4 THEN 1 ELSE {DISTANCE} END"
QUERIES |= {"listed_offers": listed_offers, "unit_pages": unit_pages}
ORACLES |= {
    "listed_offers": f"WITH {ITEMS} SELECT DISTINCT page_id, name AS original_name, price AS final_price FROM items WHERE {_SEEN} AND price > 0",
    "unit_pages": f"WITH {ITEMS} SELECT page_id, bool_or(name LIKE '% UC') AS paired FROM items GROUP BY page_id",
}


# Structured data ------------------------------------------------------------


def product_scripts(spark, sf):
    """Each order as a page with one script of products: plain ones, ones with a nested offer, and ones whose price lies too deep."""
    k = F.col("k") % 3
    item = F.when(k == 0, F.concat(F.lit('{"title":"'), "name", F.lit('","sellingPrice":'), F.col("price").cast("string"), F.lit("}"))).when(k == 1, F.concat(F.lit('{"name":"'), "name", F.lit('","offers":{"price":"Rp '), dotted(F.col("price")), F.lit('","url":"/x"},"url":" /five "}'))).otherwise(F.concat(F.lit('{"name":"'), "name", F.lit('","a":{"b":{"c":{"price":'), F.col("price").cast("string"), F.lit("}}}}")))
    return _joined(items(spark, sf), item, ",").select("page_id", F.concat(F.lit('<script type="application/ld+json">{"list":['), "text", F.lit("]}</script>")).alias("html"))


def structured_offers(spark, sf):
    return structured.structured_offers(structured.documents(product_scripts(spark, sf))).select("page_id", "original_name", "final_price", "url")


QUERIES["structured_offers"] = structured_offers
ORACLES["structured_offers"] = f"""WITH {ITEMS} SELECT page_id, name AS original_name, price AS final_price, CASE WHEN k % 3 = 1 THEN url END AS url FROM items, (SELECT unnest(['/five', '/x']) AS url) WHERE k % 3 = 1 OR (k % 3 = 0 AND url = '/x') UNION ALL SELECT page_id, name, price, NULL FROM items WHERE k % 3 = 2"""


# Games and addresses --------------------------------------------------------

# Fixed values of the mapping: three games, one without units.
GAMES = [("mobile-legends", 1, "Mobile Legends", "MLBB", ["ml", "Diamond", "weekly pass ml"], ["Diamond", "Diamonds"]), ("genshin-impact", 2, "Genshin Impact", "GI", ["genshin"], ["Genesis Crystals"]), ("plain-game", 3, "Plain", None, None, None)]


def registry(spark):
    return spark.createDataFrame(GAMES, "game_id string, place int, name string, short_name string, aliases array<string>, unit_aliases array<string>")


def offers_of_game(spark, sf):
    """Items under a game each, with another game's name in front of some, as far as they belong to it."""
    rows = items(spark, sf).withColumn("game_id", _pick([g[0] for g in GAMES], F.col("sk") % 3))
    front = F.when(F.col("pk") % 7 == 0, "Genshin Impact ").when(F.col("pk") % 7 == 1, "MLBB ").otherwise("")
    named = rows.select("page_id", "k", "game_id", F.concat(front, "name").alias("original_name"))
    return games.offers_of_game(named, registry(spark)).select("page_id", "k", "game_id", "original_name")


def guessed_urls(spark, sf):
    """Addresses at which every supplier may keep each game; even ones have a template of their own."""
    home = F.when(F.col("s_suppkey") % 5 == 4, "none").otherwise(F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".id/")))
    own = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("{homepage}/id/{gameSlug}")))
    pairs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store_id"), F.explode(F.array(*(F.lit(g[0]) for g in GAMES))).alias("game_id"), home.alias("homepage"), own.alias("templates"))
    return games.guessed_urls(pairs, registry(spark))


_PLACES = ["", "games/", "game/", "topup/", "top-up/", "top-up-game/", "product/", "products/"]
QUERIES |= {"offers_of_game": offers_of_game, "guessed_urls": guessed_urls}
ORACLES |= {
    "offers_of_game": f"""WITH {ITEMS}, g AS (SELECT *, {_sql_list([g[0] for g in GAMES])}[1 + sk % 3] AS game_id FROM items)
 SELECT page_id, k, game_id, CASE pk % 7 WHEN 0 THEN 'Genshin Impact ' WHEN 1 THEN 'MLBB ' ELSE '' END || name AS original_name FROM g WHERE CASE WHEN pk % 7 = 0 THEN game_id = 'genshin-impact' WHEN pk % 7 = 1 THEN game_id = 'mobile-legends' WHEN game_id = 'plain-game' THEN true WHEN game_id = 'mobile-legends' THEN name LIKE '%Diamond%' OR name IN ('Starlight Membership', 'Twilight Pass') ELSE name LIKE '%Genesis Crystals' OR name LIKE 'Blessing%' END""",
    "guessed_urls": f"""WITH s AS (SELECT s_suppkey AS store_id, 'https://s' || s_suppkey || '.id/' AS home, s_suppkey % 2 = 0 AS own FROM supplier WHERE s_suppkey % 5 <> 4), n AS (SELECT * FROM (VALUES ('mobile-legends', 0, 'mobile-legends'), ('mobile-legends', 1, 'mlbb'), ('genshin-impact', 0, 'genshin-impact'), ('genshin-impact', 1, 'genshin'), ('plain-game', 0, 'plain-game'), ('plain-game', 1, 'plain')) v(game_id, i, slug)),
 t AS (SELECT unnest({_sql_list(['id/', *_PLACES])}) AS t, unnest(range(9)) AS j) SELECT store_id, game_id, home || t || slug AS url, CAST(row_number() OVER (PARTITION BY store_id, game_id ORDER BY i, j) - 1 AS INT) AS place FROM s, n, t WHERE own OR j > 0""",
}

# Fixed values of the mapping: signals of a page about a game, and what they prove by the rules.
SIGNALS = ["game_id", "title", "heading", "meta", "structured", "body", "url", "home"]
EVIDENCE = [
    (("mobile-legends", "Top Up Mobile Legends", "Diamond", None, "", "mobile legends mobile legends, mobile legends mobile legends", "https://s.id/mobile-legends", "https://s.id/"), (True, 295, "halaman cocok dengan game")),
    (("mobile-legends", "Genshin", "MLB", "mlbb", None, "MLBB", "https://s.id/g", "https://s.id"), (False, 100, "halaman terdeteksi sebagai Genshin Impact")),
    (("mobile-legends", "Home", "", "MLBB", "", "", "https://s.id//", "https://s.id"), (False, 75, "URL mengarah kembali ke homepage/katalog umum")),
    (("mobile-legends", "Shop ML", "ml", "", "", "mlbb. diamonds mlbb", "https://s.id/a", "https://s.id"), (True, 140, "halaman cocok dengan game")),
    (("mobile-legends", "", "", "", "", "mlbb. x mlbb. y mlbb", "https://s.id/a", "https://s.id"), (False, 70, "konten halaman tidak cukup membuktikan game yang dicari")),
    (("genshin-impact", "mlbb", "genshin", "", "", "", None, None), (True, 110, "halaman cocok dengan game")),
    (("plain-game", None, None, None, "plain", None, "https://s.id/a", "https://s.id/a"), (True, 70, "halaman cocok dengan game")),
]


def page_evidence(spark, sf):
    """Each order's page under a game with one of seven sets of signals, customers' keys being words of the body."""
    key = F.col("o_orderkey") % len(EVIDENCE)
    fields = {c: _pick([g[k] for g, _ in EVIDENCE], key) for k, c in enumerate(SIGNALS)}
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), *(v.alias(c) for c, v in fields.items()), "o_custkey")
    return games.page_evidence(rows.withColumn("body", F.concat_ws(" ", F.col("o_custkey").cast("string"), "body")), registry(spark))


QUERIES["page_evidence"] = page_evidence
ORACLES["page_evidence"] = "SELECT o_orderkey AS page_id, " + ", ".join(f"CAST({_sql_list(values)}[1 + o_orderkey % {len(EVIDENCE)}] AS {kind}) AS {name}" for name, kind, values in (("game_id", "VARCHAR", [g[0] for g, _ in EVIDENCE]), *((n, t, [w[k] for _, w in EVIDENCE]) for k, (n, t) in enumerate((("ok", "BOOLEAN"), ("score", "INT"), ("reason", "VARCHAR")))))) + " FROM orders"


# Failures -------------------------------------------------------------------

# Fixed values of the mapping: code, message, status and reason of a failed fetch, and the state, detail, status and worth of a retry that the rules give.
FAILED = [
    (("MAINTENANCE", "Rp", None, None), ("MAINTENANCE", "MAINTENANCE", None, False)),
    (("region_unavailable", None, 302, "locale_redirect"), ("REGION_UNAVAILABLE", "LOCALE_REDIRECT", 302, False)),
    (("CANDIDATE_BLOCKED", None, None, None), ("CANDIDATE_BLOCKED", "CANDIDATE_BLOCKED", 403, False)),
    (("DISCOVERY_BLOCKED", None, 451, None), ("DISCOVERY_BLOCKED", "DISCOVERY_BLOCKED", 451, False)),
    ((None, "HTTP 403 Forbidden", None, None), ("ACCESS_BLOCKED", "HTTP_403", 403, False)),
    (("", "too many requests", None, None), ("RATE_LIMITED", "RATE_LIMITED", 429, True)),
    ((None, "getaddrinfo ENOTFOUND", None, None), ("NETWORK_ERROR", "NETWORK_DNS_ERROR", None, True)),
    ((None, "TLS handshake socket", None, None), ("NETWORK_ERROR", "NETWORK_TLS_ERROR", None, False)),
    ((None, "socket hang up", None, None), ("NETWORK_ERROR", "NETWORK_CONNECTION_ERROR", None, True)),
    ((None, "Connect Timeout Error", None, None), ("NETWORK_ERROR", "NETWORK_CONNECT_TIMEOUT", None, True)),
    ((None, "Timeout", 504, None), ("TIMEOUT", "TIMEOUT", 504, True)),
    (("PARSER_FAILED", None, None, "html_no_product"), ("PARSER_FAILED", "HTML_NO_PRODUCT", None, False)),
    ((None, "Harga tidak ditemukan", None, None), ("PARSER_FAILED", "UNSUPPORTED_STRUCTURE", None, False)),
    ((None, None, 410, None), ("PAGE_NOT_FOUND", "PAGE_NOT_FOUND", 410, False)),
    (("HTTP_ERROR", None, 502, None), ("UPSTREAM_ERROR", "HTTP_ERROR", 502, True)),
    ((None, "fetch failed", None, None), ("NETWORK_ERROR", "NETWORK_FETCH_FAILED", None, True)),
    (("ODD", "what", None, None), ("UNKNOWN_ERROR", "ODD", None, False)),
    ((None, "http 404 later", 0, None), ("PAGE_NOT_FOUND", "PAGE_NOT_FOUND", 404, False)),
    (("ACCESS_BLOCKED", None, None, None), ("ACCESS_BLOCKED", "ACCESS_BLOCKED", None, False)),
]
# Fixed values of the mapping: code and message of a socket's error with its kind.
SOCKETS = [("ENOTFOUND", None, "DNS_ERROR"), (None, "getaddrinfo failed", "DNS_ERROR"), (None, "the dns server", "DNS_ERROR"), (None, "dnsmasq", "FETCH_FAILED"), ("econnreset", "", "CONNECTION_ERROR"), ("", "Socket hang up", "CONNECTION_ERROR"), ("CERT_HAS_EXPIRED", "", "TLS_ERROR"), ("", "bad certificate", "TLS_ERROR"), ("ETIMEDOUT", "", "CONNECT_TIMEOUT"), ("ODD", "odd", "FETCH_FAILED")]


def event_failures(spark, sf):
    """Each event as a failed fetch; a user's number follows the message."""
    key = F.col("event_id") % len(FAILED)
    code, message, status, reason = (_pick([g[k] for g, _ in FAILED], key) for k in range(4))
    rows = table(spark, sf, "events").select("event_id", failures.classified(code, F.concat_ws(" user ", message, F.col("user_id").cast("string")), status.cast("int"), reason).alias("s"))
    return rows.select("event_id", "s.*")


def event_sockets(spark, sf):
    """Each event as a socket's error, met directly, on a guessed address or on the way."""
    key = F.col("event_id") % len(SOCKETS)
    phase = F.when(F.col("event_type") == "view", "guessed").when(F.col("event_type") == "click", "discovery").otherwise("direct")
    block = F.when(F.col("user_id") % 2 == 0, "access_blocked").otherwise("TIMEOUT")
    return table(spark, sf, "events").select("event_id", failures.network_code(_pick([s[0] for s in SOCKETS], key), _pick([s[1] for s in SOCKETS], key)).alias("network"), failures.converted(block, phase).alias("code"))


QUERIES |= {"event_failures": event_failures, "event_sockets": event_sockets}
ORACLES |= {
    "event_failures": "SELECT event_id, " + ", ".join(f"CAST({_sql_list([w[k] for _, w in FAILED])}[1 + event_id % {len(FAILED)}] AS {t}) AS {n}" for k, (n, t) in enumerate((("status_code", "VARCHAR"), ("detail_code", "VARCHAR"), ("http_status", "INT"), ("retryable", "BOOLEAN")))) + " FROM events",
    "event_sockets": f"SELECT event_id, 'NETWORK_' || {_sql_list([s[2] for s in SOCKETS])}[1 + event_id % {len(SOCKETS)}] AS network, CASE WHEN user_id % 2 = 1 THEN 'TIMEOUT' WHEN event_type = 'view' THEN 'CANDIDATE_BLOCKED' WHEN event_type = 'click' THEN 'DISCOVERY_BLOCKED' ELSE 'ACCESS_BLOCKED' END AS code FROM events",
}


# Marks, settings and ages ---------------------------------------------------


def store_marks(spark, sf):
    """Initials of parts as stores, short names, and which of their addresses are code of their own."""
    ends = _pick(["/static/app.css", "/x.js?v=1", "/gtag.js", "/x.json"], F.col("p_partkey") % 4)
    known = F.when(F.col("p_partkey") % 10 == 0, "Dunia games").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", pages.abbreviation(F.concat_ws("  ", "p_name", "p_type", "p_brand", "p_name")).alias("short"), pages.initials(known).alias("initials"), pages.is_bundle(F.concat(F.lit("https://a.b"), ends)).alias("bundle"))


def event_ages(spark, sf):
    """How long before the last event each one was, with its value as a bounded setting and its type as a switch."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = rows.agg(F.max("ts").alias("last"))
    return rows.join(F.broadcast(last)).select("event_id", pages.ago(F.col("ts"), F.col("last")).alias("ago"), pages.bounded(F.when(F.col("user_id") % 5 > 0, F.col("value").cast("string")).otherwise("x"), 8.0, 1.0, 20.0).alias("setting"), pages.enabled(F.when(F.col("event_type") == "view", "TRUE").when(F.col("event_type") == "click", "yes"), True).alias("switch"))


QUERIES |= {"store_marks": store_marks, "event_ages": event_ages}
ORACLES |= {
    "store_marks": "SELECT p_partkey, upper(p_name[1:1] || string_split(p_name, ' ')[2][1:1] || p_type[1:1] || p_brand[1:1]) AS short, CASE WHEN p_partkey % 10 = 0 THEN 'DG' ELSE upper(p_name[1:1] || string_split(p_name, ' ')[2][1:1]) END AS initials, p_partkey % 4 < 2 AS bundle FROM part",
    "event_ages": "WITH a AS (SELECT *, (epoch_us(max(ts) OVER ()) // 1000 - epoch_us(ts) // 1000) // 1000 AS s FROM events) SELECT event_id, CASE WHEN s < 8 THEN 'baru saja' WHEN s < 60 THEN s || ' detik lalu' ELSE (s // 60) || ' menit lalu' END AS ago, CASE WHEN user_id % 5 = 0 THEN 8.0 ELSE greatest(1.0, least(20.0, value)) END::DOUBLE AS setting, event_type <> 'click' AS switch FROM a",
}


# Offers as they are taken in --------------------------------------------------


def clean_offers(spark, sf):
    """Items whose price text or page speaks of rupiah, of 100 at least."""
    rows = items(spark, sf).select("page_id", "k", (F.col("price") / F.when(F.col("sk") % 3 == 0, 1000).otherwise(1)).alias("final_price"), _pick(["Rp 5", "150", None, "$5"], F.col("pk") % 4).alias("price_text"), _pick(["Harga Rp", "usd", None], F.col("page_id") % 3).alias("page"))
    return offers.sanitized(rows, "page").select("page_id", "k")


def live_offers(spark, sf):
    """Items as live offers, with what is known of where they were found."""
    rows = items(spark, sf).select("page_id", "k", _pick(["json", "", None], F.col("pk") % 3).alias("source"), _pick(["card", None], F.col("sk") % 2).alias("extraction_source"), _pick(["own", ""], F.col("page_id") % 2).alias("access_strategy"))
    return offers.as_live(rows, "dedicated").withColumn("replaced", F.lit(False)).union(offers.as_live(rows, "dynamic", replace=True).withColumn("replaced", F.lit(True)))


def registry_rows(spark, sf):
    """Suppliers as stores, every second one overridden, and adapters of which some are not registered."""
    sup = table(spark, sf, "supplier")
    own = sup.select(F.col("s_suppkey").alias("store_id"), F.lit("top").alias("category"), F.lit("ok").alias("verification"), F.when(F.col("s_suppkey") % 3 > 0, F.create_map(F.lit("x"), F.col("s_nationkey"), F.lit("y"), F.lit(2))).alias("limits"))
    over = sup.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("store_id"), F.lit("new").alias("category"), F.create_map(F.lit("y"), F.lit(5)).alias("limits"))
    whole = offers.overridden(own, over)
    adapters = sup.select("s_suppkey").union(table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint") + 1_000_000)).toDF("store_id")
    limits = whole.select("store_id", F.array_join(F.array_sort(F.transform(F.map_entries("limits"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("limits"))
    return offers.registered(adapters, whole).join(limits, "store_id", "left").select("store_id", "category", "verification", "limits")


def configured_pages(spark, sf):
    """Brands as games with addresses at some suppliers: each pair with its address or that none is configured."""
    sup = table(spark, sf, "supplier")
    brand = table(spark, sf, "part").select(F.col("p_brand").alias("game_id"), (F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 10).alias("d")).distinct()
    url = F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("https://s/"), F.col("s_suppkey").cast("string"))).otherwise("")
    listed = brand.join(sup, F.col("s_suppkey") % 10 == F.col("d"), "left").groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct(F.col("s_suppkey").alias("k"), url.alias("v"))))).alias("stores"))
    return offers.store_pages(listed, sup.select(F.col("s_suppkey").alias("store_id")))


QUERIES |= {"clean_offers": clean_offers, "live_offers": live_offers, "registry_rows": registry_rows, "configured_pages": configured_pages}
ORACLES |= {
    "clean_offers": f"WITH {ITEMS} SELECT page_id, k FROM items WHERE price / CASE WHEN sk % 3 = 0 THEN 1000 ELSE 1 END >= 100 AND (pk % 4 = 0 OR page_id % 3 = 0)",
    "live_offers": f"""WITH {ITEMS} SELECT page_id, k, 'live' AS source, CASE WHEN sk % 2 = 0 THEN 'card' WHEN pk % 3 = 0 THEN 'json' WHEN r THEN 'dynamic' ELSE 'dedicated' END AS extraction_source, CASE WHEN r THEN 'dynamic' WHEN page_id % 2 = 0 THEN 'own' ELSE 'dedicated' END AS access_strategy, r AS replaced FROM items, (SELECT unnest([false, true]) AS r)""",
    "registry_rows": "SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'top' END AS category, 'ok' AS verification, CASE WHEN s_suppkey % 3 > 0 THEN 'x=' || s_nationkey || ',y=' || CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 2 END WHEN s_suppkey % 2 = 0 THEN 'y=5' END AS limits FROM supplier UNION ALL SELECT n_nationkey + 1000000, 'partner', 'feed', NULL FROM nation",
    "configured_pages": "WITH g AS (SELECT DISTINCT p_brand AS game_id, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 10 AS d FROM part) SELECT game_id, s_suppkey AS store_id, CASE WHEN s_suppkey % 10 <> d THEN NULL WHEN s_suppkey % 4 > 0 THEN 'https://s/' || s_suppkey ELSE '' END AS url, CASE WHEN s_suppkey % 10 <> d OR s_suppkey % 4 = 0 THEN 'NOT_CONFIGURED' END AS code FROM g, supplier",
}
