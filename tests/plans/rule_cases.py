"""Literal cases of single rules with the results that the rules state; they are written down by hand and share nothing with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import failures, money, pages, text
from offerloom.operators import lines, offers

QUERIES, ORACLES = {}, {}


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _cases(name: str, given: str, wanted: str, rows: list[tuple], build) -> None:
    """A query over literal rows. given: schema of the inputs; wanted: columns and SQL types of the results; build: DataFrame to columns."""
    inputs = [c.strip().split(" ")[0] for c in given.split(",")]
    results = [c.strip().split(" ") for c in wanted.split(",")]
    n = len(inputs)

    def query(spark, sf):
        numbered = spark.createDataFrame([(k, *r[:n]) for k, r in enumerate(rows)], f"case int, {given}")
        return build(numbered).select("case", *(c for c, _ in results))

    QUERIES[name] = query
    values = ", ".join("(" + ", ".join([str(k), *map(_sql, r[n:])]) + ")" for k, r in enumerate(rows))
    ORACLES[name] = f'SELECT CAST("case" AS INT) AS "case", ' + ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in results) + f' FROM (VALUES {values}) v("case", ' + ", ".join(c for c, _ in results) + ")"


def _column(name: str, make):
    """Columns need a session, so they are made when the query is."""
    return lambda df: df.withColumn(name, make())


def T():
    return F.col("t")


_cases("rupiah_cases", "t string", "price BIGINT", [
    ("Rp . 21.635", 21635), ("Rp.848", 848), ("Rp : 25.000", 25000), ("Rp25000", 25000), ("IDR 25000", 25000), ("IDR: 25,000", 25000), ("IDR25000", None), ("1000IDR", None), ("1000 IDR", 1000), ("1.500 Rupiah", 1500), ("1500 Rupiahs", None),
    ("1.234.567,89", 1234567), ("1,234.56", 1234), ("12.50", 13), ("12,49", 12), ("86 Diamonds", None), ("xRp 5", None), ("\t 7000 \n", 7000), ("", None), (None, None), ("grup Rp 9", 9), ("12.345.6", 123456), ("Rp", None),
], _column("price", lambda: money.rupiah(T())))
_cases("structured_prices", "t string", "price BIGINT", [("Rp 5.000", 5000), ("about 5.000 now", 5000), ("$ 1,5", 2), ("12.5", 125), ("a 12.5", 13), ("1,000,000 each", 1000000), ("free", None), ("0", None), ("0.4", 4), ("x 0.4", 0), (None, None), ("a1b2", 12), ("1.2.3", 123)], _column("price", lambda: money.structured(T())))
_cases("line_prices", "t string", "first BIGINT, strict BIGINT", [
    ("Rp 1.099 Rp 1.209", 1099, 1099), ("Rp. 4.378", 4378, 4378), ("Rp . 21.635", 21635, 21635), ("IDR: 25.000,50", 25000, 25000), ("Rp 50", 50, None), ("Rp 12.50", 13, 1250), ("Rp 0 Rp 700", 700, 700), ("25.000", None, None), ("5 Diamonds", None, None), (None, None, None), ("harga Rp:15.000 promo", 15000, 15000),
], lambda df: df.withColumns({"first": money.first_of_line(T()), "strict": money.first_strict(T())}))
_cases("api_prices", "t string, scale double", "price BIGINT", [("15", 1000.0, 15000), ("15", 1.0, 15), ("15", None, 15), ("15", -2.0, 15), ("0", 5.0, None), ("x", 5.0, None), (None, 5.0, None), ("3", 0.5, 2), ("Rp 2.000", 1.5, 3000)], _column("price", lambda: money.api_price(T(), F.col("scale"))))
_cases("price_marks", "t string", "speaks BOOLEAN, priced BOOLEAN, start BOOLEAN, code BOOLEAN", [
    ("Harga dalam Rupiah", True, False, False, False), ("mulai Rp 15.000", True, True, True, False), ("from IDR 5", True, True, True, False), ("Rp 0", True, False, False, False), ("IDR", True, False, False, True), (" rp ", True, False, False, True), ("rupiah", True, False, False, True), ("USD 5", False, False, False, False), ("gIDR", False, False, False, False), (None, False, False, False, False),
], lambda df: df.withColumns({"speaks": money.has_mark(T()), "priced": money.has_price(T()), "start": money.is_start_price(T()), "code": money.is_rupiah_code(T())}))

_cases("line_flags", "t string", "product BOOLEAN, named BOOLEAN, marketing BOOLEAN, instruction BOOLEAN, rounded BOOLEAN, amounts BIGINT", [
    ("5 Diamonds", True, False, False, False, False, 1), ("Weekly Diamond Pass", True, True, False, False, False, 0), ("Mobile Legends - Weekly Diamond Pass 2x", True, True, False, False, False, 0), ("Starlight Member Plus MLBB", True, True, False, False, False, 0), ("Weekly Diamond Pass hari ini", False, False, False, False, False, 0),
    ("5 ucxyz", False, False, False, False, False, 0), ("12 Diamonds (11 + 1 Bonus Diamonds)", False, False, True, False, False, 2), ("Pilih 5 Diamonds", False, False, True, True, False, 1), ("beli diamond atau membership", False, False, True, True, False, 0), ("please select the right pass", False, False, True, True, False, 0),
    ("Rp 20 ribu", False, False, True, False, True, 0), ("idr 5k", False, False, True, False, True, 0), ("Rp 20 ribuku", False, False, False, False, False, 0), ("86 Diamonds dan 172 Diamonds", False, False, True, False, False, 2), ("Paket hemat: dapatkan 5 Diamonds", False, False, True, False, False, 1), ("paketku: dapatkan 5 UC", True, False, False, False, False, 1),
    ("untuk kamu yang main tiap hari ada 5 UC", False, False, True, False, False, 1), ("di toko ini setiap pemain yang rajin bisa cepat mendapatkan banyak robux", False, False, True, False, False, 0), ("di toko ini setiap hari kamu bisa main terus tanpa henti", False, False, True, False, False, 0), ("Top Up 5 Diamonds sekarang juga di toko kami", False, False, True, False, False, 1), ("promo", False, False, False, False, False, 0), ("Rp 5.000", False, False, False, False, False, 0), ("", False, False, False, False, False, 0),
    ("100 + 10 Bonus Coins", True, False, False, False, False, 1),
], lambda df: df.withColumns({"product": text.is_product(T()), "named": text.is_named_package(T()), "marketing": text.is_marketing(T()), "instruction": text.is_instruction(T()), "rounded": text.is_rounded_price(T()), "amounts": text.counted_products(T()).cast("bigint")}))
_cases("text_cases", "t string", "split VARCHAR, folded VARCHAR, decoded VARCHAR", [
    ("Pokémon Café", "poke mon cafe", "pokemon cafe", "Pokémon Café"), ("Škoda Žižka", "s koda z iz ka", "skoda zizka", "Škoda Žižka"), ("ﬁne Ａ１", "fine a1", "fine a1", "ﬁne Ａ１"), ("ǎ ő ă", "a o a", "a o a", "ǎ ő ă"), ("Straße", "stra e", "stra e", "Straße"),
    ("&#38;lt; &#x27;x&#X41;", "38 lt x27 x x41", "38 lt x27 x x41", "< 'xA"), ("&#128512;&copy;&AMP;", "128512 copy amp", "128512 copy amp", "😀&copy;&"), ("&#55296;&#0099;", "55296 0099", "55296 0099", "&#55296;c"), (None, "", "", None),
], lambda df: df.withColumns({"split": text.normalized(T()), "folded": text.normalized(T(), "fold"), "decoded": text.decoded(T())}))

_cases("network_codes", "code string, message string", "network VARCHAR", [
    ("ENOTFOUND", None, "NETWORK_DNS_ERROR"), (None, "getaddrinfo failed", "NETWORK_DNS_ERROR"), (None, "the dns server", "NETWORK_DNS_ERROR"), (None, "dnsmasq", "NETWORK_FETCH_FAILED"), ("econnreset", "", "NETWORK_CONNECTION_ERROR"), ("", "Socket hang up", "NETWORK_CONNECTION_ERROR"), ("CERT_HAS_EXPIRED", "", "NETWORK_TLS_ERROR"), ("", "bad certificate", "NETWORK_TLS_ERROR"), ("ETIMEDOUT", "", "NETWORK_CONNECT_TIMEOUT"), ("", "timed out", "NETWORK_CONNECT_TIMEOUT"), ("X", "y", "NETWORK_FETCH_FAILED"), ("ETIMEDOUT", "dns", "NETWORK_DNS_ERROR"),
], _column("network", lambda: failures.network_code(F.col("code"), F.col("message"))))
_cases("failure_ladder", "code string, message string, status int, reason string", "status_code VARCHAR, detail_code VARCHAR, http_status INT, retryable BOOLEAN", [
    ("MAINTENANCE", "Rp", None, None, "MAINTENANCE", "MAINTENANCE", None, False), ("region_unavailable", None, 302, "locale_redirect", "REGION_UNAVAILABLE", "LOCALE_REDIRECT", 302, False), ("DYNAMIC_PRICE_REQUIRED", None, 403, None, "DYNAMIC_PRICE_REQUIRED", "DYNAMIC_PRICE_REQUIRED", 403, False),
    ("CANDIDATE_BLOCKED", None, None, None, "CANDIDATE_BLOCKED", "CANDIDATE_BLOCKED", 403, False), ("DISCOVERY_BLOCKED", None, 451, None, "DISCOVERY_BLOCKED", "DISCOVERY_BLOCKED", 451, False), (None, "HTTP 403 Forbidden", None, None, "ACCESS_BLOCKED", "HTTP_403", 403, False), ("ACCESS_BLOCKED", None, None, None, "ACCESS_BLOCKED", "ACCESS_BLOCKED", None, False),
    ("", "too many requests", None, None, "RATE_LIMITED", "RATE_LIMITED", 429, True), (None, None, 429, None, "RATE_LIMITED", "RATE_LIMITED", 429, True), (None, "getaddrinfo ENOTFOUND", None, None, "NETWORK_ERROR", "NETWORK_DNS_ERROR", None, True), (None, "TLS handshake socket", None, None, "NETWORK_ERROR", "NETWORK_TLS_ERROR", None, False),
    (None, "socket hang up", None, None, "NETWORK_ERROR", "NETWORK_CONNECTION_ERROR", None, True), (None, "Connect Timeout Error", None, None, "NETWORK_ERROR", "NETWORK_CONNECT_TIMEOUT", None, True), (None, "Timeout", 504, None, "TIMEOUT", "TIMEOUT", 504, True), ("PAGE_NOT_VERIFIED", None, None, None, "PAGE_NOT_VERIFIED", "PAGE_NOT_VERIFIED", None, False),
    ("PARSER_FAILED", None, None, "html_no_product", "PARSER_FAILED", "HTML_NO_PRODUCT", None, False), (None, "Harga tidak ditemukan", None, None, "PARSER_FAILED", "UNSUPPORTED_STRUCTURE", None, False), ("NOT_CONFIGURED", None, None, None, "NOT_CONFIGURED", "NOT_CONFIGURED", None, False), (None, None, 410, None, "PAGE_NOT_FOUND", "PAGE_NOT_FOUND", 410, False),
    ("HTTP_ERROR", None, 502, None, "UPSTREAM_ERROR", "HTTP_ERROR", 502, True), (None, "fetch failed", None, None, "NETWORK_ERROR", "NETWORK_FETCH_FAILED", None, True), ("ODD", "what", None, None, "UNKNOWN_ERROR", "ODD", None, False), (None, None, 418, None, "UNKNOWN_ERROR", "UNKNOWN_ERROR", 418, False), (None, "http 404 later", 0, None, "PAGE_NOT_FOUND", "PAGE_NOT_FOUND", 404, False),
], lambda df: df.select("case", failures.classified(F.col("code"), F.col("message"), F.col("status"), F.col("reason")).alias("s")).select("case", "s.*"))
_cases("converted_errors", "code string, phase string", "converted VARCHAR", [("access_blocked", "guessed", "CANDIDATE_BLOCKED"), ("ACCESS_BLOCKED", "discovery", "DISCOVERY_BLOCKED"), ("ACCESS_BLOCKED", "direct", "ACCESS_BLOCKED"), ("TIMEOUT", "guessed", "TIMEOUT")], _column("converted", lambda: failures.converted(F.col("code"), F.col("phase"))))

_cases("page_bits", "t string", "bundle BOOLEAN, abbreviation VARCHAR, initials VARCHAR", [
    ("/static/app.css", True, "/", "/"), ("https://a.b/x.js?v=1", True, "H", "H"), ("https://www.googletagmanager.com/gtag.js", False, "H", "H"), ("weekly diamond  pass for all", False, "WDPF", "WD"), ("Duniagames", False, "D", "DG"), ("Lapak Gaming", False, "LG", "L"), ("x.json", False, "X", "X"),
], lambda df: df.withColumns({"bundle": pages.is_bundle(T()), "abbreviation": pages.abbreviation(T()), "initials": pages.initials(T())}))
_cases("settings", "t string", "number DOUBLE, switch BOOLEAN", [("5", 5.0, False), ("99", 20.0, False), ("-1", 1.0, False), ("x", 8.0, False), (None, 8.0, True), ("TRUE", 8.0, True), ("NaN", 8.0, False), ("yes", 8.0, False)], lambda df: df.withColumns({"number": pages.bounded(T(), 8.0, 1.0, 20.0), "switch": pages.enabled(T(), True)}))
_cases("times_ago", "seconds bigint", "shown VARCHAR", [(-5, "baru saja"), (7, "baru saja"), (8, "8 detik lalu"), (59, "59 detik lalu"), (60, "1 menit lalu"), (7199, "119 menit lalu")], _column("shown", lambda: pages.ago(F.timestamp_seconds(F.lit(10**9) - F.col("seconds")), F.timestamp_seconds(F.lit(10**9)))))
_cases("shared_units", "units array<string>", "shared BOOLEAN", [([" Diamonds "], True), (["UC", "gold"], True), (["UC"], False), ([], False), (None, False)], _column("shared", lambda: pages.has_ambiguous_unit(F.col("units"))))
_cases("json_scripts", "t string", "price VARCHAR", [('<!-- {"price": 5} -->', "5"), ('{&quot;price&quot;: 7}', "7"), ("{bad", None), ("", None), ('[{"price": 1}]', None)], _column("price", lambda: F.try_variant_get(pages.json_document(T()), "$.price", "string")))

_PAGE = "<h1>Top Up</h1><p>99 Diamonds</p><p>Rp 1</p><p>Pilih Nominal Top Up</p><p>5 Diamonds</p><p>Dari</p><p>Rp. 1.423</p><p>Rp. 1.575</p><p>Weekly Diamond Pass</p><p>baru</p><p>Rp 28.000</p><p>Twilight Pass</p><p>Rp 149.000</p><p>12 Diamonds</p><p>Pilih metode</p><p>Rp 9 ribu</p><p>Rp. 3.323</p><p>70 Diamonds</p><p>71 Diamonds</p><p>Rp. 19.000</p><p>5 diamonds</p><p>Rp 1.423</p><p>Pilih pembayaran</p><p>80 Diamonds</p><p>Rp 5</p>"
#: Where a store's list of packages begins and ends, and how far from a package its price may stand.
SLICES = {"codashop": 7, "unipin": 10, "lapakgaming": 5, "duniagames": 8}


def page_offers(spark, sf):
    """Offers of a page's list of packages, at the distance of each of the stores that are read by lines."""
    rows = lines.page_lines(spark.createDataFrame([(1, _PAGE), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string"))
    cut = lines.slice_lines(rows, "(?i)pilih nominal", "(?i)pilih pembayaran")
    found = [lines.line_offers(cut, d).withColumn("store", F.lit(s)) for s, d in {**SLICES, "nearest": 1}.items()]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.select("store", "page_id", "original_name", "final_price")


_FOUND = [("5 Diamonds", 1423), ("Twilight Pass", 149000), ("12 Diamonds", 3323), ("71 Diamonds", 19000)]
QUERIES["page_offers"] = page_offers
ORACLES["page_offers"] = "SELECT store, CAST(1 AS BIGINT) AS page_id, original_name, CAST(final_price AS BIGINT) AS final_price FROM (VALUES " + ", ".join(f"('{s}', '{n}', {p})" for s in [*SLICES, "nearest"] for n, p in (_FOUND if s != "nearest" else [("Twilight Pass", 149000), ("71 Diamonds", 19000), ("5 diamonds", 1423)])) + ") v(store, original_name, final_price)"


def unit_price_pairs(spark, sf):
    rows = [(1, ["5 UC", "a", "b", "c", "d", "Rp 5.000"]), (2, ["5 UC", "a", "b", "c", "d", "e", "Rp 5.000"]), (3, ["UC mulai Rp 5.000"]), (4, ["Rp 5.000", "5 UC"]), (5, ["UC Rp 9"])]
    df = spark.createDataFrame(rows, "page_id long, l array<string>").select("page_id", F.posexplode("l").alias("pos", "line"))
    return lines.unit_near_price(df, text.contains_phrase(text.normalized(F.col("line")), F.lit("uc")))


QUERIES["unit_price_pairs"] = unit_price_pairs
ORACLES["unit_price_pairs"] = "SELECT CAST(p AS BIGINT) AS page_id, paired FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, true)) v(p, paired)"


def clean_offers(spark, sf):
    rows = [(1, 0.99, "$0.99", "Harga Rp"), (2, 150.0, "150", "prices in IDR"), (3, 150.0, "Rp150", "usd"), (4, 150.0, "150", "usd"), (5, 150.0, None, None), (6, None, "Rp 5", "Rp")]
    return offers.sanitized(spark.createDataFrame(rows, "id long, final_price double, price_text string, page string"), "page").select("id")


def live_offers(spark, sf):
    rows = [(1, "json", None, None), (2, "", "card", "own"), (3, None, "", "")]
    df = spark.createDataFrame(rows, "id long, source string, extraction_source string, access_strategy string")
    return offers.as_live(df, "dedicated").withColumn("kind", F.lit("kept")).union(offers.as_live(df, "dynamic", replace=True).withColumn("kind", F.lit("replaced")))


def registry_rows(spark, sf):
    """Stores with overrides, and adapters of which one is not registered."""
    stores = spark.createDataFrame([("a", "top", "ok", {"x": 1, "y": 2}), ("b", "low", "no", None)], "store_id string, category string, verification string, limits map<string,int>")
    over = spark.createDataFrame([("a", "new", {"y": 5})], "store_id string, category string, limits map<string,int>")
    whole = offers.overridden(stores, over)
    found = offers.registered(spark.createDataFrame([("a",), ("b",), ("c",)], "store_id string"), whole)
    limits = whole.select("store_id", F.map_entries("limits").alias("e"))
    shown = F.array_join(F.array_sort(F.transform("e", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return found.join(limits, "store_id", "left").select("store_id", "category", "verification", shown.alias("limits"))


def configured_pages(spark, sf):
    games = spark.createDataFrame([("ml", {"a": "https://a/ml", "b": ""}), ("ff", {}), ("gi", None)], "game_id string, stores map<string,string>")
    return offers.store_pages(games, spark.createDataFrame([("a",), ("b",)], "store_id string"))


QUERIES |= {"clean_offers": clean_offers, "live_offers": live_offers, "registry_rows": registry_rows, "configured_pages": configured_pages}
ORACLES |= {
    "clean_offers": "SELECT CAST(id AS BIGINT) AS id FROM (VALUES (2), (3)) v(id)",
    "live_offers": "SELECT CAST(id AS BIGINT) AS id, 'live' AS source, e AS extraction_source, a AS access_strategy, k AS kind FROM (VALUES (1, 'json', 'dedicated', 'kept'), (2, 'card', 'own', 'kept'), (3, 'dedicated', 'dedicated', 'kept'), (1, 'json', 'dynamic', 'replaced'), (2, 'card', 'dynamic', 'replaced'), (3, 'dynamic', 'dynamic', 'replaced')) v(id, e, a, k)",
    "registry_rows": "SELECT * FROM (VALUES ('a', 'new', 'ok', 'x=1,y=5'), ('b', 'low', 'no', NULL), ('c', 'partner', 'feed', NULL)) v(store_id, category, verification, limits)",
    "configured_pages": "SELECT * FROM (VALUES ('ml', 'a', 'https://a/ml', NULL), ('ml', 'b', '', 'NOT_CONFIGURED'), ('ff', 'a', NULL, 'NOT_CONFIGURED'), ('ff', 'b', NULL, 'NOT_CONFIGURED'), ('gi', 'a', NULL, 'NOT_CONFIGURED'), ('gi', 'b', NULL, 'NOT_CONFIGURED')) v(game_id, store_id, url, code)",
}
