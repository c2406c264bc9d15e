"""Literal cases of structured offers, of games on pages and in offers, and of addresses.

Games are three made-up registry rows. Results are written down by hand from the
rules and share nothing with the library.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import pages
from offerloom.operators import games, structured

GAMES = [
    ("mobile-legends", 1, "Mobile Legends", "MLBB", ["ml", "Diamond", "weekly pass ml"], ["Diamond", "Diamonds"]),
    ("genshin-impact", 2, "Genshin Impact", "GI", ["genshin"], ["Genesis Crystals"]),
    ("plain-game", 3, "Plain", None, None, None),
]


def _games(spark):
    return spark.createDataFrame(GAMES, "game_id string, place int, name string, short_name string, aliases array<string>, unit_aliases array<string>")


def _ld(body: str, kind: str = "application/ld+json") -> str:
    return f'<script type="{kind}">{body}</script>'


PAGES = [
    (1, _ld('{"name": "5 Diamonds", "offers": {"price": "Rp 1.423", "url": "/x"}, "url": " /five "}')),
    (2, _ld('{"title": "Weekly Diamond Pass", "list": [{"id": 1, "price": 28000.4}, {"label": "12 Diamonds", "sellingPrice": "3,323"}]}')),
    (3, _ld('{"name": "About us", "price": 9}') + _ld('[[{"name": "1 UC", "offer": [{"x": 1}, {"variants": [{"price": 0}, {"pricing": {"lowPrice": 77}}]}]}]]', "application/json")),
    (4, _ld("{bad") + "<script>var x = {\"name\": \"5 UC\", \"price\": 5}</script>"),
    (5, '<script id="__NEXT_DATA__">{"props": {"name": 5, "product_name": "71 Diamonds", "offers": {"offer": {"offers": {"offers": {"price": 1}}}}, "price": null, "finalPrice": "IDR 19.000"}}</script>'),
    (6, _ld('{"name": "8 Tokens", "offers": {"offer": {"offers": {"offers": {"price": 1}}}}}')),
    (7, None),
]
_FOUND = [(1, "5 Diamonds", 1423, "/five"), (1, "5 Diamonds", 1423, "/x"), (2, "Weekly Diamond Pass", 28000, None), (2, "12 Diamonds", 3323, None), (3, "1 UC", 77, None), (3, "1 UC", 77, None), (3, "1 UC", 77, None), (3, "1 UC", 77, None)]
_FOUND += [(5, "71 Diamonds", 19000, None), *[(5, "71 Diamonds", 1, None)] * 4, *[(6, "8 Tokens", 1, None)] * 4]


def structured_offers(spark, sf):
    rows = spark.createDataFrame(PAGES, "page_id long, html string")
    return structured.structured_offers(structured.documents(rows)).select("page_id", "original_name", "final_price", "url")


OFFERS = [
    (1, "mobile-legends", "Mobile Legends 5 x", True),
    (2, "mobile-legends", "Genshin Impact 60 Diamonds", False),
    (3, "mobile-legends", "86 Diamonds", True),
    (4, "mobile-legends", "Twilight Pass", True),
    (5, "mobile-legends", "Welkin Moon", False),
    (6, "mobile-legends", "60 Genesis Crystals", False),
    (7, "genshin-impact", "60 genesis-crystals", True),
    (8, "genshin-impact", "Blessing of the Welkin Moon", True),
    (9, "genshin-impact", "Monthly card", True),
    (10, "plain-game", "anything", True),
    (11, "plain-game", "MLBB anything", False),
    (12, "plain-game", "  ", False),
    (13, "unknown", "thing", True),
    (14, "genshin-impact", "MLBB Genshin Impact", True),
]


def offers_of_game(spark, sf):
    rows = spark.createDataFrame([r[:3] for r in OFFERS], "id long, game_id string, original_name string")
    return games.offers_of_game(rows, _games(spark)).select("id")


SIGNALS = "page_id long, game_id string, title string, heading string, meta string, structured string, body string, url string, home string"
EVIDENCE = [
    (1, "mobile-legends", "Top Up Mobile Legends", "Diamond", None, "", "mobile legends mobile legends, mobile legends mobile legends", "https://s.id/mobile-legends", "https://s.id/", True, 120 + 55 + 20 + 100, "halaman cocok dengan game"),
    (2, "mobile-legends", "Genshin", "MLB", "mlbb", None, "MLBB", "https://s.id/g", "https://s.id", False, 75 + 25, "halaman terdeteksi sebagai Genshin Impact"),
    (3, "mobile-legends", "Home", "", "MLBB", "", "", "https://s.id//", "https://s.id", False, 75, "URL mengarah kembali ke homepage/katalog umum"),
    (4, "mobile-legends", "Shop ML", "ml", "", "", "mlbb. diamonds mlbb", "https://s.id/a", "https://s.id", True, 35 + 30 + 55 + 20, "halaman cocok dengan game"),
    (5, "mobile-legends", "", "", "", "", "mlbb. x mlbb. y mlbb", "https://s.id/a", "https://s.id", False, 70, "konten halaman tidak cukup membuktikan game yang dicari"),
    (6, "genshin-impact", "mlbb", "genshin", "", "", "", None, None, True, 110, "halaman cocok dengan game"),
    (7, "plain-game", None, None, None, "plain", None, "https://s.id/a", "https://s.id/a", True, 70, "halaman cocok dengan game"),
]


def page_evidence(spark, sf):
    return games.page_evidence(spark.createDataFrame([r[:9] for r in EVIDENCE], SIGNALS), _games(spark))


def guessed_urls(spark, sf):
    """Of two stores, one with a template of its own."""
    pairs = spark.createDataFrame([("a", "mobile-legends", "https://a.id/", ["{homepage}/id/{gameSlug}"]), ("b", "plain-game", "https://b.id", None), ("b", "genshin-impact", "none", None)], "store_id string, game_id string, homepage string, templates array<string>")
    return games.guessed_urls(pairs, _games(spark))


_COMMON = ["", "games/", "game/", "topup/", "top-up/", "top-up-game/", "product/", "products/"]
_GUESSED = [("a", "mobile-legends", f"https://a.id/{t}{s}") for s in ("mobile-legends", "mlbb") for t in ["id/", *_COMMON]]
_GUESSED_B = [("b", "plain-game", f"https://b.id/{t}{s}") for s in ("plain-game", "plain") for t in _COMMON]

DYNAMIC = [
    (1, '<div id="__next"></div><script src="/_next/x.js"></script>', "nextjs", "", True, False, True),
    (2, "<div id=\"app\"> </div> fetch('/api/v1/items') fetch(\"/graphql\") fetch('/api/v1/items')", "spa-root", "/api/v1/items|/graphql", True, False, True),
    (3, "window.__NUXT__ = {}", "nuxt", "", False, False, False),
    (4, "window.__NUXT__ = {sellingPrice: 5}", "nuxt", "", False, True, True),
    (5, "plain price `/api/abc`", "", "/api/abc", False, True, False),
    (6, None, "", "", False, False, False),
]


def dynamic_pages(spark, sf):
    df = spark.createDataFrame([r[:2] for r in DYNAMIC], "page_id long, html string").select("page_id", pages.dynamic_signals(F.col("html")).alias("s"))
    return df.select("page_id", F.array_join("s.frameworks", "|").alias("frameworks"), F.array_join("s.api_hints", "|").alias("hints"), "s.empty_shell", "s.product_words", "s.likely_dynamic")


REASONS = [
    (1, 3, 0, True, 0, 0, 0, "PRODUCTS_REJECTED_BY_GAME_VALIDATION"),
    (2, 3, 1, True, 0, 0, 0, "PARTIAL_MATCH_ONLY"),
    (3, 0, 0, True, 2, 0, 1, "JS_RENDERED_CONTENT"),
    (4, 0, 0, False, 2, 0, 1, "PRODUCT_FOUND_NO_PRICE"),
    (5, 0, 0, False, 0, 2, 1, "PRICE_FOUND_NO_PRODUCT"),
    (6, 0, 0, False, 0, 0, 1, "JSON_DATA_FOUND_NO_MATCH"),
    (7, 0, 0, False, 0, 0, 0, "HTML_NO_PRODUCT"),
    (8, 0, 0, False, 2, 2, 0, "UNSUPPORTED_STRUCTURE"),
]


def parser_reasons(spark, sf):
    df = spark.createDataFrame([r[:7] for r in REASONS], "page_id long, found int, kept int, dynamic boolean, products int, prices int, documents int")
    return df.select("page_id", pages.parser_reason(*map(F.col, ("found", "kept", "dynamic", "products", "prices", "documents"))).alias("reason"))


def _values(rows: list[tuple], columns: str) -> str:
    """SELECT of literal rows. columns: names and SQL types."""
    quoted = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    names = [c.strip().split(" ") for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names) + f" FROM (VALUES {body}) v({', '.join(n for n, _ in names)})"


QUERIES = {
    "structured_offers": structured_offers,
    "offers_of_game": offers_of_game,
    "page_evidence": page_evidence,
    "guessed_urls": guessed_urls,
    "dynamic_pages": dynamic_pages,
    "parser_reasons": parser_reasons,
}
ORACLES = {
    "structured_offers": _values(_FOUND, "page_id BIGINT, original_name VARCHAR, final_price BIGINT, url VARCHAR"),
    "offers_of_game": _values([(r[0],) for r in OFFERS if r[3]], "id BIGINT"),
    "page_evidence": _values([(r[0], r[1], *r[9:]) for r in EVIDENCE], "page_id BIGINT, game_id VARCHAR, ok BOOLEAN, score INT, reason VARCHAR"),
    "guessed_urls": _values([(*r, k) for rows in (_GUESSED, _GUESSED_B) for k, r in enumerate(rows)], "store_id VARCHAR, game_id VARCHAR, url VARCHAR, place INT"),
    "dynamic_pages": _values([(r[0], *r[2:]) for r in DYNAMIC], "page_id BIGINT, frameworks VARCHAR, hints VARCHAR, empty_shell BOOLEAN, product_words BOOLEAN, likely_dynamic BOOLEAN"),
    "parser_reasons": _values([(r[0], r[7]) for r in REASONS], "page_id BIGINT, reason VARCHAR"),
}
