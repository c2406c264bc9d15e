from pyspark.sql import functions as F

from offerloom.functions import states
from offerloom.operators import lines, offers, scan, search, sitemaps


def test_sections(spark):
    rows = [(1, k, t) for k, t in enumerate(["a", "b", "c", "MLBB", "x", "Other Games", "y"])] + [(2, 0, "MLBB"), (3, 0, "none"), (4, 0, "rekomendasi"), (4, 1, "MLBB")] + [(5, k, "MLBB" if k == 1 else "z") for k in range(120)]
    got = lines.section(spark.createDataFrame(rows, "page_id int, pos int, line string"), F.contains("line", F.lit("MLBB")))
    found = {}
    for r in got.collect():
        found.setdefault(r.page_id, set()).add(r.pos)
    assert found == {1: {1, 2, 3, 4}, 2: {0}, 4: {0, 1}, 5: set(range(91))}


def test_states_of_odd_pages(spark):
    none = F.array().cast("array<string>")
    df = spark.createDataFrame([(None,), ("",), ("MLBB under maintenance and product unavailable",), ("pilih produk mlbb",), ("pilih produk mlbbx",)], "t string")
    state = states.page_state(F.lit("x"), F.col("t"), F.lit(None).cast("string"), F.array(F.lit("mlbb"), F.lit("gi")), none, F.lit("/id/"))
    assert [r[0] and r[0]["code"] for r in df.select(state).collect()] == [None, None, "MAINTENANCE", "DYNAMIC_PRICE_REQUIRED", None]


def test_facets_of_units_that_names_say(spark):
    rows = [("g", "currency", "Item", "5 Opals here"), ("g", "currency", "Item", "5"), ("g", "currency", "CP", "5 CP"), ("g", "odd-type", "Item", "odd-name"), ("g", None, None, None), ("g", "other", "Item", "z"), ("g", "weekly-pass", "Item", "z")]
    got = offers.labelled_facets(spark.createDataFrame(rows, "game_id string, package_type string, unit string, name string"), ["game_id"]).orderBy("place").collect()
    assert [(r.facet, r.label, r.groups) for r in got] == [("currency:cp", "Call of Duty Points (CP)", 1), ("currency:nominal", "Nominal", 1), ("currency:opals", "Opals", 1), ("weekly-pass", "Weekly Diamond Pass", 1), ("odd-type", "odd name", 1), ("other", "Lainnya", 2)]


def test_sitemaps(spark):
    root = "https://s.id"
    xml = {
        f"{root}/sitemap.xml": "<loc>/sitemap-a.xml</loc><loc> https://s.id/sitemap-games.xml </loc><loc>/mobile-legends</loc>",
        f"{root}/sitemap-games.xml": "<loc><![CDATA[x]]></loc><loc>/g/mobile-legends?a=1&amp;b=2</loc><loc>/login/mobile-legends</loc><loc>/g/mobile-legends?a=1&amp;b=2</loc>",
        f"{root}/sitemap_index.xml": "<loc>/late/mobile-legends</loc>",
    }
    maps = spark.createDataFrame([*xml.items(), ("https://t.id/sitemap.xml", None), ("https://t.id/sitemap_index.xml", "<loc>/mobile-legends</loc>")], "url string, xml string")
    stores = spark.createDataFrame([(1, "https://s.id/x", "mobile legends"), (2, "https://t.id", "mobile legends"), (3, "none", "mobile legends"), (4, "https://u.id", "mobile legends")], "store_id int, homepage string, identity string")
    got = {(r.store_id, r.url, r.place) for r in sitemaps.discovered(stores, maps).collect()}
    assert got == {(1, f"{root}/mobile-legends", 1), (1, f"{root}/g/mobile-legends?a=1&b=2", 2), (2, "https://t.id/mobile-legends", 1)}


def test_search_of_nothing_and_of_one(spark):
    registry = spark.createDataFrame([("ml", 1, "Mobile Legends", "MLBB", None, ["Diamonds"])], "game_id string, place int, name string, short_name string, aliases array<string>, unit_aliases array<string>")
    stores = spark.createDataFrame([(k, f"s{k}", k) for k in (1, 2, 3)], "store_id long, store_name string, place long")
    pages = spark.createDataFrame([(10, 1, "ml", "<p>5 Diamonds</p><p>Rp 900</p><p>5 UC</p><p>Rp 1</p>"), (20, 2, "ml", None)], "page_id long, store_id long, game_id string, html string")
    strategies = spark.createDataFrame([(1, 0, "lines"), (2, 0, "lines")], "store_id long, stage int, strategy string")
    catalog = spark.createDataFrame([("ml", 1, "s1", "9 Diamonds", 5, 0), ("ml", 2, "s2", "5 Diamonds", 1000, 1)], "game_id string, store_id long, store_name string, original_name string, final_price long, seq long")
    run = lambda typed: search.search(spark.createDataFrame([(t,) for t in typed], "query string"), registry, stores, pages, strategies, catalog, extractors={"lines": scan.from_lines})
    groups, answers = run(["mlbb", "mobile legend", "zzz", ""])
    assert [(r.place, r.name, r.cheapest_price, r.highest_price, r.store_count) for r in groups.collect()] == [(1, "5 Diamonds", 900, 1000, 2)]
    assert sorted((r.store_id, r.mode, r.offers) for r in answers.collect()) == [(1, "live", 1), (2, "fallback", 1), (3, "none", 0)]
    groups, answers = run([])
    assert groups.count() == 0 and answers.count() == 0
