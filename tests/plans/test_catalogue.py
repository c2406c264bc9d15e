import duckdb
import pytest

from offerloom.plans import catalogue

SF = "/root/testdata/sf0.001"
FAST = ["group_offers", "canonicalize_names", "cheapest_offers", "dedupe_first", "fallback_union", "fallback_price", "game_resolution", "provider_summary", "error_priority", "strategy_chain", "candidate_fold", "nearest_following", "feed_products", "html_lines", "line_slice", "scoped_lines", "page_links", "url_parts", "normalize_text", "product_lines", "assigned_documents", "page_values", "fragment_offers", "serialized_offers", "number_words", "payload_offers", "best_arrays", "page_crawl", "price_texts", "line_kinds", "package_names", "structured_offers", "offers_of_game", "page_evidence", "scanned_offers", "page_reasons", "probe_budget", "title_resolution", "page_states", "page_sections", "facet_labels", "sitemap_urls"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(catalogue.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr) == want
