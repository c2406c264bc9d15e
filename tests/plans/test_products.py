import pytest
import product_cases as products
from test_catalogue import SF, con, plain  # noqa: F401

from offerloom.operators import games, structured


@pytest.mark.parametrize("name", list(products.QUERIES))
def test_equals_what_is_stated(spark, con, name):  # noqa: F811
    df = products.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(products.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr) == want


def test_empty_tables(spark):
    known = products._games(spark)
    offers = spark.createDataFrame([], "id long, game_id string, original_name string")
    assert games.offers_of_game(offers, known).count() == 0
    assert games.offers_of_game(spark.createDataFrame([(1, "x", "5 UC")], offers.schema), known.limit(0)).count() == 1
    assert games.page_evidence(spark.createDataFrame([], products.SIGNALS), known).count() == 0
    assert structured.structured_offers(structured.documents(spark.createDataFrame([], "page_id long, html string"))).count() == 0
