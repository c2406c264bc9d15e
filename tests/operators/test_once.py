"""What a column costs is paid once a row: plans don't repeat it in the filters above it."""

from pyspark.sql import functions as F

from offerloom.functions import money
from offerloom.operators import payloads, serialized, structured


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_objects_of_scripts_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, 'f({"name":"5 UC","price":"900"});f({"name":"7 UC"})')], "page_id long, body string").repartition(1)
    found = serialized.flat_objects(rows, "body", ["page_id"]).filter(F.char_length("name") > 2)
    assert _plan(found).count("parsejson") == 1
    assert [(r.name, r.price_text) for r in found.collect()] == [("5 UC", "900")]


def test_rows_of_payloads_are_read_once(spark):
    docs = spark.createDataFrame([(1, '[{"name":"a","price":"Rp 900"},{"title":"b"}]')], "id long, t string").repartition(1).select("id", F.parse_json("t").alias("v"))
    offers = _plan(payloads.payload_offers(docs, "id"))
    assert offers.count("sellprice") <= 4  # the row's price, the score at known places for either kind of payload, that of other arrays
    assert _plan(payloads.best_arrays(docs, "id")).count("sellprice") == 1
    assert [tuple(r) for r in payloads.payload_offers(docs, "id").collect()] == [(1, 0, "a", 900)]


def test_documents_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, '<script type="application/json">{"name":"5 UC","price":7}</script>')], "page_id long, html string").repartition(1)
    docs = structured.documents(rows)
    assert _plan(docs).count("parsejson") == 1 and docs.count() == 1


def test_prices_in_arrays_name_their_patterns_once(spark):
    rows = spark.createDataFrame([("Rp 1.500 dulu Rp 2.000",)], "t string").repartition(1)
    named = lambda c: _plan(rows.select(c)).count("regexp_replace")
    one = named(money.rupiah(F.col("t")))
    assert named(money.first_strict(F.col("t"))) <= 2 * one and named(money.structured(F.col("t"))) <= 2 * one


def test_texts_without_escapes_pass_no_patterns(spark):
    rows = spark.createDataFrame([("a\\u0026b\\x3cp\\x3e\\nc<br/>d<i>e", "a&b \n\nc\nd e"), ("plain 5 UC", "plain 5 UC"), (None, None)], "t string, want string").repartition(1)
    out = rows.select(serialized.serialized(F.col("t")).alias("got"), "want")
    assert [r.got.replace(" ", "") if r.got else r.got for r in out.collect()] == [w.replace(" ", "") if w else w for w in ("a&b\nc\nde", "plain 5 UC", None)]
    assert _plan(out).count("contains") >= 4  # asked before any of them, of escapes, tags and entities


def test_products_meet_prices_within_their_document(spark):
    """every object was a row and was sent by its path to meet its price."""
    body = '{"l":[{"name":"5 UC","x":{"y":{"price":3}},"variants":[{"note":1},{"price":"0.4","finalPrice":8,"offers":{"price":9}},{"price":"Rp 7"}],"offer":{"offers":{"offer":{"price":4}}}},{"name":"shop","price":2,"offers":{"price":1}},{"title":"6 UC","price":[1],"offers":{"offer":{"offers":{"offer":{"price":4}}}}}]}'
    rows = spark.createDataFrame([(1, f'<script type="application/json">{body}</script>')], "page_id long, html string")
    found = structured.structured_offers(structured.documents(rows))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(("/".join(s.key or str(s.pos) for s in r.path), r.original_name, r.final_price) for r in found.collect())
    inner = ["l/0", "l/0/offer", "l/0/offer/offers", "l/0/offer/offers/offer"]
    own = [("l/0/variants/1", 4), ("l/0/variants/1/offers", 9), ("l/0/variants/2", 7), ("l/0/x/y", 3), *((f"l/2/{p}", 4) for p in ("offers", "offers/offer", "offers/offer/offers", "offers/offer/offers/offer"))]
    assert got == sorted([(p, "5 UC", 4) for p in inner] + [(p, "6 UC" if p[2] == "2" else "5 UC", n) for p, n in own])
