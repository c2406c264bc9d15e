"""Lines of a page in one row: cut and priced without a window over lines."""

from pyspark.sql import functions as F

from offerloom.operators import lines

PAGE = "<p>5 UC</p><p>Rp 1</p><p>Pilih Nominal</p><p>5 Diamonds</p><p>Dari</p><p>Rp. 1.423</p><p>Rp. 1.575</p><p>Weekly Pass</p><p>Dari</p><p>Rp 9</p><p>7 UC Rp 3.000</p><p>8 UC</p><p>Rp 20 ribu</p><p>IDR 5,000.50</p><p>5 Diamonds</p><p>Rp 1423</p><p>9 UC</p><p>a</p><p>b</p><p>c</p><p>Rp 7</p><p>6 UC</p><p>Pilih pembayaran</p><p>Rp 4</p>"


def test_lists_are_cut_as_rows_are(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>a</p><p>pilih pembayaran</p><p>pilih nominal</p>"), (4, "<p>x</p><p>pilih pembayaran</p><p>y</p>"), (5, "<script>pilih nominal</script>"), (6, "<p>pilih nominal</p><p>z \t z</p>")], "page_id long, html string")
    marks = "(?i)pilih nominal", "(?i)pilih pembayaran"
    want = lines.slice_lines(lines.page_lines(pages), *marks).select("page_id", "pos", "line")
    got = lines.listed(pages, *marks).select("page_id", F.inline("lines"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_products_meet_the_next_price(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = lines.listed(pages, "(?i)pilih nominal", "(?i)pilih pembayaran")
    got = lines.list_offers(rows, 3)
    assert sorted((r.pos, r.original_name, r.final_price, r.price_text) for r in got.collect()) == [(3, "5 Diamonds", 1423, "Rp. 1.423"), (10, "7 UC Rp 3.000", 3000, "7 UC Rp 3.000"), (11, "8 UC", 5000, "IDR 5,000.50")]
    again = lines.line_offers(lines.slice_lines(lines.page_lines(pages), "(?i)pilih nominal", "(?i)pilih pembayaran"), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") == 1  # that of equal names
