from pyspark.sql import functions as F

from offerloom.functions import money, names, text
from offerloom.operators import lines, offers

SCHEMA = "game_id string, store_id string, store_name string, original_name string, final_price long, source string, arrival_seq long"


def test_amounts_types_and_keys(spark):
    rows = [("85 Diamonds (77 + 8 Bonus)",), ("77 Diamonds + 8 Bonus",), ("Weekly Diamond Pass",), ("300 + 30 Genesis Crystals",), ("1,000 UC",), ("1.5 UC",), ("80 Call of Duty Points",), ("Weekly Diamond Pass x2",), ("Weekly Diamond Pass 2x",), (None,)]
    got = names.packages(spark.createDataFrame(rows, "original_name string")).collect()
    assert [r.total_amount for r in got[:7]] == [85, 85, None, 330, 1000, 15, None]
    assert got[0].canonical_key == got[1].canonical_key and got[2].package_type == "weekly-pass" and got[6].package_type == "other"
    assert [got[k].multiplier for k in (7, 8)] == [2, 1] and got[9].canonical_key == "other:"


def test_cheapest_offer_leads_its_group(spark):
    rows = [("g", "a", "mahal", "85 Diamonds", 25000, "live", 1), ("g", "b", "murah", "77 Diamonds + 8 Bonus", 22000, "live", 2), ("g", "c", "c", "85 Diamonds", 0, "live", 3)]
    (group,) = offers.group_offers(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (group.cheapest_store, group.savings, group.store_count, group.name) == ("murah", 3000, 2, "85 Diamonds")
    assert offers.group_offers(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prices(spark):
    rows = [("Rp . 21.635", 21635), ("Rp. 4.378", 4378), ("Rp 30,200", 30200), ("IDR 25.000", 25000), ("Rp 1000.00", 1000), ("86 Diamonds", None), ("1.500 Rupiah", 1500), ("Rp 7.000", 7000), (None, None)]
    df = spark.createDataFrame(rows, "t string, want long")
    assert df.filter(~money.rupiah(F.col("t")).eqNullSafe(F.col("want"))).count() == 0


def test_lines_and_nearest_price(spark):
    html = "<p>Pilih Nominal Top Up</p><p>5 Diamonds</p><p>Dari</p><p>Rp. 1.423</p><p>Rp. 1.575</p><p>12 Diamonds</p><p>(11 + 1 Bonus)</p><p>Rp. 3.323</p><p>Pilih pembayaran</p><script>x<p></script>"
    rows = lines.page_lines(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    cut = lines.slice_lines(rows, "(?i)pilih nominal", "(?i)pilih pembayaran")
    found = lines.nearest_following(cut, "page_id", ["pos"], text.is_product(F.col("line")), money.rupiah(F.col("line")), 7).orderBy("pos").collect()
    assert [(r.line, r.price) for r in found] == [("5 Diamonds", 1423), ("12 Diamonds", 3323)]
    assert [r[0] for r in spark.createDataFrame([("a<br>b<br/>c &amp;lt; &copy;",)], "h string").select(lines.lines(F.col("h"))).collect()] == [["a", "b c &lt; &copy;"]]


def test_stream_equals_batch(spark, tmp_path):
    from offerloom.streaming import merge

    rows = [("g", f"s{k % 3}", f"s{k % 3}", f"{k % 4} Diamonds", 100 + k % 5, "live", k) for k in range(40)]
    for k in range(2):
        spark.createDataFrame(rows[20 * k : 20 * k + 20] + rows[:3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k in (0, 1):
        spark.sql(f"drop table if exists merged_offers_{k}")
    query = merge.stream_groups(source, "merged_offers", str(tmp_path / "at"), spark)
    query.awaitTermination(120)
    last = query.lastProgress.batchId if query.lastProgress.numInputRows else query.lastProgress.batchId - 1
    want = offers.group_offers(merge.merged(spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)))
    got = merge.current_groups(spark, "merged_offers", last)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
