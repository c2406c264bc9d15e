from pyspark.sql import functions as F

from offerloom.operators.offers import group_offers
from offerloom.streaming import keyed

SCHEMA = "game_id string, store_id string, store_name string, original_name string, final_price long, source string, arrival_seq long"


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """Batches before and after a restart, with repeats and late first arrivals, end in the groups of all offers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(f"g{k % 2}", f"s{k % 5}", f"s{k % 5}", f"{k % 4} Diamonds", 100 + k % 7, "live", k) for k in range(60)]
    rows += [("g0", "s1", "s1", "0 Diamonds", None, "live", 70), ("g0", "s9", "s9", "Twilight Pass", 50, "live", 71), (None, "s1", "s1", "x", 5, "live", 72)]
    files, out = tmp_path / "in", str(tmp_path / "out")
    seen = []

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(files))
        query = keyed.keyed_groups(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        query.foreachBatch(lambda df, n: (df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), seen.append(n))).start().awaitTermination()

    for part in (rows[:40], rows[20:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(files))
        run()
    latest = spark.read.parquet(out).groupBy("game_id", "canonical_key").agg(F.max_by(F.struct("cheapest_price", "highest_price", "savings", "store_count"), "batch").alias("g")).select("game_id", "canonical_key", "g.*")
    want = group_offers(spark.createDataFrame(rows, SCHEMA).filter("game_id is not null")).select("game_id", "canonical_key", "cheapest_price", "highest_price", "savings", "store_count")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect())) and len(seen) == 2
    second = {(r.game_id, r.canonical_key) for r in spark.read.parquet(out).filter("batch = 1").collect()}
    assert second == {(r.game_id, r.canonical_key) for r in group_offers(spark.createDataFrame(rows[20:], SCHEMA).filter("game_id is not null")).collect()}
