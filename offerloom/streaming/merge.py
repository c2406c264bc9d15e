"""Groups of offers kept up to date as batches of offers arrive, in any order and more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.offers import group_offers

UNIQUE = ["game_id", "store_id", "original_name", "final_price"]


def _first_arrived(rows: DataFrame) -> DataFrame:
    """The first to have arrived of each store, name and price. Prices lead, as sorting tells them apart at one look."""
    rest = [c for c in rows.columns if c not in (*UNIQUE, "arrival_seq")]
    return rows.groupBy("final_price", *UNIQUE[:-1]).agg(F.min(F.struct("arrival_seq", *rest)).alias("_r")).select(*UNIQUE, "_r.*").select(rows.columns)


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State and batch with one offer per store, name and price: the first to have arrived.

    The batch is reduced by itself, so that it lies by the same keys as a state
    that was merged before and the state stays where it is.
    """
    return _first_arrived(state.unionByName(_first_arrived(batch)))


def stream_groups(offers: DataFrame, table: str, checkpoint: str, spark: SparkSession):
    """Start a query that merges each micro-batch of offers into tables `<table>_0` and `<table>_1` by turns.

    A batch writes the table of its parity from the other one, so a batch that
    is run again after a failure reads what it read before.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        old, new = f"{table}_{(number + 1) % 2}", f"{table}_{number % 2}"
        own = batch.select(*offers.columns)
        state = merged(spark.table(old), own) if number and spark.catalog.tableExists(old) else merged(own.limit(0), own)
        state.write.mode("overwrite").saveAsTable(new)

    return offers.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_groups(spark: SparkSession, table: str, last_batch: int) -> DataFrame:
    return group_offers(spark.table(f"{table}_{last_batch % 2}"))
