"""Groups of offers as keyed state: a batch touches the groups that it has offers of, and no others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from offerloom.functions.names import packages

KEY = ["game_id", "canonical_key"]
# Types are built by hand: workers have no session to read a DDL string with.
_OFFER = StructType([StructField("store_id", StringType()), StructField("original_name", StringType()), StructField("final_price", LongType())])
_SEEN = StructType([StructField("arrival_seq", LongType()), StructField("store_name", StringType())])
GROUP = "game_id string, canonical_key string, cheapest_price long, cheapest_store string, highest_price long, savings long, store_count long, offer_count long"


class Groups(StatefulProcessor):
    """One group's offers, each store's name and price once (as it first arrived), and its figures after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.offers = handle.getMapState("offers", _OFFER, _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                own = (r.store_id, r.original_name, int(r.final_price))
                if not self.offers.containsKey(own) or int(r.arrival_seq) < self.offers.getValue(own)[0]:
                    self.offers.updateValue(own, (int(r.arrival_seq), r.store_name))
        held = [(offer[2], seen[1], seen[0], offer[0]) for offer, seen in self.offers.iterator()]
        cheapest, highest = min(held, key=lambda h: (h[0], h[1] or "", h[2])), max(h[0] for h in held)
        yield pd.DataFrame([(*key, cheapest[0], cheapest[1], highest, highest - cheapest[0], len({h[3] for h in held}), len(held))], columns=[c.split(" ")[0] for c in GROUP.split(", ")])


def keyed_groups(offers: DataFrame) -> DataFrame:
    """A streaming DataFrame of the groups that each batch of offers changed, with their figures so far.

    offers: a stream of game_id, store_id, store_name, original_name,
    final_price, arrival_seq; prices that are null or nothing go. Each group's
    state is kept by its key, so the work follows the batch and the groups it
    meets; a restart goes on from the checkpoint. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    rows = packages(offers.filter("final_price > 0 and game_id is not null")).selectExpr(*KEY, "cast(store_id as string) as store_id", "store_name", "coalesce(original_name, '') as original_name", "cast(final_price as long) as final_price", "cast(arrival_seq as long) as arrival_seq")
    return rows.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=Groups(), outputStructType=StructType.fromDDL(GROUP), outputMode="Update", timeMode="None")
