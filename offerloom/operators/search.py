"""The search from end to end: what users typed, to groups of offers by price and what each store answered."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.operators import games, resolve, scan
from offerloom.operators.offers import group_offers, with_fallback
from offerloom.sources.tables import kept


def found_games(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query, game_id, score): the game that each typed text means, by all names a game goes by; texts that mean none are left out."""
    names = games.identities(registry).select(F.col("game_id").alias("entry"), F.col("identity").alias("phrase"), F.col("place").alias("registry_order"))
    return resolve.resolve(queries, names).select("query", F.col("entry").alias("game_id"), "score")


def search(queries: DataFrame, registry: DataFrame, stores: DataFrame, pages: DataFrame, strategies: DataFrame, catalog: DataFrame, offset: int = 0, limit: int = 8, extractors: Mapping[str, scan.Extractor] = scan.EXTRACTORS) -> tuple[DataFrame, DataFrame]:
    """(groups, answers) of the games that the queries mean, at a page of the stores.

    registry: games; stores: store_id, store_name, place; pages: page_id,
    store_id, game_id, html; strategies: store_id, stage, strategy; catalog:
    offers that stand in where a store has no live one. groups: game_id, place
    (by price) and the columns of group_offers; answers: game_id, store_id, mode
    (`live`, `fallback` or `none`) and its number of offers. A game is searched
    once however many queries mean it.
    """
    # What several results start from is worked out once.
    wanted = kept(found_games(queries, registry).select("game_id").distinct())
    chosen = kept(stores.orderBy("place").offset(max(0, offset)).limit(min(20, max(1, limit))).select("store_id", "store_name", F.col("place").alias("_store")))  # 20 rows at most
    # A semi-join on what has few rows is done before pages are built and before the catalogue is spread over all stores.
    of_chosen = lambda df: df.join(F.broadcast(chosen.select("store_id")), "store_id", "left_semi")
    asked = kept(of_chosen(pages).join(wanted, "game_id", "left_semi").join(F.broadcast(chosen), "store_id").select("page_id", "store_id", "store_name", "game_id", "_store", "html"))
    read = kept(scan.by_strategy(asked.select("page_id", "store_id", "html"), strategies, extractors))
    live = read.join(asked.select("page_id", "store_id", "store_name", "game_id", "_store"), "page_id").withColumn("source", F.lit("live"))
    own = games.offers_of_game(live, registry).withColumn("arrival_seq", F.struct(F.lit(0).alias("kind"), F.col("_store").cast("long").alias("store"), F.col("page_id").cast("long").alias("page"), F.col("pos").cast("long").alias("pos")))
    columns = ["game_id", "store_id", "store_name", "original_name", "final_price", "source", "arrival_seq"]
    spare = of_chosen(catalog).join(wanted, "game_id", "left_semi").join(F.broadcast(chosen.drop("store_name")), "store_id").withColumns({"source": F.lit("fallback"), "arrival_seq": F.struct(F.lit(1).alias("kind"), F.col("_store").cast("long").alias("store"), F.lit(0).cast("long").alias("page"), F.col("seq").cast("long").alias("pos"))}).select(*columns)
    # A store stands for its game: it may have live offers of one game and need the catalogue for another.
    pair = lambda df: df.withColumnRenamed("store_id", "_id").withColumn("store_id", F.struct("game_id", "_id"))
    pairs = wanted.join(F.broadcast(chosen)).select(F.struct("game_id", F.col("store_id").alias("_id")).alias("store_id"))
    together = kept(with_fallback(pair(kept(own.select(*columns))), pair(spare), pairs).withColumn("store_id", F.col("_id")).drop("_id"))
    groups = group_offers(together)
    place = F.row_number().over(Window.partitionBy("game_id").orderBy("cheapest_price", "canonical_key"))
    count = together.groupBy("game_id", "store_id").agg(F.first("source").alias("mode"), F.count("*").alias("offers"))
    answers = pairs.select("store_id.game_id", F.col("store_id._id").alias("store_id")).join(count, ["game_id", "store_id"], "left").select("game_id", "store_id", F.coalesce("mode", F.lit("none")).alias("mode"), F.coalesce("offers", F.lit(0)).cast("bigint").alias("offers"))
    return groups.withColumn("place", place), answers
