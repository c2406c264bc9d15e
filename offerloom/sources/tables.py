"""Reading the tables of a folder, and partner feeds of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.money import rupiah


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """df worked out once: in the folder that the cluster shares for checkpoints, or cached where none is set (lost parts are then worked out anew)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            return df.persist()
        spark.sparkContext.setCheckpointDir(given)
    return df.checkpoint()


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row though filters ask for them too: Spark puts what a column is made of into every filter above it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def feed_offers(feeds: DataFrame) -> DataFrame:
    """Offers in JSON feeds (store_id, game_id, payload): rows of the root array, of `products` or of `data`.

    Rows without a name or without a positive price go.
    """
    item = "array<struct<name:string,title:string,price:string,finalPrice:string,url:string>>"
    raw = F.coalesce(*(F.from_json(F.when(F.col("payload").rlike(r"^\s*\["), F.col("payload")).otherwise(F.get_json_object("payload", p)), item) for p in ("$.products", "$.data")))
    rows = feeds.select("store_id", "game_id", F.posexplode(raw).alias("pos", "r"))
    price = rupiah(F.coalesce(F.col("r.finalPrice"), F.col("r.price")))
    name = F.coalesce(F.nullif(F.trim("r.name"), F.lit("")), F.nullif(F.trim("r.title"), F.lit("")))
    return rows.select("store_id", "game_id", "pos", name.alias("original_name"), price.alias("final_price"), F.col("r.url").alias("purchase_url")).filter("original_name is not null and final_price > 0")
