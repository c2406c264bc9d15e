"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.durable import durable

SHARE = 500  # a key with more than this part of all rows is looked up in a broadcast table, which has at most so many rows
FEW = 2_000  # rows of a key that one task may gather, whatever part of all they are


def share_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", keep: bool = False) -> DataFrame:
    """Joins `one` (a row for each key, `w` saying how many rows of `many` have it) to `many` without gathering a hot key.

    Keys that hold more than 1 / SHARE of all rows (and more than FEW) are fewer
    than SHARE, so they are broadcast; the rows of all others are shuffled.
    Without such keys it is a plain join. `keep` leaves w in.
    """
    total, most = one.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.max("w"), F.lit(0))).first()
    bound = max(total / SHARE, FEW)
    hot = one.filter(F.col("w") > bound)
    names = [c for c in one.columns if c not in (key, "w") or (keep and c == "w")]
    if most <= bound:
        return many.join(one.select(key, *names), key, how).select(*many.columns, *names)
    marked = many.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_{c}") for c in names])), key, "left")
    first = marked.filter("_hot").select(*many.columns, *[F.col(f"_{c}").alias(c) for c in names])
    rest = marked.filter("_hot is null").select(*many.columns).join(one.filter(F.col("w") <= bound).select(key, *names), key, how)
    return first.union(rest.select(*first.columns))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the smallest node around it."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w")))
    return share_join(both, low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below go to the smallest of those."""
    low = durable(edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("w")))
    down = share_join(edges, low, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return down.union(low.select("m", "b")).filter("a < b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), component being the smallest node reachable.

    A hub's edges are aggregated and joined, never gathered, and each round is
    written to the shared folder; the number of rounds grows with the logarithm
    of the graph's size.
    """
    now = durable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = durable(_small(durable(_large(now).distinct())).distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == state:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
        state = mark
