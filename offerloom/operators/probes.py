"""Probes of candidate addresses under a running budget, phase after phase, for all stores at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phases in their order with the probes that each may spend, and what all of them may spend together.
PHASES = [("direct", 3), ("discovered", 1), ("sitemap", 1), ("guessed", 1)]
TOTAL = 3


def probed(candidates: DataFrame, key: str, phases: list[tuple[str, int]] = PHASES, total: int = TOTAL) -> DataFrame:
    """(key, attempt, phase, pos, url, outcome): the candidates that are tried, in order, attempt counting from 1.

    candidates: key, phase, pos, url, outcome (`success` and `terminal` end the
    whole search, others go on). A phase takes up what the ones before it have
    spent and tried: an address is tried once, whichever phase names it again,
    and one that a spent budget left untried may still be tried later. Each
    phase is a window of its cap at most, which Spark cuts before its shuffle,
    so a key with many candidates is never gathered.
    """
    columns = [key, "attempt", "phase", "pos", "url", "outcome"]
    by = Window.partitionBy(key).orderBy("pos")
    tried = None
    for name, cap in phases:
        own = candidates.filter((F.col("phase") == name) & F.col("url").isNotNull()).groupBy(key, "phase", "url").agg(F.min_by("outcome", "pos").alias("outcome"), F.min("pos").alias("pos"))
        if tried is not None:
            spent = tried.groupBy(key).agg(F.count("*").alias("_used"), F.bool_or(F.col("outcome").isin("success", "terminal")).alias("_over"))
            own = own.join(tried.select(key, "url"), [key, "url"], "left_anti").join(spent, key, "left").filter(~F.coalesce("_over", F.lit(False)))
        else:
            own = own.withColumn("_used", F.lit(0))
        own = own.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= min(cap, total))
        before = F.max(F.col("outcome").isin("success", "terminal").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
        attempt = (F.coalesce("_used", F.lit(0)) + F.col("_k")).cast("int")
        own = own.withColumns({"_stopped": F.coalesce(before, F.lit(0)), "attempt": attempt}).filter((F.col("_stopped") == 0) & (F.col("attempt") <= total)).select(*columns)
        tried = own if tried is None else tried.unionByName(own)
    return tried
