"""Ordered attempts and candidates: strongest error, cut chains, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions.status import priority


def strongest_error(attempts: DataFrame, key: str, code: str, order: str) -> DataFrame:
    """The error of the highest priority for each key, the earliest among equals."""
    rank = F.struct(priority(F.col(code)), -F.col(order))
    return attempts.groupBy(key).agg(F.max_by(code, rank).alias("code"), F.max(priority(F.col(code))).alias("priority"))


def cut_chain(attempts: DataFrame, key: str, order: list[str], stops) -> DataFrame:
    """Attempts up to the first that stops the chain, that one included."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("_stopped", F.max(stops.cast("int")).over(before)).filter("coalesce(_stopped, 0) = 0").drop("_stopped")


def fold_candidates(rows: DataFrame, key: str, order: list[str], rank: str, score: str) -> DataFrame:
    """Left fold over each key's candidates: one of higher rank or of higher score replaces the one held.

    The result depends on the order and is no maximum, so the candidates of one
    key are folded in order; they are few (the addresses found for one page).
    """
    item = F.struct(*order, F.col(rank).alias("rank"), F.col(score).alias("score"))
    held = lambda a, x: F.when(a.isNull() | (x["rank"] > a["rank"]) | (x["score"] > a["score"]), x).otherwise(a)
    kind = rows.select(item.alias("i")).schema["i"].dataType
    folded = F.aggregate(F.array_sort(F.collect_list(item)), F.lit(None).cast(kind), held)
    return rows.groupBy(key).agg(folded.alias("best"))
