"""Crawls of all starts at once over a table of links: a frontier each, with a budget, visited pages and links put in front.

A start's state is one row: the pages still to visit in order and those visited,
both bounded by the budget times the links taken of a page. Each step visits the
first page of every frontier by one join with the links, so a crawl of n pages
is n joins however many starts there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.sources.tables import kept

#: Pages that a start may visit, the least score of a link that is followed, and links followed of one page.
PAGES, SCORE, LINKS = 12, 20, 6


def best_links(links: DataFrame, least: int = SCORE, most: int = LINKS) -> DataFrame:
    """(page, next): the pages that each page's best links lead to, best first; links: page, target, score, pos. Of links to one page the best counts."""
    one = links.filter(F.col("score") >= least).groupBy("page", "target").agg(F.max(F.struct("score", (-F.col("pos")).alias("pos"))).alias("s"))
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("s.score"), F.desc("s.pos")))
    ranked = one.withColumn("k", place).filter(F.col("k") <= most)
    return ranked.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "target"))), lambda x: x["target"]).alias("next"))


def crawl(starts: DataFrame, links: DataFrame, goals: DataFrame | None = None, pages: int = PAGES, depth: int | None = None) -> DataFrame:
    """(start, step, page, depth): the pages that each start visits, in order.

    starts: start, seeds (array of pages); links: page, next (best first); goals:
    page, where a crawl ends with success. The best link of a visited page is
    visited next; pages in the frontier or visited before are not taken again; a
    page `depth` links from its seed is not followed further. Starts without
    seeds give no rows.
    """
    kind = starts.schema["seeds"].dataType.elementType.simpleString()
    entry = f"array<struct<page {kind}, depth int>>"
    state = starts.select("start", F.transform(F.array_distinct("seeds"), lambda p: F.struct(p.alias("page"), F.lit(0).alias("depth"))).cast(entry).alias("queue"), F.array().cast(entry).alias("seen"), F.lit(False).alias("over"))
    known = links if goals is None else links.withColumn("_goal", F.lit(False)).join(goals.select("page", F.lit(True).alias("_g")).distinct(), "page", "full").select("page", "next", F.coalesce("_g", "_goal").alias("_goal"))
    known = kept(known)  # every step reads it
    for step in range(pages):
        head = F.get("queue", F.lit(0))
        now = state.withColumn("page", F.when(~F.col("over"), head["page"]))
        met = now.join(known.withColumnRenamed("next", "_next"), "page", "left")
        ended = F.coalesce(F.col("_goal"), F.lit(False)) if goals is not None else F.lit(False)
        rest = F.slice("queue", 2, F.greatest(F.size("queue"), F.lit(1)))
        taken = F.transform(F.concat("queue", "seen"), lambda e: e["page"])
        deeper = F.lit(True) if depth is None else head["depth"] < depth
        fresh = F.when(deeper, F.filter("_next", lambda p: ~F.array_contains(taken, p)))
        front = F.coalesce(F.transform(fresh, lambda p: F.struct(p.alias("page"), (head["depth"] + 1).alias("depth"))), F.array()).cast(entry)
        going = F.col("page").isNotNull()
        state = met.select(
            "start",
            F.when(going & ~ended, F.concat(front, rest)).otherwise(F.array().cast(entry)).alias("queue"),
            F.when(going, F.array_append("seen", head)).otherwise(F.col("seen")).alias("seen"),
            (F.col("over") | (going & ended)).alias("over"),
        )
        if step % 4 == 3 and step + 1 < pages:
            state = kept(state)
    return state.select("start", F.posexplode("seen").alias("step", "e")).select("start", "step", F.col("e.page").alias("page"), F.col("e.depth").alias("depth"))
