"""Resolving free text to catalogue entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.sources.tables import kept

#: The least score of an entry, and what shared words are worth at most.
LEAST, WORDS = 45.0, 70.0
GRAM = 3


def similarity(query: Column, candidate: Column) -> Column:
    """100 for equal texts, 82 for a prefix either way, 68 for containment either way, else up to 70 by shared words."""
    a, b = F.array_distinct(F.split(query, " ")), F.array_distinct(F.split(candidate, " "))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) * WORDS
    phrase = (
        F.when(query == candidate, 100.0)
        .when(F.startswith(candidate, query) | F.startswith(query, candidate), 82.0)
        .when(F.contains(candidate, query) | F.contains(query, candidate), 68.0)
        .otherwise(0.0)
    )
    return F.when(query == "", 0.0).otherwise(F.greatest(phrase, shared))


def _rarest_words(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text, word): as many of each text's rarest words as one must be among, if the text shares the least part of its words with another."""
    words = texts.select("text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"), F.size(F.array_distinct(F.split("text", " "))).alias("n"))
    ranked = words.join(known, "word").withColumn("k", F.row_number().over(Window.partitionBy("text").orderBy("m", "word")))
    return ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * (LEAST / WORDS) - 1e-9) + 1).select("text", "word")


def _grams(text: Column) -> Column:
    """Distinct substrings of one to GRAM characters."""
    size = F.char_length(text)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(n) for n in range(1, GRAM + 1))))


def _inside(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): texts with those that hold them, found by the rarest substring of the smaller one."""
    index = large.select(F.col("text").alias("large"), F.explode(_grams(F.col("text"))).alias("gram"))
    known = index.groupBy("gram").agg(F.count("*").alias("m"))
    own = small.select(F.col("text").alias("small"), F.explode(_grams(F.col("text"))).alias("gram")).filter(F.char_length("gram") == F.least(F.lit(GRAM), F.char_length("small")))
    # A text with a substring that no larger one has is held by none.
    rare = own.join(known, "gram", "left").groupBy("small").agg(F.min(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "gram")).alias("g"))
    chosen = rare.filter("g.m > 0").select("small", F.col("g.gram").alias("gram"))
    return chosen.join(index, "gram").filter(F.contains("large", F.col("small"))).select("small", "large")


def candidates(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query, phrase): all pairs that can reach the least score, and few others; both inputs: distinct, not empty texts (text).

    Containment is found by rare substrings, shared words by rare words: texts
    that share 45 / 70 of the larger one's words have one of their first
    n - ceil(45 n / 70) + 1 words in order of rarity in common.
    """
    both = queries.union(phrases)
    known = both.select(F.explode(F.array_distinct(F.split("text", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("m"))
    mine, theirs = _rarest_words(queries, known).toDF("query", "word"), _rarest_words(phrases, known).toDF("phrase", "word")
    shared = mine.join(theirs, "word").select("query", "phrase")
    held, holds = _inside(queries, phrases).toDF("query", "phrase"), _inside(phrases, queries).select(F.col("large").alias("query"), F.col("small").alias("phrase"))
    return shared.union(held).union(holds).distinct()


def _openings(texts: DataFrame, others: DataFrame) -> DataFrame:
    """texts (text and more) with what they begin with (opening), in each length that a text of others has."""
    lengths = others.agg(F.collect_set(F.char_length("text")).alias("lengths"))  # one row
    fit = F.filter("lengths", lambda n: n <= F.char_length("text"))
    return texts.join(F.broadcast(lengths)).withColumn("opening", F.explode(F.transform(fit, lambda n: F.left("text", n)))).drop("lengths")


def _opened(asked: DataFrame, known: DataFrame, empty: DataFrame) -> DataFrame:
    """(query, entry, score): the best entry of the queries that equal a phrase, begin with one or are the beginning of one.

    Beginnings meet by equality, and of the phrases that begin alike the first
    in order stands for all, so rows grow with the texts and their lengths and
    not with the pairs of them.
    """
    first = F.min(F.struct("registry_order", "entry")).alias("f")
    phrase = known.select(F.col("phrase").alias("text"), "entry", "registry_order")
    inner = _openings(asked, phrase).join(phrase.withColumnRenamed("text", "opening"), "opening").select("text", F.when(F.col("opening") == F.col("text"), 100.0).otherwise(82.0).alias("score"), F.struct("registry_order", "entry").alias("f"))
    outer = _openings(phrase, asked).groupBy("opening").agg(first).join(asked, F.col("opening") == F.col("text")).select("text", F.lit(82.0).alias("score"), "f")
    blank = asked.join(F.broadcast(empty)).select("text", F.lit(82.0).alias("score"), F.struct("registry_order", "entry").alias("f"))
    both = inner.union(outer).union(blank)
    return both.groupBy(F.col("text").alias("query")).agg(F.min_by("f.entry", F.struct((-F.col("score")).alias("s"), F.col("f.registry_order").alias("o"))).alias("entry"), F.max("score").alias("score"))


def resolve(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query, entry, score) of the best entry per query, the first in registry order among equals, from a score of 45.

    queries: (query); registry: (entry, phrase, registry_order) of any size:
    only queries that begin with no phrase, and no phrase with them, are
    compared with others, and of those only pairs that can reach the score, as
    nothing else is worth as much as a beginning. Null and empty queries resolve
    to nothing; an empty phrase begins every query, so of those the first in
    order stands for all.
    """
    asked = kept(queries.filter("query <> ''").select(F.col("query").alias("text")).distinct())
    known = kept(registry.filter("phrase <> ''").groupBy("phrase").agg(F.min_by("entry", "registry_order").alias("entry"), F.min("registry_order").alias("registry_order")))
    empty = registry.filter("phrase = ''").agg(F.min_by("entry", "registry_order").alias("entry"), F.min("registry_order").alias("registry_order")).filter("entry is not null")  # one row at most
    opened = kept(_opened(asked, known, empty))
    rest = kept(asked.join(opened, F.col("text") == F.col("query"), "left_anti"))
    if rest.isEmpty():
        return opened
    pairs = candidates(rest, known.select(F.col("phrase").alias("text"))).join(known, "phrase")
    scored = pairs.withColumn("score", F.round(similarity(F.col("query"), F.col("phrase")), 6)).filter(F.col("score") >= LEAST)
    best = scored.groupBy("query").agg(F.max_by("entry", F.struct("score", -F.col("registry_order"))).alias("entry"), F.max("score").alias("score"))
    return opened.union(best)


def suggest(registry: DataFrame, typed: str, limit: int = 5) -> DataFrame:
    """The first entries, in registry order, one of whose phrases contains what was typed."""
    hit = registry.filter(F.contains(F.lower("phrase"), F.lit(typed.lower())))
    return hit.groupBy("entry").agg(F.min("registry_order").alias("registry_order")).orderBy("registry_order").limit(limit)
