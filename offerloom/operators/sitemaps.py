"""Addresses of stores' sitemaps, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions.text import decoded, normalized
from offerloom.functions.urls import BAD_LINK, absolute, link_score, origin, path, scheme
from offerloom.operators.crawl import crawl
from offerloom.sources.tables import kept as kept_once
from offerloom.sources.tables import settled

#: Sitemaps read for a store, the least score of an address, and addresses kept.
SITEMAPS, SCORE, KEPT = 2, 85, 4
# Where sitemaps lie, what an address of one looks like, and which come first.
ROOTS = ["/sitemap.xml", "/sitemap_index.xml"]
NESTED, FIRST = r"(?i)\.xml(?:\?|$)|sitemap", "(?i)product|game|page"


#: Ways of writing one address on a page: whole, without its scheme, from the root, from the sitemap's folder.
FORMS = 4


def locations(texts: DataFrame, key: str = "url") -> DataFrame:
    """(key, pos, t, letters) of the locations in sitemaps (key, xml) as they are written, each once, and their letters and digits."""
    raw = F.regexp_extract_all("xml", F.lit(r"(?is)<loc(?![a-z0-9_])[^>]*>(.*?)</loc>"), F.lit(1))
    each = texts.select(key, F.posexplode(raw).alias("pos", "t"))
    whole = F.regexp_replace(F.trim(decoded(F.regexp_replace("t", "<[^>]+>", ""))), "#.*$", "")
    return each.select(key, "pos", whole.alias("t")).groupBy(key, "t").agg(F.min("pos").alias("pos")).withColumn("letters", _letters(F.col("t")))


def _letters(c: Column) -> Column:
    return F.replace(normalized(c), F.lit(" "), F.lit(""))


def _ahead(url: Column) -> Column:
    """Letters of what may stand before a location that is not whole: the scheme, the origin, or the folder of its sitemap."""
    folder = F.concat(origin(url), F.regexp_replace(path(url), "[^/]*$", ""))
    return F.array_distinct(F.array(_letters(scheme(url)), _letters(origin(url)), _letters(folder)))


def _asked(compact: Column, ahead: Column) -> Column:
    """What to ask of a location's own letters so that no address with the letters of the named thing is missed.

    They hold all of these, or begin with the rest of them where what stands
    before the location ends with the others or holds all: (opens, letters).
    """
    rest = lambda a: F.when(F.contains(a, compact), F.array(F.lit(""))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(compact), F.lit(1))), lambda n: F.endswith(a, F.substring(compact, F.lit(1), n))), lambda n: F.substring(compact, n + 1, F.char_length(compact)))
    )
    opens = F.transform(F.flatten(F.transform(ahead, rest)), lambda r: F.struct(F.lit(True).alias("opens"), r.alias("letters")))
    return F.array_distinct(F.concat(F.array(F.struct(F.lit(False).alias("opens"), compact.alias("letters"))), opens))


def _fits(letters: Column, asked: Column) -> Column:
    return F.when(asked["opens"], F.startswith(letters, asked["letters"])).otherwise(F.contains(letters, asked["letters"]))


def discovered(stores: DataFrame, sitemaps: DataFrame, most: int = SITEMAPS, least: int = SCORE, kept: int = KEPT, texts: DataFrame | None = None) -> DataFrame:
    """(store_id, url, score, place): the addresses of a store's sitemaps that look most like the named thing.

    stores: store_id, homepage, identity (normalised); sitemaps: url, xml. Of
    each store `most` sitemaps are read: the known roots in order, and before
    the second one the best sitemap that the first one names. An address that
    several name has its best score; ties go to the one read first. Missing
    sitemaps name nothing but count as read.

    Where many sitemaps say the same, sitemaps are url and body, and texts body
    and xml: each text is parsed once, and asked once for each name that is
    looked for in it. Stores meet only the locations that may fit.
    """
    root = F.regexp_extract("homepage", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    known = stores.filter(root != "").select("store_id", "homepage", "identity", F.array(*(F.concat(root, F.lit(r)) for r in ROOTS)).alias("seeds"))
    if texts is None:
        sitemaps, texts = sitemaps.select("url", F.col("url").alias("body")), sitemaps.select(F.col("url").alias("body"), "xml")
    # A sitemap is small and names many addresses, so sitemaps are dealt by number, and each is read once.
    spread = int(sitemaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = kept_once(locations(texts.repartition(spread, "body"), "body"))
    # Nearly no location looks like a sitemap itself; one does by what it says or by where it stands.
    odd = F.concat(origin(F.col("url")), F.regexp_replace(path(F.col("url")), "[^/]*$", "")).rlike(NESTED) | (path(F.col("url")) == "")
    maps = named.filter(F.col("t").rlike(NESTED)).join(sitemaps.filter(~odd), "body").unionByName(named.join(sitemaps.filter(odd), "body"))
    maps = maps.select("url", "pos", absolute(F.col("t"), F.col("url")).alias("location")).filter(F.col("location").rlike(NESTED)).groupBy("url", "location").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("url").orderBy(F.col("location").rlike(FIRST).desc(), "pos")
    nested = maps.withColumn("k", F.row_number().over(order)).filter(F.col("k") < most)
    onward = nested.groupBy(F.col("url").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "location"))), lambda x: x["location"]).alias("next"))
    read = crawl(known.select(F.col("store_id").alias("start"), "seeds"), onward, pages=most, depth=1)
    visits = read.join(sitemaps, F.col("page") == F.col("url")).join(known, F.col("start") == F.col("store_id")).select("store_id", "homepage", "identity", "step", "url", "body")
    compact = F.replace("identity", F.lit(" "), F.lit(""))
    # An address without the letters of the named thing scores nothing.
    every = F.array(F.struct(F.lit(True).alias("opens"), F.lit("").alias("letters")))
    visits = visits.withColumn("asks", _asked(compact, _ahead(F.col("url"))) if least > 0 else every).withColumn("ask", F.explode("asks"))
    key, most_rows = ["body", "identity", "ask"], kept * most * FORMS
    fit = visits.select(key).distinct().join(named, "body").filter(_fits(F.col("letters"), F.col("ask")))
    # A location from the root that holds the letters itself scores alike at all stores, so that only the best of a text go to them.
    rooted = ~F.col("ask.opens") & F.col("t").startswith("/") & ~F.col("t").startswith("//")
    fit = settled(fit.repartition(spread, *key, "pos"), own=F.when(rooted, link_score(F.lit(""), F.col("t"), F.col("t"), F.col("identity"))))
    fit = kept_once(fit.withColumn("_n", F.row_number().over(Window.partitionBy(*key, F.isnull("own")).orderBy(F.desc("own"), "pos"))))
    # An origin with a word that leads to no product lowers all its addresses alike, and the order is another.
    low = normalized(origin(F.col("url"))).rlike(BAD_LINK)
    few = visits.filter(~low).join(fit.filter(F.col("own").isNull() | (F.col("_n") <= most_rows)), key)
    met = few.unionByName(visits.filter(low).join(fit, key))
    # What also begins with the rest of the letters is met there, once.
    last = F.coalesce(F.get(F.filter("asks", lambda a: a["opens"] & _fits(F.col("letters"), a)), F.lit(0)), F.col("ask"))
    met = met.filter((F.size("asks") == 1) | (last == F.col("ask"))).repartition(spread, "store_id")
    found = settled(met.select("store_id", "homepage", "identity", "step", "url", "pos", "t"), location=absolute(F.col("t"), F.col("url"))).filter("location is not null")
    if least > 0:
        found = found.filter(F.contains(_letters(F.col("location")), compact))
    score = link_score(F.lit(""), F.col("location"), F.col("homepage"), F.col("identity"))
    scored = settled(found, score=score.cast("int")).filter(F.col("score") >= least)
    # An address scores the same wherever it is named, at most once in each form and sitemap, so no more rows can stand before the last one kept.
    ahead = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("score"), "step", "pos"))
    near = scored.withColumn("_n", ahead).filter(F.col("_n") <= most_rows)
    best = near.groupBy("store_id", F.col("location").alias("url")).agg(F.max("score").alias("score"), F.min(F.struct("step", "pos")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("score"), "_at"))
    return best.withColumn("place", place).filter(F.col("place") <= kept).select("store_id", "url", "score", "place")
