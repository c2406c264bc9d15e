"""Sitemaps that many stores share."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from offerloom.functions import urls
from offerloom.operators import sitemaps
from offerloom.plans import searches


def _all_pairs(stores, maps, texts, least):
    """Every location of every store's two roots, scored as it stands."""
    raw = F.regexp_extract_all("xml", F.lit("<loc>(.*?)</loc>"), F.lit(1))
    roots = F.posexplode(F.array(*(F.concat(F.substring("homepage", 1, F.char_length("homepage") - 1), F.lit(r)) for r in sitemaps.ROOTS))).alias("step", "url")
    rows = stores.select("*", roots).join(maps, "url").join(texts, "body").select("store_id", "homepage", "identity", "step", "url", F.posexplode(raw).alias("pos", "t"))
    rows = rows.withColumn("location", urls.absolute(F.trim("t"), F.col("url"))).withColumn("score", urls.link_score(F.lit(""), F.col("location"), F.col("homepage"), F.col("identity")).cast("int"))
    best = rows.filter(F.col("score") >= least).groupBy("store_id", "location").agg(F.max("score").alias("score"), F.min(F.struct("step", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("store_id").orderBy(F.desc("score"), "at"))
    return {tuple(r) for r in best.withColumn("place", place).filter("place <= 4").select("store_id", "location", "score", "place").collect()}


def test_shared_texts_give_what_all_pairs_give(spark):
    """names that begin in the host, addresses in all forms, origins that lead to no product."""
    r = random.Random(7)
    hosts, names = ["s5.id", "hot.id", "login.id", "x.hotr", "blog.hot.id"], ["hot ring", "ing", "d hot", "id hot", "login", "s5", "ring x", "r", "hot", "shot ring"]
    heads, paths, tails = ["/", "/", "/", "//s5.id/", "https://s5.id/", "https://hot.id/", "", "HTTPS://S5.ID/", "mailto:"], ["hot-ring", "hotring", "blog/hot-ring", "ing", "game/s5", "ring/x", "hot", "login/hot-ring", "éhot ring", "ot/ring"], ["", "#f", "?a=1", "?a=2", " "]
    stores = spark.createDataFrame([(k, f"https://{h}/", n) for k, (h, n) in enumerate((h, n) for h in hosts for n in names)], "store_id long, homepage string, identity string")
    maps = spark.createDataFrame([(f"https://{h}{root}", r.randrange(4)) for h in hosts for root in sitemaps.ROOTS], "url string, body int")
    texts = spark.createDataFrame([(b, "".join(f"<loc>{r.choice(heads)}{r.choice(paths)}{r.choice(tails)}</loc>" for _ in range(150))) for b in range(4)], "body int, xml string")
    for least in (85, 30):
        got = {tuple(x) for x in sitemaps.discovered(stores, maps, least=least, texts=texts).collect()}
        assert got == _all_pairs(stores, maps, texts, least) and len(got) > 30


def test_parsed_locations_grow_with_parts(spark, tmp_path, monkeypatch):
    """each store's sitemap named its parts anew, so what was kept grew with parts times stores."""
    spark.range(60).select(F.col("id").alias("p_partkey"), F.lit("hot ring").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    seen, keep = [], sitemaps.kept_once
    monkeypatch.setattr(sitemaps, "kept_once", lambda df: seen.append(df) or keep(df))
    assert searches.sitemap_urls(spark, str(tmp_path)).count() == 80
    assert seen[0].count() <= 62
