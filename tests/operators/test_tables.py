import random

import pytest
from pyspark.sql import functions as F

from offerloom.operators import crawl, payloads, probes, resolve, scan


def test_payload_rows(spark):
    rows = [
        (1, '[{"name":"a","price":5},{"name":" ","price":6},{"x":1}]'),
        (2, '{"data":[{"y":1}],"result":{"items":[{"title":"b","amount":"Rp 2.000"}]}}'),
        (3, '{"a":[{"name":"n"}],"b":{"c":[{"name":"m","price":7}]}}'),
        (4, '{"a":[{"name":"first","price":1}],"b":[{"name":"second","price":2}]}'),
        (5, '{"l1":{"l2":{"l3":{"l4":{"l5":{"deep":[{"name":"d","price":1}]}}}}}}'),
        (6, '{"products":[{"name":"p","price":3,"game":"Genshin Impact"},{"name":"q","price":4,"gameName":"MLBB"},{"name":"r","price":5}]}'),
        (7, "5"),
    ]
    docs = spark.createDataFrame(rows, "id long, t string").select("id", F.try_parse_json("t").alias("v"))
    got = sorted((r.id, r.original_name, r.final_price) for r in payloads.payload_offers(docs.union(spark.createDataFrame([(8, None)], "id long, t string").select("id", F.try_parse_json("t"))), "id").collect())
    assert got == [(1, "a", 5), (2, "b", 2000), (3, "m", 7), (4, "first", 1), (6, "p", 3), (6, "q", 4), (6, "r", 5)]
    own = payloads.payload_offers(docs, "id", F.array(F.lit("mlbb"), F.lit("ml")), scale=1000.0).filter("id = 6")
    assert sorted((r.original_name, r.final_price) for r in own.collect()) == [("q", 4000), ("r", 5000)]
    assert payloads.payload_offers(docs, "id", result_path="b.c").count() == 1
    many = spark.createDataFrame([(1, "[" + ",".join(f'{{"name":"n{k}","price":1}}' for k in range(300)) + "]")], "id long, t string").select("id", F.parse_json("t").alias("v"))
    assert payloads.payload_offers(many, "id").count() == 200


@pytest.mark.parametrize("seed", range(3))
def test_crawl_against_a_queue(spark, seed):
    r = random.Random(seed)
    edges = [(p, r.randrange(40), r.randrange(10, 60), k) for p in range(30) for k in range(r.randrange(9))]
    seeds = {s: [r.randrange(40) for _ in range(r.randrange(3))] for s in range(15)}
    goals, depth = {3, 17}, r.choice([None, 2])
    links = spark.createDataFrame(edges, "page int, target int, score int, pos int")
    starts = spark.createDataFrame(list(seeds.items()), "start int, seeds array<int>")
    got = crawl.crawl(starts, crawl.best_links(links), spark.createDataFrame([(g,) for g in goals], "page int"), pages=9, depth=depth).collect()
    found = {}
    for row in sorted(got):
        found.setdefault(row.start, []).append(row.page)
    want = {}
    for s, own in seeds.items():
        queue, seen = list(dict.fromkeys((p, 0) for p in own)), []
        while queue and len(seen) < 9:
            p, d = queue.pop(0)
            seen.append(p)
            if p in goals:
                break
            best = {}
            for a, b, score, pos in edges:
                if a == p and score >= 20:
                    best[b] = max(best.get(b, (0, 0)), (score, -pos))
            fresh = [b for b, _ in sorted(best.items(), key=lambda x: x[1], reverse=True)[:6] if b not in seen and b not in [q for q, _ in queue]]
            if depth is None or d < depth:
                queue = [(b, d + 1) for b in fresh] + queue
        if seen:
            want[s] = seen
    assert found == want


@pytest.mark.parametrize("seed", range(3))
def test_probes_against_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["direct", "discovered", "sitemap", "guessed"]), i, r.choice([None, "a", "b", "c", "d", "e"]), r.choice(["success", "terminal", *["continue"] * 8])) for k in range(60) for i in range(r.randrange(9))]
    got = {(g.k, g.attempt, g.pos) for g in probes.probed(spark.createDataFrame(rows, "k int, phase string, pos int, url string, outcome string"), "k").collect()}
    want = set()
    for k in range(60):
        tried, over = [], False
        for phase, cap in probes.PHASES:
            spent = 0
            for _, p, i, url, outcome in sorted(x for x in rows if x[0] == k and x[1] == phase and x[3]):
                if over or spent >= cap or len(tried) >= probes.TOTAL:
                    break
                if url not in tried:
                    spent += 1
                    tried.append(url)
                    want.add((k, len(tried), i))
                    over = outcome != "continue"
    assert got == want


def test_resolving_compares_all_that_can_reach_the_score(spark):
    r = random.Random(7)
    words = ["a", "ring", "rings", "red", "hot", "ri", "widget", "g", "blue bolt", "ed"]
    queries = {" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(60)} | {""}
    entries = [(f"e{k}", " ".join(r.choice(words) for _ in range(r.randrange(0, 5))), k) for k in range(80)]
    asked, known = spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(entries, "entry string, phrase string, registry_order int")
    got = {g.query: (g.entry, g.score) for g in resolve.resolve(asked, known).collect()}

    def similar(q, p):
        a, b = set(q.split(" ")), set(p.split(" "))
        phrase = 100 if q == p else 82 if q.startswith(p) or p.startswith(q) else 68 if q in p or p in q else 0
        return round(max(phrase, len(a & b) / max(len(a), len(b)) * 70), 6)

    want = {}
    for q in queries - {""}:
        s, o, e = max((similar(q, p), -o, e) for e, p, o in entries)
        if s >= 45:
            want[q] = (e, s)
    assert got == want
    assert resolve.resolve(asked.limit(0), known).count() == 0 and resolve.resolve(asked, known.limit(0)).count() == 0
    plan = resolve.resolve(asked, known.filter("phrase <> ''"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1  # the one row for an empty phrase


def test_resolving_compares_only_what_begins_with_no_phrase(spark, monkeypatch):
    asked = spark.createDataFrame([(q,) for q in ("the red ring of fire", "the red", "th", "ring the red", "fire")], "query string")
    known = spark.createDataFrame([("a", "the red ring", 3), ("b", "the red", 2), ("c", "the", 1), ("d", "red ring the", 4), ("e", "", 9)], "entry string, phrase string, registry_order int")
    compared = []
    given = resolve.candidates
    monkeypatch.setattr(resolve, "candidates", lambda q, p: compared.extend(r.text for r in q.collect()) or given(q, p))
    got = {r.query: (r.entry, r.score) for r in resolve.resolve(asked, known.filter("phrase <> ''")).collect()}
    assert got == {"the red ring of fire": ("c", 82.0), "the red": ("b", 100.0), "th": ("c", 82.0), "ring the red": ("a", 70.0)}
    assert sorted(compared) == ["fire", "ring the red"]
    compared.clear()
    assert {r.query: r.entry for r in resolve.resolve(asked, known).collect()}["fire"] == "e" and not compared


def test_scan_watches_its_extractors(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([(1, '<p>5 UC</p><p>Rp 900</p><script>f({"name":"5 uc","price":"900"});f({"name":"7 UC","price":"800"})</script>'), (2, None)], "page_id long, html string")
    seen = {"lines": Observation("lines"), "scripts": Observation("scripts")}
    got = sorted((r.extractor, r.original_name) for r in scan.scanned(rows, watch=seen).collect())
    assert got == [("lines", "5 UC"), ("scripts", "7 UC")] and seen["lines"].get["offers"] == 1 and seen["scripts"].get["offers"] == 2
    assert scan.scanned(rows, {"mine": lambda r: r.selectExpr("page_id", "1 as pos", "'x' as original_name", "5L as final_price")}).count() == 2
