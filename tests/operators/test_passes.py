"""What a query reads or sends is read or sent once."""

from pyspark.sql import functions as F

from offerloom.operators import offers, scan, search
from offerloom.plans import scans, searches
from offerloom.streaming import merge

OFFERS = "game_id string, store_id string, store_name string, original_name string, final_price long, source string, arrival_seq long"


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_pages_are_built_once_for_each_strategy(spark, tmp_path):
    spark.createDataFrame([(1, 7, "<p>5 UC</p><p>Rp 9</p>"), (2, 8, '<script>f({"name":"6 UC","price":"8"})</script>'), (3, 9, "<p>5 UC</p><p>Rp 9</p>")], "page_id long, store_id long, html string").write.parquet(str(tmp_path / "p"))
    strategies = spark.createDataFrame([(7, 0, "scripts"), (7, 1, "lines"), (8, 0, "scripts"), (8, 1, "nobody")], "store_id long, stage int, strategy string")
    found = scan.by_strategy(spark.read.parquet(str(tmp_path / "p")), strategies)
    assert _plan(found).count("Relation [page_id") == len(scan.EXTRACTORS)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "lines", 0, "5 UC", 9), (2, 0, "scripts", 0, "6 UC", 8)]


def test_pages_of_three_kinds_are_gathered_at_once(spark, sf_dir):
    plan = _plan(scans.mixed_pages(spark, sf_dir))
    assert plan.count("Aggregate [") == 1 and "Join" not in plan


def test_scans_send_offers_once(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "page_id long, html string")
    mine = {n: lambda r, p=p: r.selectExpr("page_id", f"{p} as pos", "'5  Uc' as original_name", "5L as final_price") for n, p in (("a", 2), ("b", 1))}
    found = scan.scanned(rows, mine)
    assert _plan(found, "executedPlan").count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "a", 2, "5  Uc", 5), (2, "a", 2, "5  Uc", 5)]


def test_a_merged_state_stays_where_it_is(spark, tmp_path):
    rows = [("g", f"s{k % 3}", f"s{k % 3}", f"{k % 4} Diamonds", 100 + k % 5, "live", k) for k in range(40)]
    spark.createDataFrame(rows, OFFERS).write.parquet(str(tmp_path / "o"))
    every, state = spark.read.parquet(str(tmp_path / "o")), None
    for k in range(3):
        batch = every.filter(F.col("arrival_seq") % 3 == k)
        state = merge.merged(batch.limit(0) if state is None else state, batch)
    above, deepest = [], 0
    for line in _plan(state, "executedPlan").split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        above = [a for a in above if a < at]
        if line[at:].startswith("Exchange hashpartitioning"):
            above.append(at)
            deepest = max(deepest, len(above))
    assert deepest == 1  # no exchange lies below another
    first = {}
    for r in rows:
        first.setdefault((r[0], r[1], r[3], r[4]), r)
    assert sorted(map(tuple, state.collect())) == sorted(first.values())


def test_groups_carry_little_to_count_stores(spark):
    rows = spark.createDataFrame([("g", "a", "B", "85 Diamonds (77 + 8 Bonus)", 9, "live", 2), ("g", "b", "A", "85 Diamonds", 9, "fallback", 3), ("g", "b", "A", None, 4, "live", 4)], OFFERS)
    groups = offers.group_offers(rows)
    assert sorted((r.canonical_key, r.name, r.cheapest_price, r.cheapest_store, r.store_count, r.offer_count, r.has_live_price) for r in groups.collect()) == [("currency:diamonds:85", "85 Diamonds", 9, "A", 2, 2, True), ("other:", "", 4, "A", 1, 1, True)]
    assert "min_by(struct" not in _plan(groups)


def test_first_offers_are_sorted_by_price_and_hold_their_order_once(spark):
    rows = spark.createDataFrame([("g", "a", "s", "5 UC", 100, "live", 2), ("g", "b", "s", "5-uc", 100, "live", 1), ("g", "b", "s", "", 100, "live", 0)], OFFERS)
    first = offers.first_strict(rows, ["game_id"])
    assert first.columns == ["game_id", "final_price", "store_id", "store_name", "original_name", "source", "arrival_seq"]
    assert [(r.store_id, r.original_name, r.arrival_seq) for r in first.collect()] == [("b", "5-uc", 1)]
    for found in (first, offers.first_of_each(rows, ["game_id"])):
        assert "Aggregate [final_price" in _plan(found) and "min_by" not in _plan(found)


def test_only_pages_of_the_chosen_stores_are_built_and_once(spark, sf_dir, monkeypatch):
    plans, keep = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df: plans.append(_plan(df)) or keep(df))
    groups, answers = searches._search(spark, sf_dir)
    built = [p for p in plans if "collect_list" in p]
    assert len(built) == 1 and "LeftSemi" in built[0].split("Aggregate [sk")[1].split("Window")[0]
    spare = next(p for p in plans if "p_retailprice" in p)
    spread = spare[spare.index("% 50") :].split("Relation [s_suppkey")[0]
    assert "LeftSemi" in spread  # stores are chosen before the catalogue is spread over them
    assert groups.count() and answers.count()
