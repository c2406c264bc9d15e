from offerloom.operators import games


def test_pages_are_not_dealt_by_game(spark):
    known = spark.createDataFrame([("g", 1, "Genshin Impact", "GI", ["genshin"], ["Genesis Crystals"]), ("m", 2, "Mobile Legends", "MLBB", ["ml"], ["Diamonds"])], "game_id string, place int, name string, short_name string, aliases array<string>, unit_aliases array<string>")
    signals = spark.createDataFrame([(k, "g", "Genshin Impact" if k else "MLBB", "", "", "", "", None, None) for k in range(3)], "page_id long, game_id string, title string, heading string, meta string, structured string, body string, url string, home string")
    found = games.page_evidence(signals, known)
    assert sorted((r.page_id, r.ok) for r in found.collect()) == [(0, False), (1, True), (2, True)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(mentioned" not in plan and plan.count("BroadcastHashJoin") >= 3
