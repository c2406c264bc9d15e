import json
import random
import re

import pytest
from pyspark.sql import functions as F

from offerloom.operators import serialized


def first_value(text, start):
    """End of the value that opens at start, by trying each end: brackets of what lies between must pair up."""
    pairs, quote, skip, stack = {"}": "{", "]": "["}, None, False, []
    for k in range(start, len(text)):
        c = text[k]
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "{[":
            stack.append(c)
        elif c in pairs:
            if not stack or stack.pop() != pairs[c]:
                return None
            if not stack:
                return k + 1
    return None


def test_balanced_against_plain_scanning():
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("{}[]\"'\\a ") for _ in range(r.randrange(1, 14)))
        for k, c in enumerate(t):
            if c in "{[":
                assert serialized.balanced(t, k) == first_value(t, k), (t, k)


def test_outermost_values():
    whole = [json.dumps(x) for x in ({"a": [1, "}]", {"b": "\\\""}]}, [[], {}], {"q": "it's"})]
    t = "x = " + "; y = ".join(whole) + " ]}"
    assert [t[a:b] for a, b in serialized.outermost(t)] == whole
    assert list(serialized.outermost("it's {a}")) == [(5, 8)]
    assert list(serialized.outermost("{ (] {b} [c]")) == [(5, 8), (9, 12)]
    assert list(serialized.outermost("{ 'open {b} [c]")) == [(8, 11), (12, 15)]
    assert list(serialized.outermost("")) == []
    r = random.Random(4)
    for _ in range(2000):  # what is found is whole, in order, and never one inside another
        t = "".join(r.choice("{}[]\"'a") for _ in range(r.randrange(20)))
        found = list(serialized.outermost(t))
        assert all(first_value(t, a) == b for a, b in found) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
    assert len(list(serialized.outermost("{" * 50_000 + "}" * 50_000))) == 1 and len(list(serialized.outermost("{" * 50_000))) == 0


def test_assigned_documents(spark):
    t = 'window.__NUXT__ = {"a": "}"}; self.__INITIAL_STATE__=[1,{"b":2}] x.__NUXT__ = {broken ] __APOLLO_STATE__ = 5'
    got = [tuple(r) for r in serialized.assigned(spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, t string"), "t", ["id"]).collect()]
    assert [(g[1], g[4]) for g in got] == [("__INITIAL_STATE__", '[1,{"b":2}]'), ("__NUXT__", '{"a": "}"}')] and all(t[g[2] : g[3]] == g[4] for g in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_against_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(30):
        parts = [r.choice(['name: "5 UC"', 'title="7 Diamonds"', "Rp 1.500", 'price: "700"', "IDR 90", 'sellPrice=300', "x" * r.randrange(1, 300)]) for _ in range(r.randrange(12))]
        rows.append((i, " ~ ".join(parts)))
    df = spark.createDataFrame([*rows, (99, None)], "id long, t string")
    names = serialized.found_at(df, "t", ["id"], [(1, serialized.NAME_FIELD)])
    prices = serialized.prices_at(df, "t", ["id"])
    got = {(g.id, g.start): (g.final_price, g.confidence) for g in serialized.nearest(names, prices, ["id"]).collect()}
    want = {}
    for i, t in rows:
        for n in re.finditer(serialized.NAME_FIELD, t):
            found = [(-3, m.start(), m.end(), int(re.sub(r"\D", "", m[0]))) for m in re.finditer(serialized.MARKED_PRICE, t)] + [(-2, m.start(), m.end(), int(m[1])) for m in re.finditer(serialized.PRICE_FIELD, t)]
            near = [(c, abs(2 * a - n.start() - n.end()), a, p) for c, a, b, p in found if a >= n.start() - 220 and b <= n.end() + 420]
            if near:
                want[i, n.start()] = (min(near)[3], -min(near)[0])
    assert got == want and want


def test_objects_around_names(spark):
    t = '{"price":"Rp 9.000","x":{"name":"5 UC","currency":"IDR","price":"1500"}} {"a":{"name":"6 UC","price":"2000"} 7 UC } {"name":"8 UC","price":"50"} {"name":"9 UC","currency":"usd","price":"900"} 10 UC'
    df = spark.createDataFrame([(1, t + " rupiah"), (2, None), (3, "}} 5 UC {{"), (4, "{" + "x" * 3000 + "5 UC Rp 5.000}")], "id long, t string")
    got = serialized.fragment_offers(df, "t", ["id"], [r"\d+ UC"]).select("id", "original_name", "final_price").collect()
    assert sorted(map(tuple, got)) == [(1, "5 UC", 1500), (1, "6 UC", 2000), (1, "7 UC", 2000)]


def test_flat_objects_and_escapes(spark):
    t = 'a({"name":"5 UC","price":null}); b({"title":"x","salePrice":12.5,"price":"7"}) {"name":5,"label":"y","total_price":"3"} {bad} {"n":{"name":"in","price":1}}'
    got = [tuple(r) for r in serialized.flat_objects(spark.createDataFrame([(1, t), (2, '{"name":"a","cost":1}'), (3, None)], "id long, t string"), "t", ["id"]).collect()]
    assert got == [(1, 0, "5 UC", None), (1, 1, "x", "7"), (1, 2, "y", "3"), (1, 4, "in", "1")]
    raw = spark.createDataFrame([(r"a&b\x3cp\x3ec\nd\"e\/f<br>g</li>h<i>j&lt;",)], "t string").select(serialized.serialized(F.col("t"))).first()[0]
    assert raw == 'a&b c\nd"e/f\ng\nh j<'
