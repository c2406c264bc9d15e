import hashlib
import random

import duckdb
import numpy as np
import pytest

from offerloom.llm import suffixes


def brute(docs):
    """{id: (n_bytes, n_removed, n_spans, sha)} by a dictionary of all strings of 50 bytes."""
    low, out = {}, {}
    raw = {k: (t or "").encode() for k, t in docs.items()}
    for k, b in raw.items():
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            low[s] = min(k, low.get(s, k))
    for k, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_buckets_are_equal_bytes():
    b = np.frombuffer((b"abab" * 40 + b"x" * 60 + b"abab" * 20), np.uint8)
    held, first = suffixes.buckets(b), {}
    assert len(held) == len(b) - 49
    for k, bucket in enumerate(held):
        first.setdefault(bytes(b[k : k + 50]), set()).add(bucket)
    assert all(len(x) == 1 for x in first.values()) and len(set(held)) == len(first)


def test_kinds_are_ordered_by_anchor_and_whole_pointer():
    rng = np.random.default_rng(5)
    anchor = rng.integers(0, 3, 2_000, dtype=np.uint64)
    pointer = (rng.integers(0, 2, 2_000, dtype=np.uint64) << np.uint64(40)) | rng.integers(0, 5, 2_000, dtype=np.uint64)
    order = suffixes._order(anchor, pointer)
    assert sorted(order.tolist()) == list(range(2_000))
    assert list(zip(anchor[order], pointer[order])) == sorted(zip(anchor, pointer))


def test_blocks_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abcd \n") for _ in range(n)) for n in (50, 0, 700, 49, 3, 131, 51, 2000)] + [b"a" * 400, b"abcab" * 60]
    whole = suffixes.Blocks(texts)
    monkeypatch.setattr(suffixes, "PIECE", 64)
    pieces = suffixes.Blocks(texts)
    for name in ("doc", "first", "last", "anchor", "pointer", "half"):
        assert getattr(whole, name).tolist() == getattr(pieces, name).tolist()
    starts = [p for d, t in enumerate(texts) for p in range(whole.begins[d], whole.begins[d] + len(t) - 49)]
    assert [p for x, y in zip(whole.first, whole.last) for p in range(x, y + 1)] == starts
    assert all(whole.begins[d] <= x and y + 50 <= whole.begins[d] + len(texts[d]) for d, x, y in zip(whole.doc, whole.first, whole.last))


@pytest.mark.parametrize("seed, hot", [(1, 4096), (2, 4096), (2, 2)])
def test_equals_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_KINDS", hot)
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 5_000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "é", "river", "stone", "x", "\n", "the"]) * rng.randrange(1, 3)
    text = lambda n: " ".join(word() + str(rng.randrange(9999)) for _ in range(n))
    shared, docs = [text(12) for _ in range(4)], {}
    for k in range(120):
        parts = [text(rng.randrange(1, 12)), rng.choice(shared) if rng.random() < 0.6 else "", text(rng.randrange(0, 5)), rng.choice(shared)[: rng.randrange(20, 90)]]
        docs[rng.randrange(10**6)] = "".join(parts)
    some = list(docs.items())
    for k in range(10):
        docs[10**6 + k] = some[k][1]
    docs |= {2 * 10**6: None, 2 * 10**6 + 1: "", 2 * 10**6 + 2: "a" * 3000, 2 * 10**6 + 3: "a" * 60 + "b", 2 * 10**6 + 4: "ab" * 40, 2 * 10**6 + 5: "z" * 49}
    rows = list(docs.items())
    rng.shuffle(rows)
    assert got(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(docs)


def test_edge_rows(spark):
    t = "".join(chr(97 + k * k % 26) for k in range(200))
    df = spark.createDataFrame([(1, t, 9), (1, t, 9), (None, t, 9), (2, t, 9)], "doc_id long, text string, grp int")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffixes.dedup(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 200)]
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(suffixes.OP7_SQL).fetchall()}
    assert got(suffixes.op7_suffix_dedup(spark, sf_dir)) == want


def test_very_long_text_and_clashing_names(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(150_000))
    rows = [(1, long[70_000:70_400], 1, b"x"), (2, long, 2, b"y"), (3, long[:99_000], 3, b"z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, range int, bytes binary")
    assert got(suffixes.dedup(df)) == brute({r[0]: r[1] for r in rows})


def test_more_groups_than_buckets_allowed(spark, monkeypatch):
    """Many groups and ranges on a session that allows four buckets; nothing is left in the catalog."""
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 40)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 40)
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "4")
    try:
        docs = {k: f"{k % 7} passage that some documents share, long enough to be found in all {k % 5} " * 2 for k in range(40)}
        assert got(suffixes.dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3))) == brute(docs)
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
