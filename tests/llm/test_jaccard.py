import random

import duckdb
import numpy as np
import pytest

from offerloom.llm import components, jaccard


def sets(texts):
    out = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(texts):
    s, root = sets(texts), {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(s[a] & s[b])
            if common and 100 * common >= 75 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s[k]), find(k)) for k in keys}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(seed, docs=160):
    """Originals, chains of ever more edited copies, a passage in most documents, one large group of near copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    hot = [rng.choice(vocabulary) for _ in range(60)]
    texts, last = {}, None
    for k in range(docs):
        kind = rng.random()
        if kind < 0.4 and last:
            own = list(last)
            for _ in range(rng.randrange(1, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        elif kind < 0.6:
            own = list(hot)
            own[rng.randrange(60)] = rng.choice(vocabulary)
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 80))]
            if rng.random() < 0.7:
                own += passage
        last = own
        texts[1000 - k * 3] = " ".join(own)
    return texts


@pytest.mark.parametrize("seed,tile", [(1, 1024), (2, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert rows_of(jaccard.join(df)) == brute(texts)


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 6, (6, jaccard.GROUPS))
    vectors = np.maximum(0, base[rng.integers(0, 6, 150)] + rng.integers(-1, 2, (150, jaccard.GROUPS))).astype(np.int32)
    n, component = vectors.sum(1), np.arange(150)
    p, q = jaccard.candidates(n, vectors, component, None)
    got = {tuple(sorted(x)) for x in zip(p.tolist(), q.tolist())}
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if np.minimum(vectors[a], vectors[b]).sum() * 175 >= 75 * (n[a] + n[b])}
    assert want <= got


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "One two"), (8, "one  TWO"), (7, "É one"), (6, "é one"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "one two"), (None, None), (1, "x " * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    want = [(5, 0, 5), (4, 0, 4), (3, 0, 3), (9, 1, 8), (8, 1, 8), (7, 1, 7), (6, 1, 6), (2, 2, 2), (2, 2, 2), (None, 1, 8), (None, 0, None), (1, 1, 1)]
    assert got == sorted(want, key=str)
    assert jaccard.join(df.limit(0)).count() == 0


def test_sql_agrees_on_a_small_fixture(spark):
    texts = corpus(3, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    assert {a: (b, c) for a, b, c in con.execute(jaccard.OP2_SQL).fetchall()} == brute(texts)


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_share_join_is_plain_without_hot_keys(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "SHARE", 4)
    many = spark.createDataFrame([(1, k) for k in range(9)] + [(2, k) for k in range(4)] + [(3, 0), (4, 0), (None, 0)], "key int, v int")
    one = spark.createDataFrame([(1, 9, "a"), (2, 4, "b"), (3, 1, "c")], "key int, w long, x string")
    for how in ("inner", "left"):
        got = components.share_join(many, one, "key", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, many.join(one.select("key", "x"), "key", how).collect()))
        assert ("Union" in got._jdf.queryExecution().optimizedPlan().toString()) == (few < 9)
    assert "w" in components.share_join(many, one, "key", keep=True).columns
