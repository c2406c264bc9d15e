import os

import numpy as np

from offerloom.llm import toxicity as tox

CLEAN = ["the small house stands near the river and the garden " * 4, "we walked over the hill to see the lake and the wood " * 3] * 12
RUDE = ["the small house you grobnik stands near the river " * 4, "we walked grobniken over the hill to see the lake " * 3] * 6


def test_gradients_match_finite_differences():
    net, rng = tox.Network(1), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    index, gram, at = tox.word_keys(["alpha", "beta", "gamma"])
    ids = rng.integers(0, 3, (4, tox.WINDOW))
    mask = np.ones(ids.shape, bool)
    mask[1, 20:] = False
    y, cost = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        x = net.inputs(index, gram, at)[0].astype(np.float64)
        z = net.run(ids, mask, x @ net.p["in"] + net.p["in_b"]).astype(np.float64)
        return float((np.log1p(np.exp(z)) - y * z).mean())

    before = {k: net.p[k].copy() for k in ("in", "rec", "att", "out")}

    class Ones:
        def random(self, n):
            return np.ones(n)

    net.learn(ids, mask, y, cost, (index, gram, at), Ones())
    grads = {k: net.m[k] / 0.1 for k in before}
    for k in net.p:
        if k in before:
            net.p[k] = before[k]
    net2 = tox.Network(1)
    for k in ("word", "gram", "in_b", "out_b"):
        net.p[k] = net2.p[k].astype(np.float64)
    for k, g in grads.items():
        flat = np.abs(g).ravel().argsort()[-3:]
        for i in flat:
            step = 1e-2
            v = net.p[k].reshape(-1)
            old = v[i]
            v[i] = old + step
            up = loss()
            v[i] = old - step
            down = loss()
            v[i] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 0.05 * abs(g.reshape(-1)[i]) + 1e-4


def test_learns_and_scores_whole_texts():
    net = tox.train(CLEAN + RUDE, [0] * len(CLEAN) + [1] * len(RUDE))
    scorer = tox.Scorer(net)
    filler = CLEAN[0] * 200
    s = scorer([CLEAN[0], RUDE[0], filler, filler + " you grobnik grobnik you grobnik", "", None])
    assert s[1] > s[0] and s[3] > s[2] and s[4] == s[5] == net.base and ((s >= 0) & (s <= 1)).all()
    assert np.allclose(scorer([RUDE[0]]), scorer([RUDE[0]]))


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    got = tox.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    up, down = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([a > b for a in up for b in down]) > 0.8
    assert np.mean([r.predicted for r in got if not r.toxic]) < 0.1


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "word", 9), (2, "word", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    net = tox.fit(df, labels, tox.held_out)
    assert [r.score for r in tox.score(df, net).collect()] == [0.0] * 4
    assert tox.score(df.limit(0), net).count() == 0


def test_a_task_trains_and_not_the_driver(spark, monkeypatch):
    def train(texts, labels, prior):
        net = tox.Network()
        net.base = float(os.getpid())
        return net.frozen()

    monkeypatch.setattr(tox, "train", train)
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert tox.fit(docs, labels, tox.held_out).base not in (0.0, float(os.getpid()))
