import numpy as np

from offerloom.llm import quality

GOOD = [f"The small house number {k} stands near the river and the green garden. We walked home." for k in range(30)]
BAD = [f"BUY!! NOW!! {k} $$$ the the the the the &&& ###" for k in range(30)]


def test_votes_equal_brute_force():
    model = quality.train(GOOD + BAD, [1] * 30 + [0] * 30, 0.5)
    texts = [GOOD[0] + " again", BAD[0] + " !!", "", None]
    got = model.score(texts, quality.Tokens())
    for t, s in zip(texts, got):
        x = model.latent(quality.features(t, quality.Tokens())[None])[0]
        sims = [(float(x @ v), -k) for k, v in enumerate(model.vectors)]
        near = sorted(sims, reverse=True)[: quality.NEIGHBOURS]
        w = np.maximum([a for a, _ in near], 0) ** 4
        want = (sum(w * model.labels[[-k for _, k in near]]) + quality.BASE * 0.5) / (w.sum() + quality.BASE)
        assert abs(s - want) < 1e-3
    assert got[0] > 0.7 > 0.3 > got[1] and got[2] == got[3]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    up, down = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([a > b for a in up for b in down]) > 0.95
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "word " * 50_000, 9), (2, "word", 9), (2, "word", 9)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none, quality.held_out)
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5] * 5
    assert quality.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    scores = [r.score for r in quality.score(docs, quality.fit(docs, labels, quality.held_out)).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[3] == scores[4]
