import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import interpolation as lm


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def crc(i):
    return zlib.crc32(str(i).encode())


class Plain:
    """The same model with dictionaries, one token at a time."""

    def __init__(self, texts):
        self.one, self.two, self.three, self.n = Counter(), Counter(), Counter(), len(texts)
        for w in texts:
            s = ["<b>", "<b>", *w]
            self.one.update(w)
            self.two.update(zip(s[1:], s[2:]))
            self.three.update(zip(s, s[1:], s[2:]))
        self.total = sum(self.one.values())

    def tokens(self, w, distinct):
        s = ["<b>", "<b>", *w]
        for u, v, x in zip(s, s[1:], s[2:]):
            cv = self.n if v == "<b>" else self.one[v]
            cuv = self.n if v == "<b>" else self.two[u, v]
            f = [self.three[u, v, x] / max(cuv, 1), self.two[v, x] / max(cv, 1), self.one[x] / max(self.total, 1), 1 / (distinct + 1)]
            yield (min(cuv.bit_length(), 15), min(cv.bit_length(), 23)), f


def plain_scores(rows, rounds=lm.ROUNDS):
    learnt = [i for i, _ in rows if crc(i) % 7 != 2]
    texts = {i: tokens(t) for i, t in rows}
    gone = {i for i in learnt if crc(i) // 7 % lm.DELETED == 0}
    kept, every = Plain([texts[i] for i in learnt if i not in gone]), Plain([texts[i] for i in learnt])
    distinct = len(every.one)
    met = [x for i in gone for x in kept.tokens(texts[i], distinct)]
    usable = lambda b: [b[0] > 0, b[1] > 0, kept.total > 0, True]
    expected, weights = {}, None

    def mixed():
        pooled = defaultdict(lambda: np.zeros(4))
        for b, e in expected.items():
            pooled[tuple(usable(b))] += e

        def of(b):
            kinds = np.array(usable(b), float)
            p = pooled[tuple(usable(b))]
            p = (p / p.sum() if p.sum() else kinds / kinds.sum()) + 1e-4 * kinds
            e = expected.get(b, np.zeros(4)) + p / p.sum()
            return e / e.sum()

        return of

    weights = mixed()
    for _ in range(rounds):
        found = defaultdict(lambda: np.zeros(4))
        for b, f in met:
            share = weights(b) * f
            found[b] += share / share.sum()
        before, expected = weights, dict(found)
        weights = mixed()
        if max(np.abs(weights((a, b)) - before((a, b))).max() for a in range(16) for b in range(24)) < 1e-4:
            break
    score = {i: sum(math.log10(weights(b) @ f) for b, f in every.tokens(w, distinct)) for i, w in texts.items()}
    base = {i: sum(math.log10((every.one[x] + 1) / (every.total + distinct + 1)) for x in w) for i, w in texts.items()}
    known = {i: sum(every.one[x] > 0 for x in w) for i, w in texts.items()}
    return score, base, known, every.total


def corpus(n=400):
    r = random.Random(4)
    names = ["The", "of", "a,", "été", "ß.", *(f"w{k}" for k in range(60))]
    follow = {w: [r.choice(names) for _ in range(3)] for w in names}
    rows = []
    for i in range(n):
        w = [r.choice(names)]
        for _ in range(r.randrange(40)):
            w.append(r.choice(follow.get(w[-1], names)) if r.random() < 0.8 else r.choice([*names, f"x{r.randrange(500)}"]))
        rows.append((i, r.choice([" ", "\n", "\t", " \r"]).join(w)))
    return [*rows, (900, ""), (901, None), (902, rows[3][1]), (903, "the of " * 5000)]


@pytest.mark.parametrize("held,keys", [(2_000_000, 2_000_000), (700, 300)])
def test_against_brute_force(spark, monkeypatch, held, keys):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "RANGE", keys)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, held_out string, score double").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
    score, base, known, total = plain_scores(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 7 == 2, len(tokens(t)), known[i], total)
        assert r.base_score == pytest.approx(base[i], abs=1e-9 * len(tokens(t))) and r.score == pytest.approx(score[i], rel=1e-4)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    """Over all learnt words and one unknown, whatever the bucket."""
    texts = [tokens("a b a c"), tokens("b a"), tokens("c c a b")]
    own, weights = Plain(texts), lm.weights_of(np.random.default_rng(1).random((lm.BUCKETS, 4)) * lm.usable(5), lm.usable(5))
    words = [*own.one, "unknown"]
    for u, v in [("a", "b"), ("b", "a"), ("c", "c"), ("a", "zz"), ("zz", "a"), ("zz", "zz")]:
        total = 0
        for x in words:
            b, f = list(own.tokens([u, v, x], len(own.one)))[2]
            total += weights[b[0] * lm.CONTEXT2 + b[1]] @ np.array(f)
        assert total == pytest.approx(1, abs=1e-9) or v in ("</s>",)


def test_odd_tables(spark):
    shape = "doc_id string, text string"
    out = lambda df: [tuple(r) for r in lm.score(df, F.crc32("doc_id") % 7 == 2).collect()]
    assert out(spark.createDataFrame([], shape)) == []
    held = next(str(i) for i in range(99) if crc(i) % 7 == 2)
    assert out(spark.createDataFrame([(held, "a b"), (held, None)], shape)) in ([(held, True, 3, 0, 0, 0.0, 0.0), (held, True, 1, 0, 0, 0.0, 0.0)], [(held, True, 1, 0, 0, 0.0, 0.0), (held, True, 3, 0, 0, 0.0, 0.0)])
    learnt = next(str(i) for i in range(99) if crc(i) % 7 != 2)
    rows = out(spark.createDataFrame([(None, "a b"), (None, "a b"), (learnt, None)], shape))
    assert sorted(r[2:5] for r in rows) == [(1, 1, 7), (3, 3, 7), (3, 3, 7)] and all(r[6] < 0 for r in rows)
