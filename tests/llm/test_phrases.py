import random
import re
from collections import Counter

import pytest

from offerloom.llm import phrases


def brute(rows, least, top=2000):
    """All runs of 1 to 5 words, every cut, every longer phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in frequent.items():
        holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
        if any(o == lang and len(q) > len(p) and b >= a and holds(q) for (o, q), b in frequent.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, r, p.decode(), -a, left, right, n, -s) for lang, own in out.items() for r, (s, a, p, left, right, n) in enumerate(sorted(own)[:top], 1)}


def corpus(seed=1, size=160):
    r = random.Random(seed)
    rows = []
    for i in range(size):
        w = [r.choice(["the", "of", "The", "a,", "b", "été", "x.y", "\tthe of", "the of a", "c;d", "ß", "A B"]) for _ in range(r.randrange(30))]
        rows.append((r.choice(["en", "fr", None, "und"]), " ".join(w)))
    return rows + [("en", "one two three four five six seven " * 30)] * 3 + [("en", None), ("en", ""), (None, " \n,"), ("fr", "x" * 10_000 + " " + "word " * 20_000)]


@pytest.mark.parametrize("bound", [3, 20_000])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(phrases, "BOUND", bound)
    monkeypatch.setattr(phrases, "HELD", 500)
    rows = corpus()
    df = spark.createDataFrame([(lang, text, 1, "p") for lang, text in rows], "lang string, text string, a long, phrase string").repartition(3)
    got = phrases.mine(df, least=12, top=2000).drop("cut")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 12)


def test_ranks_through_a_tournament(spark):
    rows = corpus(2, 300)
    got = phrases.mine(spark.createDataFrame(rows, "lang string, text string"), least=3, top=2).drop("cut")
    assert {tuple(r) for r in got.collect()} == brute(rows, 3, 2)


def test_scores_past_64_bits(spark, monkeypatch):
    """Counts of a corpus of 10 ** 10 words, given in place of counted ones."""
    shape = "lang string, phrase string, size int, a long"
    found = spark.createDataFrame([("en", "a", 1, 3 * 10**9), ("en", "b", 1, 2 * 10**9 + 1), ("en", "a b", 2, 10**9 + 7)], shape)
    monkeypatch.setattr(phrases, "patterns", lambda *_: (found, spark.createDataFrame([("en", 10**10 + 3)], "lang string, n long")))
    (row,) = phrases.mine(spark.createDataFrame([], "lang string, text string")).collect()
    assert row.score == 1000 * (10**9 + 7) * (10**10 + 3) // (3 * 10**9 * (2 * 10**9 + 1)) and 1000 * row.a * row.n > 2**63


def test_odd_tables(spark):
    shape = "lang string, text string"
    assert phrases.mine(spark.createDataFrame([], shape)).collect() == []
    assert phrases.mine(spark.createDataFrame([("en", None), (None, "")], shape), least=1).collect() == []
    assert [tuple(r) for r in phrases.mine(spark.createDataFrame([(None, "a b")], shape), least=1).collect()] == [("und", 1, "a b", 1, 1, 1, 2, 2000, 1)]
