from collections import Counter, defaultdict

import numpy as np

from offerloom.llm import langid


def brute_bits(samples, text):
    """PPMC with exclusions, by dictionaries of contexts."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in samples:
        data = langid.PAD + langid.raw(t)
        for i in range(3, len(data)):
            for k in range(4):
                counts[k][data[i - k : i]][data[i]] += 1
    data, bits = langid.PAD + langid.raw(text), 0.0
    for i in range(3, len(data)):
        p, out, excluded = 1.0, None, set()
        for k in (3, 2, 1, 0):
            here = {s: n for s, n in counts[k][data[i - k : i]].items() if s not in excluded}
            if not here:
                continue
            whole = sum(here.values()) + len(here)
            if data[i] in here:
                out = p * here[data[i]] / whole
                break
            p *= len(here) / whole
            excluded |= set(here)
        bits -= np.log2(out if out is not None else p / (256 - len(excluded)))
    return bits


def test_code_lengths_equal_brute_force():
    samples = {"a": ["the cat sat on the mat", "a the hat"], "b": ["der hut und die katze", "und über"]}
    trees = langid.ContextTrees(samples)
    texts = ["the hut", "", "zzz über ∂", "mat" * 50, None]
    got = trees.score(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(trees.langs):
            assert abs(got[i, k] - brute_bits(samples[lang], t)) < 1e-2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [r for r in got.collect() if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_edge_rows(spark):
    rows = [(1, "the cat and the dog", "en", 0.0), (3, "der hund und die katze", "de", 0.0), (4, None, None, 0.0), (5, "123 !!", "en", 0.0), (None, "the cat", None, 0.0), (3, "die " * 50_000, "de", 1.0), (7, "", "en", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.identify(df, langid.fit(df, langid.F.lit(False))).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (4, 5, 7)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0), langid.fit(df.limit(0), langid.F.lit(False))).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.fit(df.limit(0), langid.F.lit(False))).collect()} == {"und"}
