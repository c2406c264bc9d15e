import random

import numpy as np

from offerloom.llm import decontam


def brute(item, passage):
    best = 0
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            s = 2 if item[i - 1] == passage[j - 1] else -1
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        score, first, end = decontam.align(np.array(a), np.array(b))
        assert score == brute(a, b)
        if score:
            assert brute(a, b[first:end]) == score


def test_documents_equal_brute_force(spark, sf_dir):
    docs = [(r.doc_id, decontam.words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, decontam.words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for d, text in docs:
        for i, item in items:
            if len(set(item) & set(text)) >= 0.4 * len(set(item)):
                number = {}
                a, b = (np.array([number.setdefault(w, len(number)) for w in x]) for x in (item, text))
                if decontam.align(a, b)[0] >= min(len(item), 60):
                    want.add((d, i))
    got = decontam.op8_decontamination(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    tables = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(decontam.contaminated(*tables, broadcast=-1).collect()) == sorted(got)


def test_edited_copies_and_edge_rows(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    edited = [w if k % 8 else "other" for k, w in enumerate(item)]
    noise = [rng.choice(vocabulary) for _ in range(3000)]
    rows = [(1, " ".join(noise + item + noise)), (2, " ".join(noise + edited)), (3, " ".join(noise)), (4, None), (5, ""), (None, " ".join(item)), (1, " ".join(noise + item + noise))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "two words"), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[1, 7].score == 1 and got[1, 7].first_word == 3000 and got[1, 7].end_word == 3040
    assert decontam.contaminated(docs.limit(0), items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_edited_copy_beside_a_verbatim_one(spark):
    """Every fourth word changed: the n-grams that are left are not the rarest of their neighbours."""
    item = [f"w{k}" for k in range(15)]
    edited = [w if k % 4 != 2 else f"other{k}" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(edited))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.contaminated(docs, items).collect()}
    assert got == {1: 1.0, 2: brute(item, edited) / 30} and got[2] >= 0.5


def test_long_items_are_aligned_whole(spark):
    """An item of 400 words of which seven in twelve are kept, far into a long text."""
    rng = random.Random(2)
    item = [f"w{rng.randrange(5000)}" for _ in range(400)]
    edited = [w if k % 12 < 7 else f"x{k}" for k, w in enumerate(item)]
    text = [f"n{k}" for k in range(5000)] + edited + [f"m{k}" for k in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item))], "item_id long, text string")
    score, first, end = decontam.align(*(lambda n: [np.array([n.setdefault(w, len(n)) for w in x]) for x in (item, text)])({}))
    got = decontam.contaminated(docs, items).collect()
    assert {r.item_id for r in got} == {7, 8}
    assert all((r.score, r.first_word, r.end_word) == (score / 800, first, end) for r in got)
