import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerloom.llm import packing

TOKENIZER = Tokenizer.from_file(packing.tokenizer_path())
WORDS = packing.Words(packing.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1é²ª\n\t\x1c\x85\xa0'sß.,–漢", max_size=40))
def test_ids_equal_tokenizer(text):
    assert WORDS([text, None, text])[2].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_a_worker_learns_each_word_once(monkeypatch):
    learnt = []
    learn = packing.Words._learn
    monkeypatch.setattr(packing.Words, "_learn", lambda self, words: (learnt.extend(words), learn(self, words)) and None)
    packing.learnt.cache_clear()
    for _ in range(2):  # two tasks
        for texts in (["Ab cd, ef1 ab", None], ["cd ab  cd\n", ""]):
            got = packing.learnt(packing.tokenizer_path())(texts)
            assert [x.tolist() for x in got] == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(learnt) == len(set(learnt)) > 5


def test_ids_stay_when_words_are_forgotten():
    words = packing.Words(packing.tokenizer_path(), cache=3)
    for text in ("one two  three four", "five, six one two", "two one\n\nseven", "one two  three four"):
        assert words([text])[0].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=40), st.integers(1, 20))
def test_plan_uses_every_piece_once(histogram, groups):
    plan = packing.plan(histogram, capacity=100, small=10, groups=groups)
    used = Counter()
    for many, lengths in plan:
        assert many > 0 and sum(lengths) <= 100
        for n in lengths:
            used[n] += many
    assert used == Counter(histogram)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    histogram = Counter(int(n) for n in rng.integers(1, 1025, 50_000))
    bound = -(-sum(n * c for n, c in histogram.items()) // 1024)
    assert sum(m for m, _ in packing.plan(histogram)) <= 1.02 * bound


def check(docs, got):
    """Pieces round-trip to the tokenizer's ids, and sequences are gapless, disjoint and within the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for d, text in docs.items():
        ids = np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        rows = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(r.length for r in rows) == len(ids)
        assert all(r.length == 1024 for r in rows[1:])
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for rows in by_sequence.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = packing.op4_packing(spark, sf_dir).collect()
    n = check(docs, got)
    assert n <= 1.05 * sum(r.length for r in got) / 1024 + 2


def test_edge_rows(spark):
    docs = {1: None, 2: "", 3: "word " * 30_000, 4: "a", 5: "a"}
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id long, text string, length int")
    check(docs, packing.pack(packing.pieces(df).cache()).collect())
    doubled = packing.pack(packing.pieces(df.filter("doc_id = 4").union(df.filter("doc_id = 4"))).cache()).collect()
    assert len(doubled) == 2 and len({(r.sequence_id, r.offset) for r in doubled}) == 2
    assert packing.pack(packing.pieces(df.limit(0)).cache()).count() == 0
