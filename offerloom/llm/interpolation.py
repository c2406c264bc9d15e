"""Language-model scores by deleted interpolation of word trigrams.

The probability of a word is a mixture of its maximum-likelihood estimates after
two words, after one word and alone, and of 1 / (V + 1); the four weights depend
on how often the two contexts were met (powers of two), so each bucket of
contexts has weights of its own. A share of the learning texts (1 / DELETED,
chosen by a hash) is deleted from the counts and the weights are learnt by
expectation-maximisation on its tokens; scores then use the counts of both parts.

Texts are read once. Tasks write chunks of about HELD tokens, numbered within
the chunk, to the shared folder. Each chunk asks for the counts of its distinct
words, pairs and triples: requests go in blocks to ranges of keys, a range adds
up what all chunks count and answers each block, and answers come back to the
chunk. So a key goes over the network once for each chunk that has it, however
frequent it is; a range has about RANGE keys at any size of the corpus, and no
count is sent to the driver or to all executors. A chunk has no more blocks than
keys, so many ranges cost a row for each key at worst.

Words, their counts and all base figures are exact. Pairs and triples are told
apart by 40 bits and their range (46 bits or more from 64 ranges on, growing
with the corpus); a clash would add two counts of the model.

Defined results: a null or empty text is its end alone; ids may be null or
repeat, each row is scored for itself; a null id counts as not held out; long
texts are scored whole (one text is held in a task at a time); without learning
texts every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import fold_key
from offerloom.llm.durable import written
from offerloom.llm.packed import LOW, low_bits, low_keys, mixed, pack, ranged, unpack

HELD = 2_000_000  # tokens of a chunk, about
RANGE = 2_000_000  # requested keys of a range, about
DELETED = 20  # one learning text in so many is deleted from the counts
ROUNDS = 15
PAIRS, TRIPLES = 1, 2  # kinds of requests; 0 are words
CONTEXT3, CONTEXT2 = 16, 24  # buckets of the longer and of the shorter context
BUCKETS = CONTEXT3 * CONTEXT2
BEFORE, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)  # any two hashes


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def chunks(docs: DataFrame, kind: str) -> DataFrame:
    """Chunks of texts of one part: docs (id, text (binary), learnt, deleted) -> numbers of their words, and the words."""

    def close(part: dict, number: int, deleted: bool) -> pa.RecordBatch:
        names, seq = list(part["names"]), np.concatenate([np.zeros(0, np.int64), *part["parts"]])
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(seq, minlength=len(names)), kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        lengths, learnt = np.array(part["lengths"], np.int64), np.array(part["learnt"], bool)
        values = [number, deleted, len(seq) + len(lengths), int(lengths[learnt].sum()) + int(learnt.sum()), int(learnt.sum()), len(names)]
        packed = [learnt.tobytes(), pack(lengths, 4), pack(place[seq], 4), zstandard.compress(b"\n".join(names[k] for k in order), 1)]
        columns = [pa.array([v]) for v in values] + [pa.array([part["ids"]], pa.list_(part["kind"]))] + [pa.array([v], pa.binary()) for v in packed]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "deleted", "tokens", "learnt_tokens", "learnt_texts", "distinct", "ids", "learnt", "lengths", "seq", "words"])

    def fresh() -> dict:
        return {"names": defaultdict(count().__next__), "parts": [], "lengths": [], "learnt": [], "ids": [], "n": 0}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = {True: fresh(), False: fresh()}, count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for i, (text, learnt, deleted) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                part, found = held[deleted], words(text.as_py())
                part["parts"].append(np.fromiter(map(part["names"].__getitem__, found), np.int64, len(found)))
                part["lengths"].append(len(found))
                part["learnt"].append(learnt)
                part["ids"].append(batch.column(0)[i])
                part["kind"] = batch.schema.field(0).type
                part["n"] += len(found) + 1
                if part["n"] >= HELD:
                    yield close(part, next(number), deleted)
                    held[deleted] = fresh()
        for deleted, part in held.items():
            if part["ids"]:
                yield close(part, next(number), deleted)

    shape = f"chunk long, deleted boolean, tokens long, learnt_tokens long, learnt_texts long, distinct long, ids array<{kind}>, learnt binary, lengths binary, seq binary, words binary"
    return written(docs.mapInArrow(read, shape), "chunks")


class Chunk:
    """A chunk's tokens as arrays, each text followed by its end, and the keys of what it counts."""

    def __init__(self, row: dict, ranges: tuple[int, int]):
        joined = zstandard.decompress(row["words"])
        self.words = joined.split(b"\n") if joined else []
        self.ranges = ranges
        lengths, seq = unpack(row["lengths"], 4), unpack(row["seq"], 4)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        self.word_range = ((hashes >> np.uint64(LOW)) * np.uint64(ranges[0]) >> np.uint64(64 - LOW)).astype(np.int64)
        n = len(self.words)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.w = np.full(len(seq) + len(lengths), n, np.int64)  # number n is the end
        inside = np.ones(len(self.w), bool)
        inside[self.starts + lengths] = False
        self.w[inside] = seq
        self.learnt = np.repeat(np.frombuffer(row["learnt"], bool), lengths + 1)
        self.sizes = lengths + 1
        h = np.append(hashes, END)[self.w]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.starts] = BEFORE
        pair = mixed(before, h)
        context = np.empty_like(pair)
        context[1:] = pair[:-1]
        context[self.starts] = BEFORE
        self.keys = {PAIRS: ranged(pair, ranges[1]), TRIPLES: ranged(mixed(context, h), ranges[1])}

    def distinct(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys (words: their numbers, by range), and where each token finds its own."""
        if kind:
            return np.unique(self.keys[kind], return_inverse=True)
        order = np.argsort(self.word_range, kind="stable")
        where = np.empty(len(order) + 1, np.int64)
        where[order] = np.arange(len(order))
        where[-1] = len(order)  # ends are not requested
        return order, where[self.w]


def requests(chunked: DataFrame, ranges: tuple[int, int]) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own = Chunk(row, ranges)
                for kind in (0, PAIRS, TRIPLES):
                    keys, where = own.distinct(kind)
                    n = np.bincount(where, weights=own.learnt, minlength=len(keys)).astype(np.int64)
                    place = keys >> LOW if kind else own.word_range[keys]
                    used, begins = np.unique(place, return_index=True)
                    cuts = [*begins.tolist(), len(keys)]
                    block = (lambda a, b: low_bits(keys[a:b])) if kind else (lambda a, b: zstandard.compress(b"\n".join(own.words[k] for k in keys[a:b]), 1))  # noqa: B023
                    for begin in range(0, len(used), 64):
                        some = range(begin, min(begin + 64, len(used)))
                        m = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array(used[begin : begin + m]), pa.array([row["chunk"]] * m), pa.array([row["deleted"]] * m), pa.array([block(cuts[k], cuts[k + 1]) for k in some], pa.binary()), pa.array([pack(n[cuts[k] : cuts[k + 1]], 4) for k in some], pa.binary())], names=["kind", "range", "chunk", "deleted", "keys", "n"])

    columns = ["chunk", "deleted", "learnt", "lengths", "seq", "words"]
    return chunked.select(columns).mapInArrow(ask, "kind int, range long, chunk long, deleted boolean, keys binary, n binary")


def answers(asked: DataFrame) -> DataFrame:
    """Counts in the kept and in the deleted part for each block, and the number of learnt words of a range (chunk -1)."""

    def answer(key, table):
        kind = key[0].as_py()
        rows = table.select(["chunk", "deleted", "keys", "n"]).to_pylist()
        if kind:
            blocks = [low_keys(r["keys"]) for r in rows]
            sizes = [len(b) for b in blocks]
            _, where = np.unique(np.concatenate(blocks), return_inverse=True)
        else:
            number = defaultdict(count().__next__)
            blocks = [[number[w] for w in zstandard.decompress(r["keys"]).split(b"\n")] for r in rows]
            sizes = [len(b) for b in blocks]
            where = np.array([k for b in blocks for k in b], np.int64)
        n = np.concatenate([unpack(r["n"], 4) for r in rows]).astype(np.float64)
        gone = np.repeat([r["deleted"] for r in rows], sizes)
        kept = np.bincount(where, weights=np.where(gone, 0, n)).astype(np.int64)
        away = np.bincount(where, weights=np.where(gone, n, 0)).astype(np.int64)
        cuts = np.cumsum([0, *sizes])
        mine = [where[cuts[k] : cuts[k + 1]] for k in range(len(rows))]
        learnt = int(((kept + away) > 0).sum()) if kind == 0 else 0
        return pa.table({
            "chunk": pa.array([r["chunk"] for r in rows] + [-1]),
            "deleted": pa.array([r["deleted"] for r in rows] + [False]),
            "kind": pa.array([kind] * (len(rows) + 1), pa.int32()),
            "range": pa.array([key[1].as_py()] * (len(rows) + 1)),
            "kept": pa.array([pack(kept[m], 5) for m in mine] + [b""], pa.binary()),
            "away": pa.array([pack(away[m], 5) for m in mine] + [b""], pa.binary()),
            "distinct": pa.array([0] * len(rows) + [learnt]),
        })

    return written(asked.groupBy("kind", "range").applyInArrow(answer, "chunk long, deleted boolean, kind int, range long, kept binary, away binary, distinct long"), "answers")


class Counts:
    """What a chunk's tokens are estimated from, by the counts of the kept part or of both."""

    def __init__(self, own: Chunk, replies: list[dict], texts: int, tokens: int, distinct: int, both: bool):
        found = {}
        for kind in (0, PAIRS, TRIPLES):
            parts = [unpack(r["kept"], 5) + (unpack(r["away"], 5) if both else 0) for r in sorted((r for r in replies if r["kind"] == kind), key=lambda r: r["range"])]
            n = np.concatenate([np.zeros(0, np.int64), *parts])
            found[kind] = (n if kind else np.append(n, texts))[own.distinct(kind)[1]]
        word, pair, triple = found[0], found[PAIRS], found[TRIPLES]
        before, context = np.empty_like(word), np.empty_like(pair)
        before[1:], context[1:] = word[:-1], pair[:-1]
        before[own.starts] = context[own.starts] = texts
        self.word = word
        self.bucket = np.minimum(np.frexp(context)[1], CONTEXT3 - 1) * CONTEXT2 + np.minimum(np.frexp(before)[1], CONTEXT2 - 1)
        self.estimates = np.stack([triple / np.maximum(context, 1), pair / np.maximum(before, 1), word / max(tokens, 1), np.full(len(word), 1 / (distinct + 1))], 1)


def usable(tokens: int) -> np.ndarray:
    """Which of the four estimates a bucket has at all."""
    out = np.ones((BUCKETS, 4), bool)
    out[:CONTEXT2, 0] = False
    out[::CONTEXT2, 1] = False
    out[:, 2] = tokens > 0
    return out


def weights_of(expected: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Weights from expected counts; each bucket gets one token more, dealt out as in all buckets with the same estimates."""
    out = np.zeros((BUCKETS, 4))
    for kinds in np.unique(given, axis=0):
        same = (given == kinds).all(1)
        pooled = expected[same].sum(0)
        pooled = (pooled / pooled.sum() if pooled.sum() else kinds / kinds.sum()) + 1e-4 * kinds
        own = expected[same] + pooled / pooled.sum()
        out[same] = own / own.sum(1, keepdims=True)
    return out


def learnt_weights(chunked: DataFrame, replied: DataFrame, ranges: tuple[int, int], texts: int, tokens: int, distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of all buckets from the deleted texts' tokens, estimated by the counts of the kept ones."""

    def features(key, record, replies):
        (row,), told = record.to_pylist(), replies.to_pylist()
        own = Counts(Chunk(row, ranges), told, texts, tokens, distinct, both=False)
        cuts = range(0, len(own.bucket), 500_000)
        return pa.table({"bucket": pa.array([own.bucket[k : k + 500_000].astype(np.uint16).tobytes() for k in cuts], pa.binary()), "estimates": pa.array([own.estimates[k : k + 500_000, :3].astype(np.float32).tobytes() for k in cuts], pa.binary())})

    columns = ["chunk", "learnt", "lengths", "seq", "words"]
    left = chunked.filter("deleted").select(columns).groupBy("chunk")
    table = written(left.cogroup(replied.filter("deleted and chunk >= 0").groupBy("chunk")).applyInArrow(features, "bucket binary, estimates binary"), "deleted_tokens")
    given = usable(tokens)
    weights = weights_of(np.zeros((BUCKETS, 4)), given)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS, 4))
            for batch in batches:
                for b, f in zip(batch.column(0), batch.column(1)):
                    bucket, known = np.frombuffer(b.as_py(), np.uint16), np.frombuffer(f.as_py(), np.float32).reshape(-1, 3)
                    share = weights[bucket]
                    share[:, :3] *= known
                    share[:, 3] /= distinct + 1
                    share /= share.sum(1, keepdims=True)
                    for k in range(4):
                        total[:, k] += np.bincount(bucket, weights=share[:, k], minlength=BUCKETS)
            met = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(total[met, k]) for k in range(4))], names=["bucket", "a", "b", "c", "d"])

        sums = table.mapInArrow(expect, "bucket long, a double, b double, c double, d double").groupBy("bucket").agg(*(F.sum(c) for c in "abcd"))
        expected = np.zeros((BUCKETS, 4))
        for r in sums.collect():
            expected[r[0]] = r[1:]
        before, weights = weights, weights_of(expected, given)
        if np.abs(weights - before).max() < 1e-4:
            break
    return weights


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, held_out, n_tokens, n_known, train_tokens, base_score and score; texts not held out are learnt from."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = F.coalesce(held_out, F.lit(False))
    drawn = F.pmod(F.coalesce(F.floor(fold_key(F.col(id_col)) / 7), F.lit(1)), F.lit(DELETED)) == 0
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), (~out).alias("learnt"), (~out & drawn).alias("deleted"))
    chunked = chunks(own, kind)
    size = chunked.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "learnt_tokens", "learnt_texts")), *(F.coalesce(F.sum(F.when(~F.col("deleted"), F.col(c))), F.lit(0)) for c in ("learnt_tokens", "learnt_texts"))).first()
    all_tokens, all_words, tokens, texts, kept_tokens, kept_texts = size
    ranges = (max(1, -(-all_words // RANGE)), max(1, -(-all_tokens // RANGE)))
    replied = answers(requests(chunked, ranges))
    distinct = (replied.agg(F.sum("distinct")).first()[0] or 0) + (texts > 0)
    weights = learnt_weights(chunked, replied, ranges, kept_texts, kept_tokens, distinct)
    if not tokens:
        weights = weights_of(np.zeros((BUCKETS, 4)), usable(0))

    def rate(key, record, replies):
        (row,), told = record.to_pylist(), replies.to_pylist()
        chunk = Chunk(row, ranges)
        own = Counts(chunk, told, texts, tokens, distinct, both=True)
        base = np.log10((own.word + 1) / (tokens + (distinct + 1)))
        likely = np.log10((weights[own.bucket] * own.estimates).sum(1))
        total = lambda x: np.add.reduceat(x, chunk.starts)
        m = len(chunk.starts)
        return pa.table({
            "id": record["ids"].combine_chunks().flatten(),
            "held_out": pa.array(~np.frombuffer(row["learnt"], bool)),
            "n_tokens": pa.array(chunk.sizes),
            "n_known": pa.array(total((own.word > 0).astype(np.int64))),
            "train_tokens": pa.array([tokens] * m, pa.int64()),
            "base_score": pa.array(total(base)),
            "score": pa.array(total(likely)),
        })

    columns = ["chunk", "ids", "learnt", "lengths", "seq", "words"]
    pairs = chunked.select(columns).groupBy("chunk").cogroup(replied.filter("chunk >= 0").groupBy("chunk"))
    return pairs.applyInArrow(rate, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; folds of crc32(doc_id) mod 7 = 2 are not learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, (fold_key(F.col("doc_id")) % 7) == 2)
