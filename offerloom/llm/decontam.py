"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

1. All word 3-grams of the benchmark are seeds. Which of them an edit destroys
   is not known beforehand, and the rarest are the likeliest, so none is left
   out: three words left intact are found.
2. A scan finds seeds in the documents. A bitmap of fixed size, built from the
   benchmark, lets it drop nearly all other n-grams where they arise; it has no
   false negatives, so it loses nothing when the benchmark outgrows it.
3. A join on the seed pairs documents with items. Only the texts of documents in
   a pair are read again, which another bitmap picks out. A benchmark whose size
   was checked to be under BROADCAST bytes goes to the documents instead, as a
   sorted table of seeds, and steps 2 to 4 are one scan with the same result.
4. Each pair is aligned by Smith-Waterman over words (match 2, mismatch and gap
   -1), the whole item against the passages around its seeds, after a test that
   the words in common could reach the threshold at all. An alignment with a
   score above nothing spans at most three words for each of the item, so a
   passage reaches that far on both sides of a seed and no alignment through a
   seed is cut.

A copy without three words in a row intact is not found, though its alignment
may reach the threshold (a word put in after every other one).

The result has one row per document and item whose best local alignment reaches
`threshold` of a perfect one over the item (over 60 words of a longer item):
the score (share of a perfect alignment over the whole item, 1 at most), and the
first word and the end of the copy in the document.

Defined results: null and empty texts match nothing; an item of fewer than
three words is not searched for; rows with the same id, null included, count as
one document; ties between alignments go to the earlier passage; an empty
table on either side gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import slices
from offerloom.llm.durable import durable

N = 3  # words in a seed
THRESHOLD, LONG = 0.5, 60  # share of a perfect alignment, over at most so many words
REACH = 3  # words of a document that an alignment can span for each word of the item
BROADCAST = 16_000_000  # bytes of benchmark texts up to which they are sent to every executor
BITS = 1 << 24
CACHE = 300_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class WordKeys(dict):
    """Stable 64-bit keys of words."""

    def __missing__(self, word: str) -> int:
        key = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1
        if len(self) > CACHE:
            self.clear()
        self[word] = key
        return key


def gram_keys(keys: np.ndarray, n: int = N) -> np.ndarray:
    """A 64-bit key for each run of n words."""
    out = np.zeros(max(0, len(keys) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = (out ^ keys[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _keys_of(text: str | None, keys: WordKeys) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a text's words and of its n-grams."""
    own = words(text)
    own = np.fromiter(map(keys.__getitem__, own), np.uint64, len(own))
    return own, gram_keys(own)


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(40)).astype(np.int64)  # 24 bits


def _slot(key):
    """The same bucket in SQL, from 1."""
    return F.shiftrightunsigned(key, 40) + 1


def bitmap(rows: DataFrame, slot) -> np.ndarray:
    """Which of BITS slots the rows have: 512 rows of 4 KB, whatever the number of rows."""
    rows = rows.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = bucket(keys)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def item_grams(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, place, gram) of all n-grams of the benchmark."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys()
        for piece, texts in slices(batches, "_text"):
            grams = [_keys_of(t, keys)[1] for t in texts]
            many = [len(g) for g in grams]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(np.concatenate([np.arange(m) for m in many]).astype(np.int32)), pa.array(np.concatenate(grams))], names=["item", "place", "gram"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col).alias("item"), F.col(text_col).alias("_text")).mapInArrow(scan, f"item {kind}, place int, gram long")


def hits(docs: DataFrame, seeded: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, gram): the distinct seeds of each document, and by chance a few other n-grams."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(seeded, _slot(F.col("gram"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys()
        for piece, texts in slices(batches, "_text"):
            grams = [_keys_of(t, keys)[1] for t in texts]
            grams = [np.unique(g[_known(bits.value, g)]) for g in grams]
            rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(rows, pa.int64())), pa.array(np.concatenate(grams))], names=["doc", "gram"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).mapInArrow(scan, f"doc {kind}, gram long")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two arrays of word numbers: score, first word and end in the passage.

    A cell holds its score above 40 bits that count down from the place where
    its alignment began, so one maximum settles both.
    """
    shift, low = 40, (1 << 40) - 1
    unit = 1 << shift
    zero = low - np.arange(len(passage) + 1, dtype=np.int64)
    slope = np.arange(len(passage) + 1, dtype=np.int64) * unit
    above, best, end = zero.copy(), 0, 0
    for w in item:
        row = np.maximum(zero, above - unit)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == w, 2 * unit, -unit))
        row = np.maximum.accumulate(row + slope) - slope
        row = np.where(row >> shift <= 0, zero, row)
        at = int(row.argmax())
        if row[at] >> shift > best >> shift:
            best, end = int(row[at]), at
        above = row
    return best >> shift, low - (best & low), end


def around(item: np.ndarray, own: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Stretches of a document (its n-gram keys) that reach so many words around the seeds of an item."""
    at = np.flatnonzero(np.isin(own, item))
    out: list[tuple[int, int]] = []
    for a, b in zip(np.maximum(at - reach, 0).tolist(), (at + N + reach).tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Item:
    """An item's seeds and its words by number; a number past the end stands for any other word."""

    def __init__(self, keys: np.ndarray):
        self.seeds = np.unique(gram_keys(keys))
        self.vocabulary, self.words = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(self.words)

    def best(self, own: np.ndarray, grams: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
        """Score, first word and end of the best alignment through a seed, if it reaches the threshold."""
        n = len(self.words)
        need, best = threshold * 2 * min(n, LONG), (0, 0, 0)
        for a, b in around(self.seeds, grams, REACH * n):
            passage = own[a:b]
            at = np.minimum(np.searchsorted(self.vocabulary, passage), len(self.vocabulary) - 1)
            at[self.vocabulary[at] != passage] = len(self.vocabulary)
            if 2 * np.minimum(np.bincount(at, minlength=len(self.counts))[: len(self.counts)], self.counts).sum() < need:
                continue
            s, p, q = align(self.words, at)
            if s > best[0]:
                best = (s, a + p, a + q)
        return (best[0] / (2 * n), best[1], best[2]) if best[0] and best[0] >= need else None


_SCORED = "score double, first_word long, end_word long"


def _scored(doc: pa.Array, item: pa.Array, found: list[tuple[float, int, int]]) -> pa.RecordBatch:
    score, first, end = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([doc, item, pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["doc", "item", "score", "first_word", "end_word"])


def verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Scores of pairs (doc, item, text of the document, text of the item) that reach the threshold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, items = WordKeys(), {}
        for batch in batches:
            row, scores = [], []
            for i, text, other in zip(range(batch.num_rows), batch.column(2), batch.column(3).to_pylist()):
                if other not in items:
                    if len(items) > 10_000:
                        items.clear()
                    items[other] = Item(_keys_of(other, keys)[0])
                found = items[other].best(*_keys_of(text.as_py(), keys), threshold)
                if found:
                    row.append(i)
                    scores.append(found)
            at = pa.array(row, pa.int64())
            yield _scored(batch.column(0).take(at), batch.column(1).take(at), scores)

    doc, item = (pairs.schema[c].dataType.simpleString() for c in ("doc", "item"))
    return pairs.select("doc", "item", "_text", "text").mapInArrow(scan, f"doc {doc}, item {item}, {_SCORED}")


def scanned(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Scores of all pairs; the benchmark (item, text) goes to every executor, so its size must have been checked."""
    rows = texts.filter("text is not null").collect()
    own = docs.sparkSession.sparkContext.broadcast([r["text"] for r in rows])
    ids = docs.sparkSession.sparkContext.broadcast(pa.array([r["item"] for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys()
        items = [Item(_keys_of(t, keys)[0]) for t in own.value]
        seeds = np.concatenate([i.seeds for i in items] or [np.zeros(0, np.int64)])
        of = np.repeat(np.arange(len(items)), [len(i.seeds) for i in items])
        order = np.argsort(seeds, kind="stable")
        seeds, of = seeds[order], of[order]
        bits = np.zeros(BITS // 8, np.uint8)
        np.bitwise_or.at(bits, bucket(seeds) >> 3, (1 << (bucket(seeds) & 7)).astype(np.uint8))
        for piece, texts in slices(batches, "_text"):
            doc, item, found = [], [], []
            for i, text in enumerate(texts):
                k, grams = _keys_of(text, keys)
                hit = np.unique(grams[_known(bits, grams)])
                low, high = np.searchsorted(seeds, hit), np.searchsorted(seeds, hit, side="right")
                for j in np.unique(np.concatenate([of[a:b] for a, b in zip(low, high)] or [of[:0]])):
                    if best := items[j].best(k, grams, threshold):
                        doc.append(i)
                        item.append(j)
                        found.append(best)
            yield _scored(piece.column(0).take(pa.array(doc, pa.int64())), ids.value.take(pa.array(item, pa.int64())).cast(kind), found)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(texts.schema["item"].dataType)
    schema = f"doc {docs.schema[id_col].dataType.simpleString()}, item {texts.schema['item'].dataType.simpleString()}, {_SCORED}"
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).mapInArrow(scan, schema)


def joined(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Scores of all pairs, whatever the size of the benchmark."""
    seeded = durable(item_grams(texts, "item", "text").select("item", "gram").distinct())
    pairs = durable(hits(docs, seeded, id_col, text_col).join(seeded, "gram").select("doc", "item").distinct())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(pairs, slot(F.col("doc"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy() - 1
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)).select([0, 1])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), slot(F.col(id_col)).alias("_slot")).mapInArrow(pick, f"_doc {kind}, _text string")
    own = texts.select(F.col("item").alias("_item"), "text")
    both = pairs.join(own, F.col("item").eqNullSafe(F.col("_item"))).join(read, F.col("doc").eqNullSafe(F.col("_doc")))
    return verify(both, threshold)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, broadcast: int = BROADCAST) -> DataFrame:
    """One row per document and benchmark item that the document holds a copy of."""
    texts = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scored = (scanned if size <= broadcast else joined)(docs, texts, id_col, text_col, threshold)
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"), -F.col("end_word"))).alias("b")
    return scored.groupBy("doc", "item").agg(best).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.*")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold copies of benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
