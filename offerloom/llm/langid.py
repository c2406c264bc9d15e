"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to 3 is counted on a bounded
sample of labelled texts and then frozen. The code length of a byte follows
PPM with escape method C and exclusions: the longest known context codes it, or
escapes to the next shorter one without the symbols already ruled out, down to
a uniform code over the bytes left. A text goes to the language whose tree
gives the shortest exact code.

With frozen statistics the code length depends only on the context state and
the byte, so the trees of all languages are flattened into one table
(state, byte) -> code lengths, and texts are scored by two table look-ups a
byte. The table has a row for every context of the sample, so its size grows with
the sample's contexts times its languages, and with nothing else. Bytes that no tree has seen behave alike and share one column.

Defined results: a null text, a text without any letter, or no labelled row at
all gives `und` with score 0; equal code lengths go to the first language in
alphabetical order; repeated rows are judged alone; an empty table gives an
empty table; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import fold_key, slices

PER_LANGUAGE = 400  # sampled texts of each language, about
ORDER = 3
PAD = b"\n" * ORDER


def raw(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


class ContextTrees:
    """Frozen statistics of all languages as look-up tables."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        data = [[np.frombuffer(PAD + raw(t), np.uint8) for t in samples[lang]] for lang in self.langs]
        seen = np.zeros(256, bool)
        seen[ord("\n")] = True
        for texts in data:
            for t in texts:
                seen[t] = True
        self.size = size = int(seen.sum()) + 1
        self.classes = np.full(256, size - 1, np.int32)
        self.classes[seen] = np.arange(size - 1)
        grams = []  # per language: codes of four symbols and how often they occur
        for texts in data:
            codes = [self.grams(self.classes[t]) for t in texts]
            grams.append(np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_counts=True))
        contexts = np.concatenate([g // size for g, _ in grams] or [np.zeros(0, np.int64)])
        full = np.unique(contexts)
        # States: all full contexts seen, then every shorter context that is a suffix of any seen one, then the empty one.
        two, one = np.unique(contexts % size**2), np.unique(contexts % size)
        base2, base1, base0 = len(full), len(full) + len(two), len(full) + len(two) + len(one)
        n_states = base0 + 1
        self.states = np.full(size**3, base0, np.int32)
        by_one = self.states.reshape(size * size, size)
        by_one[:, one] = base1 + np.arange(len(one), dtype=np.int32)
        by_two = self.states.reshape(size, size * size)
        by_two[:, two] = base2 + np.arange(len(two), dtype=np.int32)
        self.states[full] = np.arange(len(full), dtype=np.int32)
        parent2 = np.concatenate([full % size**2, two, np.full(len(one) + 1, -1)])
        parent1 = np.concatenate([full % size, two % size, one, [-1]])
        self.bits = np.zeros((n_states * size + 1, len(self.langs)), np.float32)  # the last row is for padding
        for k, (codes, n) in enumerate(grams):
            symbol, context = codes % size, codes // size

            def counts(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
                """How often each symbol follows each of the sorted contexts `keys`."""
                out = np.zeros((len(keys), size))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, rows), len(keys) - 1)
                    hit = keys[at] == rows
                    np.add.at(out, (at[hit], symbol[hit]), n[hit])
                return out

            order3, order2, order1 = counts(context, full), counts(context % size**2, two), counts(context % size, one)
            order0 = np.zeros((1, size))
            np.add.at(order0, (0, symbol), n)
            for begin in range(0, n_states, 4096):
                rows = np.arange(begin, min(begin + 4096, n_states))
                levels = [np.zeros((len(rows), size)) for _ in range(4)]
                if (m := rows < base2).any():
                    levels[0][m] = order3[rows[m]]
                if (m := parent2[rows] >= 0).any():
                    levels[1][m] = order2[np.searchsorted(two, parent2[rows[m]])]
                if (m := parent1[rows] >= 0).any():
                    levels[2][m] = order1[np.searchsorted(one, parent1[rows[m]])]
                levels[3][:] = order0
                self.bits[rows[0] * size : (rows[-1] + 1) * size, k] = self.lengths(levels).reshape(-1)

    def lengths(self, levels: list[np.ndarray]) -> np.ndarray:
        """Code lengths in bits of every symbol in every state, by escape method C with exclusions."""
        left = np.ones(len(levels[0]))
        excluded = np.zeros(levels[0].shape, bool)
        p = np.zeros(levels[0].shape)
        for count in levels:
            count = np.where(excluded, 0, count)
            distinct, total = (count > 0).sum(1), count.sum(1)
            whole = np.maximum(total + distinct, 1)
            p += left[:, None] * count / whole[:, None]
            left *= np.where(total > 0, distinct / whole, 1)
            excluded |= count > 0
        p = np.where(excluded, p, (left / (256 - excluded.sum(1)))[:, None])
        return -np.log2(p)

    def grams(self, c: np.ndarray) -> np.ndarray:
        """Codes of the symbol at each place after the padding together with the three before it."""
        c = c.astype(np.int64)
        return ((c[:-3] * self.size + c[1:-2]) * self.size + c[2:-1]) * self.size + c[3:]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Exact code lengths in bits, a row for each text and a column for each language."""
        parts = [PAD + raw(t) for t in texts]
        starts = np.cumsum([0, *map(len, parts)])
        c = self.classes[np.frombuffer(b"".join(parts), np.uint8)]
        row = np.full(len(c), len(self.bits) - 1, np.int64)
        row[3:] = self.states[(c[:-3] * self.size + c[1:-2]) * self.size + c[2:-1]].astype(np.int64) * self.size + c[3:]
        for k in range(ORDER):
            row[starts[:-1] + k] = len(self.bits) - 1
        return np.add.reduceat(self.bits[row], starts[:-1], axis=0, dtype=np.float64)


def fit(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> ContextTrees:
    """Trees counted on about `per_language` labelled texts of each language, chosen by a hash of their ids.

    One pass counts the languages; a second one keeps each row with the chance
    that its language needs, so no language is sorted and none is left out.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out)
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return ContextTrees({})
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) / 1_000_003
    sample = rows.filter(draw < share[F.col(lang_col)]).select(lang_col, text_col).limit(2 * per_language * len(sizes))
    texts: dict[str, list[str]] = {}
    for lang, text in sample.collect():
        texts.setdefault(lang, []).append(text)
    return ContextTrees(texts)


def identify(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with lang_pred, score (posterior of the best language, equal priors) and bits_per_byte."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for piece, texts in slices(batches, "text", 1_000_000):
            lettered = piece.column(2).to_pylist()
            if trees.langs:
                bits = trees.score(texts)
                best = bits.argmin(1)
                low = bits[np.arange(len(texts)), best]
                score = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                pred = [trees.langs[b] if ok else "und" for b, ok in zip(best, lettered)]
                score = [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]
                rate = [float(b) / max(1, len(raw(t))) for b, t in zip(low, texts)]
            else:
                pred, score, rate = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(pred), pa.array(score), pa.array(rate)], names=["id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lettered.alias("lettered"))
        .mapInArrow(scan, f"id {kind}, lang_pred string, score double, bits_per_byte double")
        .withColumnRenamed("id", id_col)
    )


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; folds of crc32(doc_id) mod 4 = 2 are held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = (fold_key(F.col("doc_id")) % 4) == 2
    found = identify(docs, fit(docs, held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
