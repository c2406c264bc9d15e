"""Collocations by contiguous pattern growth (PrefixSpan on word sequences).

Everything is per language. Words that are frequent are counted first, then
hashes of the pairs of frequent words, which leave out most pairs that are not
frequent (a hash counts at least what its pairs do); the pairs left are prefixes.
A prefix's projection has, for every place where it occurs, the words that follow
there, cut where no frequent pattern can go on; equal followers met in one task
are one row with their number, and their sum is the pair's exact count. One task takes a prefix and grows it to the right
depth-first: pointers into the projection are dealt out by the next word, and
each word that reaches the support is followed at once. A prefix of more than
BOUND rows is not gathered: one distributed count extends it by one word, its
frequent extensions are prefixes with projections of their own, and so on, so
no task holds more than BOUND rows of a projection.

What is frequent is told to the tasks by a bitmap of hashes of at most MOST_BITS
bits, whatever the corpus; it only saves work, as every count is made on the
words themselves. Scores are exact decimals of 38 digits.

Defined results: null texts are empty and give nothing; a null language is
`und`, together with texts marked so; repeated rows count each time; a very long
text is read whole (its words are held one text at a time); ties of score and
count go by the phrase's bytes; a cut's ties go to the shorter first part; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.durable import written
from offerloom.llm.packed import LOW, low_bits, low_keys, mixed, pack, ranged, unpack

LEAST, LONGEST, TOP = 100, 5, 2000
BOUND = 20_000  # rows of a projection that one task grows at most
HELD = 1_000_000  # words that a task counts at a time
MOST_BITS = 1 << 27
RANGE = 2_000_000  # words of the corpus for each range of pair hashes

# What ends a piece; a byte that no text has stands for it.
ENDS, END = b".,;:!?\x0a\x0b\x0c\x0d", b"\xff"
FOLD = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + END * len(ENDS))


def words(text: bytes) -> list[bytes]:
    """Lower-case words, with END between pieces."""
    return text.translate(FOLD).replace(END, b" \xff ").split()


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """(language, numbers of its words in order, the words by number) of about HELD words at a time; number 0 is END."""

    def fresh() -> dict:
        names = defaultdict(count().__next__)
        names[END]
        return {"names": names, "parts": []}

    held, n = defaultdict(fresh), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = words(text.as_py())
            if found:
                own = held[lang]
                own["parts"].append(np.fromiter(map(own["names"].__getitem__, found), np.int64, len(found)))
                own["parts"].append(np.zeros(1, np.int64))
                n += len(found)
            if n >= HELD:
                yield from ((k, np.concatenate(v["parts"]), list(v["names"])) for k, v in held.items())
                held, n = defaultdict(fresh), 0
    yield from ((k, np.concatenate(v["parts"]), list(v["names"])) for k, v in held.items())


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _batch(lang: str, *columns: pa.Array, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns], names=["lang", *names])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, names in streams(batches):
        n = np.bincount(ids, minlength=len(names))[1:]
        yield _batch(lang, _strings(names[1:]), pa.array(n), names=["phrase", "a"])


def _hashes(lang: str, names: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode() + END)
    return np.array([zlib.crc32(w, seed) for w in names], np.int64)


def _hash(word):
    return F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(END), F.col(word).cast("binary")))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits at the hashes h, 16 for each of them and MOST_BITS at most, built in the tasks 32768 bits at a time."""
    bits = 1 << 15
    while bits < min(MOST_BITS, 16 * hashes.count()):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    found = hashes.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for part, held in found.groupBy("part").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(held, np.uint8)
    return np.unpackbits(out, bitorder="little").astype(bool)


def _pairs(lang: str, ids: np.ndarray, names: list[bytes], frequent: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose word and next word are frequent, in order of the pair: the places, and each distinct pair's first of them and hash."""
    h = _hashes(lang, names)
    known = frequent[h & (len(frequent) - 1)]
    known[0] = False
    at = np.flatnonzero(known[ids[:-1]] & known[ids[1:]])
    codes = ids[at] * len(names) + ids[at + 1]
    order = np.argsort(codes, kind="stable")
    at, codes = at[order], codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    u = h.astype(np.uint64)
    return at, first, ranged(mixed(u[ids[at[first]]], u[ids[at[first] + 1]]), ranges)


def _joined(names: pa.Array, *parts: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*(names.take(pa.array(p)) for p in parts), pa.scalar(b" ", pa.binary()))


def grow(lang: str, prefix: str, tails: list[list[str]], n: list[int], least: int) -> Iterator[tuple[str, int, int]]:
    """(phrase, number of words, occurrences) of all frequent extensions of a prefix, depth-first over pointers (rows) into its projection."""

    def deeper(phrase: str, size: int, rows: list[int], depth: int) -> Iterator[tuple[str, int, int]]:
        following: dict[str, list[int]] = defaultdict(list)
        for r in rows:
            if depth < len(tails[r]):
                following[tails[r][depth]].append(r)
        for word, own in following.items():
            a = sum(n[r] for r in own)
            if a >= least:
                yield f"{phrase} {word}", size + 1, a
                yield from deeper(f"{phrase} {word}", size + 1, own, depth + 1)

    yield from deeper(prefix, prefix.count(" ") + 1, list(range(len(tails))), 0)


def patterns(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Occurrences (lang, phrase, size, a) of every frequent phrase of 1 to `longest` words, and each language's number n of words; docs: lang, text (binary)."""
    context = docs.sparkSession.sparkContext
    counted = written(docs.mapInArrow(count_words, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")), "words")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    single = counted.filter(F.col("a") >= least)
    first_words = context.broadcast(bitmap(single.select(_hash("phrase").alias("h"))))

    ranges = -(-(totals.agg(F.sum("n")).first()[0] or 0) // RANGE) or 1

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of pairs with their numbers, in a block for each range."""
        for lang, ids, names in streams(batches):
            at, first, keys = _pairs(lang, ids, names, first_words.value, ranges)
            if len(keys):
                order = np.argsort(keys)
                keys, n = keys[order], np.diff(first, append=len(at))[order]
                used, begins = np.unique(keys >> LOW, return_index=True)
                cuts = [*begins.tolist(), len(keys)]
                blocks = [[f(x[a:b]) for a, b in zip(cuts, cuts[1:])] for f, x in ((low_bits, keys), (lambda v: pack(v, 4), n))]
                yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(b, pa.binary()) for b in blocks)], names=["range", "keys", "n"])

    def add_up(key, table):
        """Hashes of a range that are met often enough."""
        keys, where = np.unique(np.concatenate([low_keys(k) for k in table["keys"].to_pylist()]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([unpack(b, 4) for b in table["n"].to_pylist()]))
        return pa.table({"h": pa.array(keys[n >= least] | key[0].as_py() << LOW)})

    likely = written(docs.mapInArrow(pairs, "range long, keys binary, n binary").groupBy("range").applyInArrow(add_up, "h long"), "pairs")
    second = context.broadcast(bitmap(likely))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Followers of every pair, as far as likely pairs go on; none where the next pair is not likely."""
        for lang, ids, names in streams(batches):
            at, first, keys = _pairs(lang, ids, names, first_words.value, ranges)
            good = np.zeros(len(ids) + longest, bool)
            good[at[np.repeat(second.value[keys & (len(second.value) - 1)], np.diff(first, append=len(at)))]] = True
            start = np.flatnonzero(good)
            padded = np.append(ids, np.zeros(longest, np.int64))
            # Equal runs of words become one row: codes of the run so far and its next word, renumbered step by step.
            code, open_ = padded[start] * len(names) + padded[start + 1], np.ones(len(start), bool)
            sizes = np.full(len(start), 2)
            for k in range(2, longest):
                open_ = open_ & good[start + k - 1]
                sizes += open_
                _, code = np.unique(code, return_inverse=True)
                code = code * len(names) + np.where(open_, padded[start + k], 0)
            _, firsts, n = np.unique(code, return_index=True, return_counts=True)
            text = pa.array(names, pa.binary())
            start, sizes = start[firsts], sizes[firsts]
            for size in range(2, longest + 1):
                m = sizes == size
                if m.any():
                    columns = [padded[start[m] + k] for k in range(size)]
                    tail = _joined(text, *columns[2:]).view(pa.string()) if size > 2 else pa.nulls(int(m.sum()), pa.string())
                    yield _batch(lang, _joined(text, *columns[:2]).view(pa.string()), tail, pa.array(n[m]), names=["prefix", "tail", "n"])

    def grown(key, table):
        lang, prefix = (k.as_py() for k in key)
        found = list(grow(lang, prefix, [t.split(" ") for t in table["tail"].to_pylist()], table["n"].to_pylist(), least))
        return pa.table([pa.array([lang] * len(found), pa.string()), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64())))], names=["lang", "phrase", "size", "a"])

    shape, key = "lang string, phrase string, size int, a long", ["lang", "prefix"]
    found = single.select("lang", "phrase", F.lit(1).alias("size"), "a")
    onward = written(docs.mapInArrow(project, "lang string, prefix string, tail string, n long"), "projected")
    for size in range(2, longest + 1):
        # The prefixes at hand have `size` words; their counts and numbers of rows come from one pass.
        prefixes = written(onward.groupBy(key).agg(F.sum("n").alias("a"), F.count("tail").alias("m")).filter(F.col("a") >= least), "prefixes")
        found = found.union(prefixes.select("lang", "prefix", F.lit(size), "a"))
        rows, large = onward.filter(F.col("tail").isNotNull()), prefixes.filter(F.col("m") > BOUND)
        found = found.union(rows.join(prefixes.filter((F.col("m") > 0) & (F.col("m") <= BOUND)), key, "left_semi").groupBy(key).applyInArrow(grown, shape))
        if size == longest or large.isEmpty():
            break
        rest = F.when(F.contains("tail", F.lit(" ")), F.expr("substring(tail, char_length(substring_index(tail, ' ', 1)) + 2)"))
        onward = written(rows.join(large, key, "left_semi").select("lang", F.concat_ws(" ", "prefix", F.substring_index("tail", " ", 1)).alias("prefix"), rest.alias("tail"), "n"), "projected")
    return written(found, "patterns"), totals


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score, cut (words of the first part)."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found, totals = patterns(own, least, longest)
    several = found.filter("size > 1")
    split = F.split("phrase", " ")
    # A phrase is part of a longer one of equal count only if it is part of one that is a word longer.
    inner = F.array(F.array_join(F.slice(split, 1, F.size(split) - 1), " "), F.array_join(F.slice(split, 2, F.size(split) - 1), " "))
    covered = found.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.size(split) - 1), lambda k: F.struct(k.alias("cut"), F.array_join(F.slice(split, 1, k), " ").alias("first"), F.array_join(F.slice(split, k + 1, F.size(split)), " ").alias("rest")))
    parts = several.join(covered, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = parts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(19,0)) * r)"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    best = written(best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score", "s.cut"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Rounds of a tournament, so that no language is ranked in one task before it is short.
    lanes = -(-best.count() // (10 * top))
    while lanes > 1:
        lane = F.pmod(F.xxhash64("phrase"), F.lit(lanes))
        best = best.withColumn("k", F.row_number().over(Window.partitionBy("lang", lane).orderBy(*order))).filter(F.col("k") <= top).drop("k")
        lanes = lanes // 10
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


#: Counts all runs of 1 to 5 words of every piece, without growth or projections.
OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM runs GROUP BY lang, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
inside AS (SELECT DISTINCT lang, a, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase FROM f, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS k) WHERE k < m AND i + k - 1 <= m),
kept AS (SELECT * FROM f WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = f.lang AND inside.phrase = f.phrase AND 100 * inside.a >= 100 * f.a)),
cuts AS (SELECT kept.*, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y FROM kept, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.a, fx.a AS l, fy.a AS r, n, k, ((1000::HUGEINT * c.a * n) // (fx.a::HUGEINT * fy.a))::BIGINT AS score FROM cuts c JOIN f fx ON fx.lang = c.lang AND fx.phrase = c.x JOIN f fy ON fy.lang = c.lang AND fy.phrase = c.y JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
"""
