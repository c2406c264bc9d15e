"""Best-fit packing of tokenised documents by linear grouping.

Pieces are packed by their lengths alone, and there are at most `capacity` of
those, so the plan is computed from a histogram whose size does not depend on
the corpus:

1. large lengths are sorted and cut into groups of equal cardinality, and each
   is rounded up to the longest of its group, which leaves few sizes;
2. the fewest sequences over all configurations of those sizes are found by
   column generation (a linear program whose columns come from a knapsack) and
   rounded down; what is left, less than a sequence for each size, is filled
   largest first with an exact subset sum;
3. the actual lengths of each group replace the rounded ones, longest first;
   sequences that rounding left loose are taken apart and their lengths filled
   exactly, each being its own size;
4. small lengths go where they fit best, and open new sequences at the end.

The plan says which ranks of each length take which places. The pieces get
their ranks by distributed counting over salted groups, so a length that holds
most of all pieces is spread over many tasks, and look up their places.

Defined results: a null text counts as empty and gives one piece, the end
token; a null id is kept; repeated rows are packed each; an empty table gives
an empty table; further columns of the input are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.arrow import slices
from offerloom.llm.durable import durable

CAPACITY, END = 1024, 2
SMALL = 128  # lengths below are packed last, by best fit
GROUPS = 32  # sizes left after rounding
ROUNDS, SLACK = 1, 2  # times that loose sequences are grouped anew; what a sequence that stays may lack
STEPS = 2_000  # configurations that may enter the optimum; it is reached long before
PER_SALT = 4_000  # pieces of a length ranked together, about
CACHE = 600_000  # distinct words whose ids a worker keeps
JOINED = 256  # words given to the tokenizer in one string
#: Up to this character the word pattern below is known to cut as the tokenizer does; other texts are given to it whole.
PLAIN = 0x24F


def _pattern() -> tuple[re.Pattern, re.Pattern]:
    """The tokenizer's word pattern for characters up to PLAIN, and a search for any other one."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(PLAIN + 1) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    letter, number, blank = kinds["L"], kinds["N"], r"\t-\r \x85\xa0"
    word = rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    return re.compile(word), re.compile(f"[^\x00-{chr(PLAIN)}]|<\\|endoftext\\|>")


class Numbers(dict):
    """Numbers of words by first sight; `new` holds those that were not asked for before."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Words:
    """Ids of texts by the tokenizer, which is asked once for each distinct word."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.word, self.odd = _pattern()
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.store, self.begin, self.many = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        joins = np.fromiter((w[0] == " " and w[-1].isalpha() for w in words), bool, len(words))  # letters behind a blank: end to end, the tokenizer cuts them as they are
        joined, single = [words[i] for i in np.flatnonzero(joins)], [words[i] for i in np.flatnonzero(~joins)]
        ids, many = [], []
        for i in range(0, len(joined), JOINED):
            found = self.tokenizer.encode("".join(joined[i : i + JOINED]), add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            many.append(np.bincount(found.word_ids))
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in single]
        many.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), "<u4", many[-1].sum()))
        counts, own = np.concatenate(many), np.empty(len(words), np.int64)
        own[np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])] = np.arange(len(words))
        self.begin = np.append(self.begin, (len(self.store) + np.cumsum(counts) - counts)[own])
        self.store, self.many = np.concatenate([self.store, *ids]), np.append(self.many, counts[own])

    def _plain(self, text: str) -> bool:
        """Whether the word pattern cuts the text as the tokenizer does."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not self.odd.search(text)
        return "<|endoftext|>" not in text

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > self.cache:
            self.forget()
        words, counts, whole = [], [], []
        for i, text in enumerate(texts):
            before = len(words)
            if text and self._plain(text):
                words += self.word.findall(text)
            elif text:
                whole.append(i)
            counts.append(len(words) - before)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new, self.number.new = self.number.new, []
        if new:
            self._learn(new)
        many = self.many[at]
        ends = np.cumsum(many)
        ids = self.store[np.repeat(self.begin[at] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        out = [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
        for i, found in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(found.ids, "<u4")
        return out


@lru_cache(maxsize=1)
def learnt(path: str) -> Words:
    """Words that one task has learnt serve the next of the same worker."""
    return Words(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids; of a longer document the first one may be shorter than the others.

    `path` names the tokenizer's file on every executor; by default each asks
    its own installation. `with_ids` adds the ids themselves.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = learnt(path or tokenizer_path())
        end = np.array([END], "<u4")
        for part, texts in slices(batches, "_text", 1_000_000):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, own_ids in enumerate(words(texts)):
                data = np.append(own_ids, end)
                n = len(data)
                first = n % capacity or capacity
                for k, a in enumerate([0, *range(first, n, capacity)]):
                    b = first if k == 0 else a + capacity
                    own = data[a:b]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own.data))
                    if with_ids:
                        ids.append(own.astype(np.int32))
            columns = [part.column(1).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("id")).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def fill(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the most worth within the capacity (unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = sizes <= room
        if fits.any():
            gain = np.where(fits, best[room - np.minimum(sizes, room)] + worth, -1.0)
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], last[room] = gain[k], k
    out, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            out[last[room]] += 1
            room -= sizes[last[room]]
    return out


def optimum(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (columns) and how often to use each, in fractions, so that the fewest sequences hold all items.

    Column generation: the duals of the present basis price a knapsack, whose
    best filling enters the basis while it is worth more than one sequence.
    """
    columns = np.diag(capacity // sizes).astype(float)
    for _ in range(STEPS):
        inverse = np.linalg.inv(columns)
        level = inverse @ counts
        entering = fill(sizes, inverse.sum(0), capacity)
        if inverse.sum(0) @ entering <= 1 + 1e-7:
            break
        rate = inverse @ entering
        ratio = np.where(rate > 1e-9, np.maximum(level, 0) / np.where(rate > 1e-9, rate, 1), np.inf)
        leaving = int(ratio.argmin())
        if not np.isfinite(ratio[leaving]):
            break
        columns[:, leaving] = entering
    return columns.astype(np.int64), np.maximum(np.linalg.inv(columns) @ counts, 0)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """How often to use which configuration (indices into descending sizes) so that all items are used.

    The optimum over fractions is rounded down; the few items left, less than a
    sequence for each size, are filled one sequence after another, largest first.
    """
    left, out = list(counts), []
    if sizes:
        columns, level = optimum(np.array(sizes), np.array(counts, float), capacity)
        for k in np.argsort(-level, kind="stable"):
            need = {i: int(c) for i, c in enumerate(columns[:, k]) if c}
            times = min(int(level[k] + 1e-6), *(left[i] // c for i, c in need.items()))
            if times:
                out.append((times, [i for i, c in need.items() for _ in range(c)]))
                for i, c in need.items():
                    left[i] -= c * times
    return out + largest_first(sizes, left, capacity)


def largest_first(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Configurations of the items left: the largest size, and an exact subset sum over the others."""
    left, out = list(counts), []
    for big in range(len(sizes)):
        while left[big]:
            left[big] -= 1
            room = capacity - sizes[big]
            mask = (1 << (room + 1)) - 1
            reach, steps = 1, []
            for i in range(big, len(sizes)):
                if not left[i] or sizes[i] > room:
                    continue
                before, step = reach, 1
                many = min(left[i], room // sizes[i])
                while many:  # binary splitting of a bounded multiplicity
                    take = min(step, many)
                    reach |= (reach << (take * sizes[i])) & mask
                    many -= take
                    step *= 2
                steps.append((i, before))
                if reach >> room & 1:
                    break
            total, own = reach.bit_length() - 1, [big]
            for i, before in reversed(steps):
                while not before >> total & 1:
                    total -= sizes[i]
                    own.append(i)
            left[big] += 1
            need: dict[int, int] = {}
            for i in own:
                need[i] = need.get(i, 0) + 1
            times = min(left[i] // k for i, k in need.items())
            for i, k in need.items():
                left[i] -= k * times
            out.append((times, own))
    return out


def grouped(large: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths in groups of equal cardinality as [length, count], longest first; groups that start with the same length are one."""
    stock: list[list[list[int]]] = []
    held = target = max(1, -(-sum(large.values()) // groups))
    for n in sorted(large, reverse=True):
        count = large[n]
        while count:
            if held == target:
                held = 0
                if not stock or stock[-1][0][0] != n:
                    stock.append([])
            take = min(count, target - held)
            stock[-1].append([n, take])
            held += take
            count -= take
    return stock


def substituted(used: list[tuple[int, list[int]]], stock: list[list[list[int]]]) -> list[tuple[int, list[int]]]:
    """Actual lengths of each group in place of its size, longest first; a run of equal sequences splits where one of its lengths changes."""
    out = []
    for s in stock:
        s.reverse()
    for times, own in used:
        streams = []
        for i in own:
            stream, need = [], times
            while need:
                n, have = stock[i][-1]
                take = min(have, need)
                stream.append([n, take])
                need -= take
                stock[i][-1][1] -= take
                if not stock[i][-1][1]:
                    stock[i].pop()
            streams.append(stream[::-1])
        while streams[0]:
            run = min(s[-1][1] for s in streams)
            out.append((run, [s[-1][0] for s in streams]))
            for s in streams:
                s[-1][1] -= run
                if not s[-1][1]:
                    s.pop()
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Sequences as (how many, lengths in each). Depends on the histogram only."""
    left = {n: c for n, c in histogram.items() if n >= small and c}
    done: list[tuple[int, list[int]]] = []
    for _ in range(ROUNDS):
        if not left:
            break
        stock = grouped(left, groups)
        used = configurations([s[0][0] for s in stock], [sum(c for _, c in s) for s in stock], capacity)
        for many, lengths in substituted(used, stock):
            if sum(lengths) >= capacity - SLACK:
                done.append((many, lengths))
                for n in lengths:
                    left[n] -= many
        left = {n: c for n, c in left.items() if c}
    # What rounding left loose is filled exactly, each length being its own size.
    sizes = sorted(left, reverse=True)
    done += [(many, [sizes[i] for i in own]) for many, own in largest_first(sizes, [left[n] for n in sizes], capacity)]
    rooms: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for many, lengths in done:
        rooms[capacity - sum(lengths)].append((many, lengths))
    # Small lengths by best fit, longest first.
    for n in sorted((n for n in histogram if n < small), reverse=True):
        count = histogram[n]
        for room in range(n, capacity + 1):
            while count and rooms[room]:
                many, lengths = rooms[room].pop()
                each = min(room // n, count)
                bins = min(many, count // each)
                count -= bins * each
                if many > bins:
                    rooms[room].append((many - bins, lengths))
                rooms[room - n * each].append((bins, lengths + [n] * each))
            if not count:
                break
        each = capacity // n
        if count >= each:
            rooms[capacity - each * n].append((count // each, [n] * each))
        if count % each:
            rooms[capacity - n * (count % each)].append((1, [n] * (count % each)))
    return [x for room in rooms for x in room]


def places(sequences: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, first sequence, offset): ranks of a length from `first rank` on take consecutive sequences."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for many, lengths in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, rank.get(n, 0), base, offset))
            rank[n] = rank.get(n, 0) + many
            offset += n
        base += many
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces. `cut` is read twice, so it should be durable."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))
    found = cut.sparkSession.sparkContext.broadcast(table)  # configurations of at most `capacity` lengths, whatever the corpus
    # As many salts as each length's own pieces need.
    salts = F.array(*[F.lit(1 + histogram.get(n, 0) // PER_SALT) for n in range(1, capacity + 1)])
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.element_at(salts, F.col("length").cast("int")).cast("long")))
    spread = salted.repartition("length", "_salt")
    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32")).cast("long"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "_salt").count()
    offsets = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = ranked.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before") - 1)
    columns = [c for c in cut.columns if c != "ids"] + [c for c in cut.columns if c == "ids"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = found.value
        firsts = np.searchsorted(t["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                a, b = firsts[n], firsts[n + 1]
                at[own] = a + np.searchsorted(t["rank"][a:b], rank[own], side="right") - 1
            sequence = t["sequence"][at] + rank - t["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence), pa.array(t["offset"][at])], names=[*batch.schema.names[2:], "sequence_id", "offset"])

    rows = ranked.select(F.col("length").alias("_length"), "_rank", *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(put, f"{schema}, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return pack(durable(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
