"""Exact Jaccard join of documents on word n-grams, by a count-vector R-tree.

Texts are lower-cased (A-Z), cut into words at ASCII white space, and become
sets of 64-bit shingles of five words. Two documents link at a similarity of
0.75 or more. What is wanted is the components of that graph, so no group of
copies needs all its pairs. Equal sets are one class, known by its smallest id.

1. Tokens are hashed into fine groups (a range and 40 bits within it, so their
   number grows with the corpus) and the texts are read once. Blocks of
   documents send each group once to its range, which tells the groups that two
   classes have. Only these coordinates can add to a sum of coordinate minima,
   so a class with fewer of them than its least overlap can link with nothing
   and goes; what is left of the others is their point.
2. Of the smallest classes with which a class shares a minimum, the one with most
   shared minima is compared with it, and the links found are contracted. This
   costs a pair per class at most and folds
   large groups of near copies into one component each.
3. The rest is exact. The root of the tree has a branch for each fine coordinate,
   holding the points that are not zero there. By the same bound a point need
   only be under its rarest n - ceil(0.75 n) + 1 coordinates: two points that
   share none of those cannot reach the overlap. Branches whose points lie in
   one component drop out by a combinable aggregation. Within a branch, points
   have 64 coarse coordinates, ordered by size and packed into boxes of boxes;
   the tree is joined with itself from the top, and a pair of boxes is opened
   only if the summed minima of their upper corners reach the overlap that their
   smallest sets need. Branches with many points are cut into tiles, each pair
   of tiles being its own task.
4. All pairs kept are verified on the sets themselves.

The order of rarity comes from a table of hashed counts over all points. Its
size is fixed; a collision only changes the order, and any order is exact.

Defined results: null, empty and blank texts have no shingles, link with
nothing and are their own components; fewer than five words are one shingle;
rows with the same id count as one document, each row with its own set size; a
row without an id takes part in no link, its component is that of an equal set
or null; ids are cast to long, so one that is no number raises an error; an
empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import slices
from offerloom.llm.components import components, share_join
from offerloom.llm.durable import durable, written

WORDS, PERCENT = 5, 75
GROUPS = 64  # coarse coordinates of a point
MINIMA = 4
TABLE = 1 << 16  # hashed counts that order coordinates by rarity
TILE, FAN = 1024, 8  # points compared in one task, and under one R-tree node
FRONT = 1 << 17  # pairs of boxes looked at together
CACHE = 300_000  # distinct words whose keys a worker keeps
BLOCK_BYTES = 4_000_000  # text of which a worker sends each fine group once
RANGE_BYTES = 16_000_000  # text whose fine groups meet in one range, about
FINE = 40  # bits of a fine group within its range
KEY = 12  # bytes of a class's digest


class WordKeys:
    """Stable 64-bit keys of words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.keys = np.zeros(1024, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHE:
            self.number.clear()
        number = self.number
        for word in set(words).difference(number):
            at = number[word] = len(number)
            if at == len(self.keys):
                self.keys = np.concatenate([self.keys, np.zeros(at, np.uint64)])
            self.keys[at] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return self.keys[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]


def shingles(texts: list[str | None], keys: WordKeys, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of its text) of all texts, sorted by both, each once."""
    own = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]  # of bytes: A-Z and ASCII white space only
    many = np.fromiter(map(len, own), np.int64, len(own))
    k = keys(list(chain.from_iterable(own)))
    ends = np.cumsum(many)
    doc = np.repeat(np.arange(len(own), dtype=np.int32), many)
    values, owners = [], []
    for n in range(1, words + 1):  # shorter texts are one shingle
        begin = (ends - many)[many == n] if n < words else np.flatnonzero(doc[: max(0, len(k) - n + 1)] == doc[n - 1 :]) if len(k) >= n else np.zeros(0, np.int64)
        h = np.full(len(begin), n, np.uint64)
        for i in range(n):
            h = (h ^ k[begin + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        values.append(h)
        owners.append(doc[begin])
    h, doc = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def mixed(x: np.ndarray, m: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(m)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def digests(h: np.ndarray, doc: np.ndarray, many: int) -> np.ndarray:
    """A row of KEY bytes for each text: sums over its set, so in any order."""
    sums = np.zeros((2, many), np.uint64)
    np.add.at(sums[0], doc, mixed(h, 0xD6E8FEB86659FD93))
    np.add.at(sums[1], doc, mixed(h, 0xA0761D6478BD642F))
    return np.ascontiguousarray(sums.T).view(np.uint8).reshape(many, 16)[:, :KEY]


_MIX = (np.random.default_rng(11).integers(1, 1 << 62, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def minima(s: np.ndarray) -> np.ndarray:
    """For each of a few permutations the smallest value in the set, marked with the permutation."""
    low = np.array([((s * m) ^ (s >> np.uint64(17))).min() for m in _MIX])
    return (low * np.uint64(MINIMA) + np.arange(MINIMA, dtype=np.uint64)).view(np.int64)


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of n with any set at the threshold."""
    return -(-PERCENT * n // 100)


#: What travels: of kind 0 coordinates of classes (digest, how many, their fine groups), of 1 classes (digest,
#: set size, smallest id, rows), of 2 and 3 rows with and without an id (id, set size, digest), all as packed bytes.
_SENT = "place int, kind int, a binary, b binary, c binary, d binary"


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of whole numbers, plane by plane, so that equal high bytes stand together and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["place", "kind", "a", "b", "c", "d"])


def _dealt(part: np.ndarray, own: np.ndarray, key: np.ndarray, value: np.ndarray, width: int, first: int) -> list[tuple]:
    """Rows of kind 0 for each part: the classes met in it (`own` numbers rows of key), how many values each has, the values."""
    order = np.lexsort((own, part))
    part, own, value = part[order], own[order], value[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    out = []
    for x, y in zip(cuts, np.append(cuts[1:], len(part))):
        o = own[x:y]
        heads = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        many = np.diff(np.append(heads, len(o)))
        out.append((first + int(part[x]), 0, key[o[heads]].tobytes(), _planes(many, 4), _planes(value[x:y], width), None))
    return out


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (np.ascontiguousarray(key[:, :4]).view("<u4").ravel() % np.uint32(buckets)).astype(np.int64)


def _sent(docs: DataFrame, ranges: int, words: int) -> DataFrame:
    """Of each block of documents its fine groups by range, its classes and its rows."""

    def block(ids: list, texts: list, keys: WordKeys) -> list[tuple]:
        h, doc = shingles(texts, keys, words)
        n = np.bincount(doc, minlength=len(texts))
        key = digests(h, doc, len(texts))
        key[n == 0] = 0
        out = []
        for kind, mine in ((2, [i for i, x in enumerate(ids) if x is not None]), (3, [i for i, x in enumerate(ids) if x is None])):
            if mine:
                own = np.array([ids[i] or 0 for i in mine], np.int64)
                # The place only spreads the blocks; nothing is looked for there.
                out.append((2 * ranges + crc32(own.tobytes()) % ranges, kind, own.tobytes(), _planes(n[mine], 4), key[mine].tobytes(), None))
        # Classes: rows with an id and a word, equal digests as one.
        part = np.array([i for i, x in enumerate(ids) if x is not None and n[i]], np.int64)
        if not len(part):
            return out
        of = np.array([ids[i] for i in part], np.int64)
        two = np.ascontiguousarray(np.pad(key[part], ((0, 0), (0, 16 - KEY)))).view("<u8")
        order = np.lexsort((of, two[:, 1], two[:, 0]))
        new = np.append(True, (two[order][1:] != two[order][:-1]).any(1))
        lead = part[order[new]]
        rows = np.diff(np.append(np.flatnonzero(new), len(part)))
        at = _bucket(key[lead], ranges)
        for b in np.unique(at):
            m = lead[at == b]
            low = of[order[new]][at == b]
            out.append((ranges + int(b), 1, key[m].tobytes(), _planes(n[m], 4), low.tobytes(), _planes(rows[at == b], 4)))
        leads = np.zeros(len(texts), bool)
        leads[lead] = True
        keep = leads[doc]
        h, doc = h[keep], doc[keep]
        # A fine group that two classes of the block have is known to repeat; its range hears of it once, without a class.
        fine = np.uint64((1 << FINE) - 1)
        place, rest = (h % np.uint64(ranges)), (h // np.uint64(ranges)) & fine
        token = (place << np.uint64(FINE)) | rest
        head = np.append(True, h[1:] != h[:-1])
        twice = ~head
        twice[:-1] |= ~head[1:]
        here = np.flatnonzero(twice)
        out += _dealt(_bucket(key, ranges)[doc[here]], doc[here], key, token[here], 8, ranges)
        nobody = len(texts)
        tell = np.flatnonzero(head)
        own = np.where(twice[tell], nobody, doc[tell])
        return out + _dealt(place[tell].astype(np.int64), own, np.vstack([key, np.zeros((1, KEY), np.uint8)]), rest[tell], FINE // 8, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, texts, held = WordKeys(), [], [], 0
        for piece, own in slices(batches, "_text"):
            ids += piece.column(0).to_pylist()
            texts += own
            held += sum(len(t or "") + 16 for t in own)
            if held >= BLOCK_BYTES:
                yield from _rows(block(ids, texts, keys)).to_batches()
                ids, texts, held = [], [], 0
        if ids:
            yield from _rows(block(ids, texts, keys)).to_batches()

    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("_text")).mapInArrow(scan, _SENT)


def _entries(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, number of each value's key, keys as two columns) of the rows of kind 0."""
    rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b", "c"))) if r[0] == 0]
    key = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, KEY)
    many = np.concatenate([_numbers(r[2], 4) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    value = np.concatenate([_numbers(r[3], width) for r in rows]) if rows else np.zeros(0, np.uint64)
    two = np.ascontiguousarray(np.pad(key, ((0, 0), (0, 16 - KEY)))).view("<u8")
    return value, np.repeat(np.arange(len(key), dtype=np.int32), many), two


def _repeated(sent: DataFrame, ranges: int) -> DataFrame:
    """What was sent, with only those fine groups that two classes have, by bucket of class."""

    def meet(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        if place >= ranges:  # nothing to compare
            return table.set_column(0, "place", pa.array([place - ranges] * table.num_rows, pa.int32()))
        value, own, two = _entries(table, FINE // 8)
        order = np.argsort(value, kind="stable")
        value, own = value[order], own[order]
        head = np.append(True, value[1:] != value[:-1])
        run = np.cumsum(head, dtype=np.int32) - 1
        nobody = ~two.any(1)
        told = np.zeros(run[-1] + 1, bool)
        told[run[nobody[own]]] = True
        again = np.flatnonzero(~head)
        told[run[again[(two[own[again]] != two[own[again - 1]]).any(1)]]] = True
        tell = np.flatnonzero(told[run] & ~nobody[own])
        key = two.view(np.uint8).reshape(-1, 16)[:, :KEY]
        token = (np.uint64(place) << np.uint64(FINE)) | value[tell]
        return _rows(_dealt(_bucket(key, ranges)[own[tell]], own[tell], key, token, 8, 0))

    return sent.groupBy("place").applyInArrow(meet, _SENT)


_CLASS = "id long, n long, digest binary, many long, members binary, vector binary, minima array<bigint>"


def _classes(found: DataFrame, ranges: int) -> DataFrame:
    """A row for each class; only those that have enough repeated groups to link at all have members."""

    def gather(table: pa.Table) -> pa.Table:
        rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b", "c", "d"))) if r[0] == 1]
        key = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, KEY)
        own = np.ascontiguousarray(np.pad(key, ((0, 0), (0, 16 - KEY)))).view("<u8")
        n, many = (np.concatenate([_numbers(r[k], 4) for r in rows]).astype(np.int64) for k in (2, 4))
        low = np.frombuffer(b"".join(r[3] for r in rows), np.int64)
        value, of, two = _entries(table, 8)
        # Classes by digest, over both kinds of rows.
        every = np.concatenate([own, two])
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.append(True, (every[order][1:] != every[order][:-1]).any(1))
        number = np.empty(len(every), np.int64)
        number[order] = np.cumsum(new) - 1
        count = int(new.sum())
        first = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(first, number[: len(own)], low)
        size, rows_of = np.zeros(count, np.int64), np.zeros(count, np.int64)
        size[number[: len(own)]] = n
        np.add.at(rows_of, number[: len(own)], many)
        digest = np.zeros((count, 16), np.uint8)
        digest[number] = every.view(np.uint8).reshape(-1, 16)
        of = number[len(own) :][of]
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        keep = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])) if len(value) else np.zeros(0, bool)
        value, of = value[keep], of[keep]
        cuts = np.searchsorted(of, np.arange(count + 1))
        members, vectors, lows = [], [], []
        for k in range(count):
            s = value[cuts[k] : cuts[k + 1]]
            enough = len(s) and len(s) >= needed(int(size[k]))
            members.append(s.tobytes() if enough else None)
            vectors.append(np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype("<i4").tobytes() if enough else None)
            lows.append(minima(s) if enough else None)
        keys = [digest[k, :KEY].tobytes() for k in range(count)]
        return pa.table([pa.array(first), pa.array(size), pa.array(keys, pa.binary()), pa.array(rows_of), pa.array(members, pa.binary()), pa.array(vectors, pa.binary()), pa.array(lows, pa.list_(pa.int64()))], names=["id", "n", "digest", "many", "members", "vector", "minima"])

    return found.filter("kind < 2").groupBy("place").applyInArrow(gather, _CLASS)


def _documents(found: DataFrame) -> DataFrame:
    """(id, n, digest) of every row that was read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, ids, n, key in zip(*(batch.column(k).to_pylist() for k in range(4))):
                n = _numbers(n, 4).astype(np.int64)
                own = pa.array(np.frombuffer(ids, np.int64)) if kind == 2 else pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([own, pa.array(n), pa.array([key[i : i + KEY] for i in range(0, len(key), KEY)], pa.binary())], names=["id", "n", "digest"])

    return found.filter("kind >= 2").select("kind", "a", "b", "c").mapInArrow(scan, "id long, n long, digest binary")


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many points have a coordinate of each cell: at most TABLE rows, whatever the corpus."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(TABLE, np.int64)
        for batch in batches:
            for s in batch.column(0):
                table += np.bincount(_cell(np.frombuffer(s.as_buffer(), np.uint64)), minlength=TABLE)
        full = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(table[full])], names=["cell", "n"])

    out = np.zeros(TABLE, np.int64)
    for r in sets.select("members").mapInArrow(scan, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _cell(s: np.ndarray) -> np.ndarray:
    return (mixed(s, 0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)


def _branches(sets: DataFrame) -> DataFrame:
    """(id, shingle): the rarest coordinates of each point, as many as any similar one must share one of."""
    ranks = np.empty(TABLE, np.int64)
    ranks[np.argsort(_rarity(sets), kind="stable")] = np.arange(TABLE)
    order = sets.sparkSession.sparkContext.broadcast(ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, s in zip(batch.column(1).to_pylist(), batch.column(2)):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                # Of n coordinates those that no other point has come first of all; what is left of the prefix is this.
                keep = max(0, len(s) - needed(n) + 1)
                out.append(s[np.lexsort((s, order.value[_cell(s)]))[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "prefix"])

    return sets.select("id", "n", "members").mapInArrow(scan, "id long, prefix array<bigint>").select("id", F.explode("prefix").alias("shingle"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, further columns) whose sets are similar enough."""
    own = sets.select("id", "n", "members")
    both = pairs.join(own.toDF("b", "nb", "right"), "b").join(own.toDF("a", "na", "left"), "a")
    names = pairs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, left, right, m, n = batch.columns
            m, n = m.to_numpy(), n.to_numpy()
            keep = []
            for x, y, total in zip(left, right, m + n):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                least = -(-PERCENT * total // (100 + PERCENT))
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least else 0
                keep.append(bool(100 * common >= PERCENT * (total - common)) and common > 0)
            yield pa.RecordBatch.from_arrays(kept, names=names).filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return both.select(*names, "left", "right", "na", "nb").mapInArrow(scan, schema)


def candidates(n: np.ndarray, vectors: np.ndarray, component: np.ndarray, side: np.ndarray | None, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of one group (by default all are one) and different components whose count vectors allow the threshold.

    Within a group the points are ordered by set size and their largest
    coordinate and packed into boxes of FAN, those into boxes of FAN, up to one
    root for each group. The forest is joined with itself from the roots down.
    Points on the two sides (0 and 1) make pairs, or points that are both on 2, which all are by default.
    """
    group = np.zeros(len(n), np.int64) if group is None else group
    side = np.full(len(n), 2) if side is None else side
    order = np.lexsort((vectors.argmax(1), n, group))
    group, n, vectors, component, side = group[order], n[order], vectors[order], component[order], side[order]
    # Levels from the points up: where the children of each box begin, upper corner, size and component ranges.
    levels = [(None, group, vectors, n, n, component, component)]
    while True:
        _, g, top, low, high, c, d = levels[-1]
        head = np.append(True, g[1:] != g[:-1])
        first = np.flatnonzero(head)
        if len(first) == len(g) and len(levels) > 1:
            break
        at = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        begins = np.flatnonzero(at % FAN == 0)
        levels.append((np.append(begins, len(g)), g[begins], *(f.reduceat(x, begins, axis=0) for f, x in ((np.maximum, top), (np.minimum, low), (np.maximum, high), (np.minimum, c), (np.maximum, d)))))
    p = q = np.arange(len(levels[-1][1]))
    for k in range(len(levels) - 1, 0, -1):
        begins = levels[k][0]
        _, _, top, low, high, c, d = levels[k - 1]
        kept = []
        for x in range(0, len(p), FRONT // (FAN * FAN)):
            i, j = p[x : x + FRONT // (FAN * FAN)], q[x : x + FRONT // (FAN * FAN)]
            many = begins[j + 1] - begins[j]
            count = (begins[i + 1] - begins[i]) * many
            pair = np.repeat(np.arange(len(i)), count)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            a, b = begins[i][pair] + step // many[pair], begins[j][pair] + step % many[pair]
            ok = (a <= b) & (100 * high[b] >= PERCENT * low[a]) & (100 * high[a] >= PERCENT * low[b]) & ((c[a] != d[b]) | (c[b] != d[a]))
            if k == 1:
                ok &= (a < b) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[ok], b[ok]
            ok = np.minimum(top[a], top[b]).sum(1) * (100 + PERCENT) >= PERCENT * (low[a] + low[b])
            kept.append((a[ok], b[ok]))
        p, q = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 2
    return order[p], order[q]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Joins sorted batches so that no group of the first `keys` columns is cut; yields tables and where their groups begin."""

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in range(keys):
            c = table.column(k).to_numpy()
            new |= c[1:] != c[:-1]
        return np.append(0, np.flatnonzero(new) + 1)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        at = begins(held)
        if len(at) > 1:
            yield held.slice(0, at[-1]), at[:-1]
            held = held.slice(at[-1])
    if held is not None:
        yield held, begins(held)


def _met(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, ca, cb) of points under one branch or one pair of its tiles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 3):
            i, j, tile, node, component, n = (table.column(k).to_numpy() for k in range(1, 7))
            vectors = np.frombuffer(b"".join(table.column(7).to_pylist()), "<i4").reshape(-1, GROUPS)
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, table.num_rows)))
            p, q = candidates(n, vectors, component, np.where(i == j, 2, tile == j), group)
            swap = node[p] > node[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            met = np.unique(np.stack([node[p], node[q], component[p], component[q]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in met], names=["a", "b", "ca", "cb"])

    sorted_rows = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return sorted_rows.select("shingle", "i", "j", "tile", "node", "component", "n", "vector").mapInArrow(scan, "a long, b long, ca long, cb long").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: id, n_shingles and component_id. Ids are whole numbers."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(8, -(-total // RANGE_BYTES)))
    found = written(_repeated(_sent(docs, ranges, words), ranges), "jaccard-coordinates")
    classes = written(_classes(found, ranges), "jaccard-classes")
    rows = _documents(found)
    sets = classes.filter("members is not null")
    # Near copies first: everyone with a shared minimum against the smallest of them.
    keyed = sets.select("id", F.explode("minima").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("*").alias("w")).filter("a <> z")
    shared = share_join(keyed, hubs.select("key", "a", "w"), "key").filter("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("minima"))
    stars = shared.groupBy("b").agg(F.max_by("a", F.struct("minima", -F.col("a"))).alias("a")).select("a", "b")
    # An id with several sets is one document.
    several = rows.filter("n > 0 and id is not null").groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("id")
    same = rows.join(several, "id").join(classes.select("digest", F.col("id").alias("a")), "digest").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    coarse = durable(components(_verified(stars, sets).union(same)))
    # Then the exact rest between components.
    nodes = sets.join(coarse.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "vector", F.coalesce("component", "id").alias("component"))
    met = durable(_branches(sets).join(nodes.select("id", "component"), "id").select("shingle", F.col("id").alias("node"), "component"))
    live = met.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("w")).filter("low <> high").select("shingle", "w")
    tiles = F.ceil(F.col("w") / TILE).cast("int")
    rows_met = share_join(met, live, "shingle", keep=True).withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows_met = rows_met.select("shingle", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "component").join(nodes.select(F.col("id").alias("node"), "n", "vector"), "node")
    links = _verified(durable(_met(rows_met)), sets).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(links).withColumnRenamed("component", "final").withColumnRenamed("node", "component")
    # An id that is not the smallest of any class has a component too, when it has several sets.
    final = classes.select("digest", "id", F.col("many").alias("w")).join(coarse.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    final = final.join(merged, "component", "left").select("digest", "w", F.coalesce("final", "component").alias("class_component"))
    out = share_join(rows, final, "digest", how="left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class_component")).alias("component_id"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document at a shingle similarity of 0.75."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
f AS (SELECT doc_id, hash(unnest(shingles)) AS sh FROM s),
e AS (SELECT * FROM f WHERE sh IN (SELECT sh FROM f GROUP BY sh HAVING count(*) > 1)),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT l.b, r.reach FROM r JOIN l ON l.a = r.node WHERE r.reach < l.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""
