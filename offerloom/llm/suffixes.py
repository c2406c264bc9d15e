"""Removal of long repeated byte strings by bucket-pointer refinement.

Every byte goes that is covered by a string of `span` (50) bytes which also
starts in a document with a smaller id. Suffixes are compared only as far as
needed: to depth `span`.

1. Initial buckets are the q-grams (q = 20) at anchors: of all q-grams in a
   string of 50 bytes the one with the smallest hash, the rightmost among equal
   ones. Equal strings have the same anchor, so whatever repeats meets in a
   bucket, and only one place in about sixteen is sent.
2. A bucket is refined by the buckets at later offsets. The range of starting
   places that share an anchor, and the bytes they reach, are one suffix block;
   its bucket pointer is built by doubling, each pass combining the pointers at
   an offset and at that offset plus the length already covered, so pointers
   made once are used by all longer blocks. Blocks are grouped by (anchor,
   pointer): a bucket with one kind of block is fully refined, and the smallest
   document in it decides for all.
3. Buckets with several kinds of blocks hold repeats that end inside a block.
   There the bytes of one block of each kind meet, and their strings of 50 bytes
   are told apart exactly: places are sorted into buckets of q-grams (q = 7),
   which are refined by sorting on the pair of a place's own bucket and the
   bucket at the offset covered so far. Numbers of buckets are dense, so equal
   numbers are equal bytes; the new ones replace the old and serve as pointers
   of the next, twice as deep pass (7, 14, 28, 50).
4. What each block has learnt goes back to the group of documents it came from.

Documents are dealt to groups of bounded size by a hash of their id. A group
sends each kind of block once, with the smallest document that has it, so a
passage in a third of all documents is as many rows as there are groups. Blocks
at the edges of such a passage differ by document: a bucket of more than
HOT_KINDS kinds is cut into strings first, each group sends its different
strings once, and these meet by a hash of their own. The number of groups and of
ranges grows with the bytes read.

Defined results: a null text is empty, and empty and shorter texts keep all;
texts are UTF-8; rows with the same id each give a row, and repeats between them
do not count, their ids not being smaller; rows with a null id keep
all and cover nothing; an empty table gives an empty one; further columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import slices
from offerloom.llm.durable import bucketed, written

SPAN, Q = 50, 20
GROUP_BYTES = 2_000_000  # text in a group of documents, about
BUCKET_BYTES = 24_000_000  # text whose anchors meet in one range of buckets, about
HOT_KINDS = 4096  # kinds in a bucket from which its strings meet one by one
HALF = 32  # bytes of the pointers that two make one of SPAN
PIECE = 1 << 14  # places whose pointers are made together
GRAM = 7  # bytes of an initial bucket that one number holds
_PRIME = np.uint64(0x9E3779B97F4A7C15)
NONE = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_STEP = dict(zip((1 << k for k in range(16)), _mix(np.arange(1, 17, dtype=np.uint64) * _PRIME) | np.uint64(1)))  # a multiplier for each length
_BYTES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _PRIME)


def _doubled(b: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Pointers of the strings of 1, 2, 4, ... and `top` bytes at every place, each built from the one before."""
    held = {1: _BYTES[b]}
    n = 1
    while n < top:
        held[2 * n] = held[n][: len(held[n]) - n] * _STEP[n] + held[n][n:]
        n *= 2
    return held


def _joined(first: np.ndarray, second: np.ndarray, length: int) -> np.ndarray:
    """Pointers of strings of `length` bytes, of those at their begin and those that reach their end."""
    return _mix(first * _PRIME + second + np.uint64(length))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values, by doubling."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[: len(x) - n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def _dense(x: np.ndarray) -> np.ndarray:
    """Equal numbers numbered alike from 0."""
    order = np.argsort(x)
    held = x[order]
    new = np.zeros(len(x), np.int64)
    new[1:] = held[1:] != held[:-1]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(new)
    return out


def buckets(b: np.ndarray) -> np.ndarray:
    """Bucket of the string of SPAN bytes at each place: two places are in one bucket if and only if their strings are equal."""
    m = max(0, len(b) - GRAM + 1)
    gram = np.zeros(m, np.int64)
    for k in range(GRAM):
        gram = (gram << 8) | b[k : k + m]
    held, depth = _dense(gram), GRAM
    while depth < SPAN:
        step = min(depth, SPAN - depth)
        m = max(0, len(held) - step)
        held = _dense(held[:m] * len(held) + held[step : step + m])
        depth += step
    return held


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each of several runs, end to end."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _order(anchor: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Order by both, of 48 bits each; a single sort but for kinds that are alike in their first 64 bits."""
    key = (anchor << np.uint64(16)) | (pointer >> np.uint64(32))
    order = np.argsort(key)
    key, p = key[order], pointer[order]
    same = key[1:] == key[:-1]
    if (same & (p[1:] != p[:-1])).any():
        run = np.cumsum(np.append(False, ~same))
        unlike = np.zeros(len(order), bool)
        unlike[run[1:][same & (p[1:] != p[:-1])]] = True
        at = np.flatnonzero(unlike[run])
        order[at] = order[at[np.lexsort((p[at], run[at]))]]
    return order


class Blocks:
    """Anchor, pointer and range of starting places of each block of some documents laid end to end."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.cumsum(sizes) - sizes
        self.bytes = b = np.frombuffer(b"".join(texts), np.uint8)
        empty = np.zeros(0, np.int64)
        self.half = np.zeros(0, np.uint64)
        self.doc, self.first, self.last, self.anchor, self.pointer = empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(b) < SPAN:
            return
        many = len(b) - SPAN + 1
        low, self.half = np.empty(many, np.uint64), np.empty(len(b) - HALF + 1, np.uint64)
        for x in range(0, many, PIECE):  # short pieces stay in the processor's cache
            held = _doubled(b[x : x + PIECE + SPAN - 1], HALF)
            self.half[x : x + len(held[HALF])] = held[HALF]
            gram = _joined(held[16][: len(held[16]) - (Q - 16)], held[16][Q - 16 :], Q)
            # The rank of a q-gram in a window: its hash above, the place inside a stretch below, so the rightmost wins among equal ones.
            place = np.arange(x, x + len(gram), dtype=np.uint64) & np.uint64(0xFFFF)
            low[x : x + PIECE] = _window_min((gram | np.uint64(0xFFFF)) - place, SPAN - Q + 1)
        ends = self.begins + sizes
        inside = np.ones(many, bool)
        past = (ends[:, None] - np.arange(1, SPAN)).ravel()  # strings from here would reach into the next document
        inside[past[(past >= 0) & (past < many)]] = False
        new = ~inside
        new[0] = True
        new[1:] |= (low[1:] != low[:-1]) | ~inside[:-1]
        marks = np.append(np.flatnonzero(new), many)
        is_head = inside[marks[:-1]]
        heads, last = marks[:-1][is_head], marks[1:][is_head] - 1
        self.first, self.last = heads, last  # both are starting places
        self.doc = np.searchsorted(self.begins, heads, side="right") - 1
        self.anchor = low[heads] >> np.uint64(16)
        offset = (np.uint64(0xFFFF) - (low[heads] & np.uint64(0xFFFF))).astype(np.int64)
        self.pointer = np.uint64((1 << 48) - 1) & _mix(_mix(self.spans(heads) * _PRIME + self.spans(last)) * _PRIME + (last - heads).astype(np.uint64) * np.uint64(64) + ((offset - heads) & 0xFFFF).astype(np.uint64))

    def spans(self, places: np.ndarray) -> np.ndarray:
        """Pointers of the strings of SPAN bytes at some places."""
        return _joined(self.half[places], self.half[places + (SPAN - HALF)], SPAN)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _kinds(blocks: Blocks, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (of blocks) of one representative for each kind by anchor and pointer, each block's kind, and each kind's smallest id."""
    order = _order(blocks.anchor, blocks.pointer)
    a, p = blocks.anchor[order], blocks.pointer[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(ids[blocks.doc][order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    return order[new], kind, low


def _group_blocks(table: pa.Table | pa.RecordBatch) -> tuple[Blocks, np.ndarray]:
    """Blocks of a group's documents with an id, in order of their rows."""
    texts = [_raw(t) if i is not None else b"" for t, i in zip(table.column("text").to_pylist(), table.column("doc_id").to_pylist())]
    ids = np.array([NONE if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    return Blocks(texts), ids


def _packed(x: np.ndarray, width: int) -> bytes:
    """The low bytes of whole numbers, plane by plane, so that equal high bytes stand together and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _planes(blobs: list[bytes], width: int) -> np.ndarray:
    """The numbers in blobs of planes, end to end."""
    out = np.zeros((sum(map(len, blobs)) // width, 8), np.uint8)
    at = 0
    for blob in blobs:
        n = len(blob) // width
        out[at : at + n, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
        at += n
    return out.view("<u8").ravel()


def _by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """Order by part; within a part the order stays. Numbers of 16 bits are sorted by counting."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def _dealt(part: np.ndarray, parts: int, columns: list[tuple[np.ndarray, int]]) -> tuple[list[int], list[pa.Array]]:
    """Which parts there are, and for each column a blob of each part's numbers; within a part the order stays."""
    order = _by_part(part, parts)
    cuts = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
    full = [k for k in range(parts) if cuts[k + 1] > cuts[k]]
    sorted_ = [(x[order], width) for x, width in columns]
    return full, [pa.array([_packed(x[cuts[k] : cuts[k + 1]], width) for k in full], pa.binary()) for x, width in sorted_]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _result(ids, texts: list[str | None], spans: list[np.ndarray]) -> pa.Table:
    """Result rows of documents and the byte ranges of each that go."""
    size, gone, digest, kept = [], [], [], []
    for t, own in zip(texts, spans):
        b, parts, at = _raw(t), [], 0
        for x, y in own.tolist():
            parts.append(b[at:x])
            at = y
        k = b"".join([*parts, b[at:]])
        size.append(len(b))
        gone.append(len(b) - len(k))
        digest.append(hashlib.sha256(k).hexdigest())
        kept.append(k.decode("utf-8", "replace"))
    return pa.table({"doc_id": ids, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.string())})


_KINDS = "range int, grp int, anchors binary, pointers binary, ids binary"


def _sent(docs: DataFrame, ranges: int) -> DataFrame:
    """Of each group the kinds of its blocks, packed by range of anchors."""

    def send(table: pa.Table) -> pa.Table:
        blocks, ids = _group_blocks(table)
        rows, _, low = _kinds(blocks, ids)
        anchors = blocks.anchor[rows]
        full, blobs = _dealt((anchors % np.uint64(ranges)).astype(np.int64), ranges, [(anchors, 6), (blocks.pointer[rows], 6), (low, 8)])
        return pa.table([pa.array(full, pa.int32()), pa.array([table.column("grp")[0].as_py()] * len(full), pa.int32()), *blobs], names=["range", "grp", "anchors", "pointers", "ids"])

    return docs.groupBy("grp").applyInArrow(send, _KINDS)


def _learnt(sent: DataFrame, ranges: int) -> DataFrame:
    """Back to each group: kinds found in a smaller document elsewhere (`low`), and kinds to look into (`mixed`: 1, or 2 in a hot bucket).

    Kinds are named by their number among those that the group sent to the range.
    """

    def meet(table: pa.Table) -> pa.Table:
        anchors, pointer, ids = (_planes(table.column(c).to_pylist(), w) for c, w in (("anchors", 6), ("pointers", 6), ("ids", 8)))
        ids = ids.view("<i8")
        sizes = np.array([len(x) // 6 for x in table.column("anchors").to_pylist()], np.int64)
        order = _order(anchors, pointer)
        a, p = anchors[order], pointer[order]
        new_a = np.ones(len(order), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_k = new_a.copy()
        new_k[1:] |= p[1:] != p[:-1]
        held = ids[order]
        low = np.minimum.reduceat(held, np.flatnonzero(new_k))[np.cumsum(new_k) - 1]  # smallest document of the kind
        bucket = np.cumsum(new_a) - 1
        # Whoever has a kind's smallest document looks into it; its other documents are covered as a whole.
        kinds = np.bincount(bucket, new_k)[bucket]
        mixed = np.where(low == held, (kinds > 1).astype(np.int64) + (kinds > HOT_KINDS), 0)
        told = (low < held) | (mixed > 0)
        rows = order[told]
        back = np.argsort(rows)
        rows, low, mixed = rows[back], low[told][back], mixed[told][back]
        source = np.searchsorted(np.cumsum(sizes), rows, side="right")
        full, blobs = _dealt(source, len(sizes), [(rows - (np.cumsum(sizes) - sizes)[source], 4), (low, 8), (mixed, 1)])
        groups, place = table.column("grp").to_pylist(), table.column("range")[0].as_py()
        return pa.table([pa.array([groups[k] for k in full], pa.int32()), pa.array([place] * len(full), pa.int32()), *blobs], names=["grp", "range", "kinds", "low", "mixed"])

    return sent.repartition(ranges, "range").groupBy("range").applyInArrow(meet, "grp int, range int, kinds binary, low binary, mixed binary")


def _answers(right: pa.Table, anchors: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, low, mixed) of all that a group has learnt of its kinds, whose anchors are given."""
    rows = [r for r in zip(*(right.column(c).to_pylist() for c in ("range", "kinds", "low", "mixed"))) if r[1] is not None]
    part = (anchors % np.uint64(ranges)).astype(np.int64)
    order, cuts = _by_part(part, ranges), np.append(0, np.cumsum(np.bincount(part, minlength=ranges)))
    kinds = [order[cuts[r[0]] + _planes([r[1]], 4).view("<i8")] for r in rows]
    return np.concatenate([np.zeros(0, np.int64), *kinds]), _planes([r[2] for r in rows], 8).view("<i8"), _planes([r[3] for r in rows], 1).astype(np.int64)


class Edges:
    """What a group shows of its kinds to look into: stretches of bytes, and the slot of each string in them.

    An ordinary kind is one stretch, its block; of hot kinds each different
    string is a stretch. Both sides of the exchange build the same stretches
    from the same documents, so their numbers are enough to speak of them.
    """

    def __init__(self, blocks: Blocks, rows: np.ndarray, low: np.ndarray, mixed: np.ndarray):
        pick = np.flatnonzero(mixed > 0)
        many = blocks.last[rows[pick]] - blocks.first[rows[pick]] + 1
        place, own = _runs(blocks.first[rows[pick]], many), np.repeat(low[pick], many)
        self.base = np.full(len(rows), -1, np.int64)  # of a kind, where its strings begin in slot
        self.base[pick] = np.cumsum(many) - many
        hot = mixed[pick] == 2
        single = np.repeat(hot, many)
        self.anchor = blocks.anchor[rows[pick[~hot]]]
        self.first, self.many = blocks.first[rows[pick[~hot]]], many[~hot]
        self.least = self.most = low[pick[~hot]]
        self.slot = np.empty(len(place), np.int64)
        self.slot[~single] = np.arange((~single).sum())
        if single.any():
            at = place[single]
            held = blocks.bytes[(at[:, None] + np.arange(SPAN)).ravel()]
            bucket = _dense(buckets(held)[::SPAN])
            order = np.lexsort((own[single], bucket))
            new = np.append(True, bucket[order][1:] != bucket[order][:-1])
            end = np.append(np.flatnonzero(new)[1:], len(order)) - 1
            self.slot[single] = bucket + self.many.sum()
            self.anchor = np.append(self.anchor, blocks.spans(at[order[new]]))
            self.first, self.many = np.append(self.first, at[order[new]]), np.append(self.many, np.ones(len(end), np.int64))
            self.least, self.most = np.append(self.least, own[single][order[new]]), np.append(self.most, own[single][order[end]])
        self.start = np.cumsum(self.many) - self.many  # first slot of each stretch


def _edges(blocks: Blocks, ids: np.ndarray, right: pa.Table, ranges: int) -> tuple[Edges, np.ndarray, np.ndarray]:
    """Edges of a group, for each of its blocks the kind, and for each kind the smallest document anywhere."""
    rows, kind, own = _kinds(blocks, ids)
    known, low, mixed = _answers(right, blocks.anchor[rows], ranges)
    look, smallest = np.zeros(len(rows), np.int64), own.copy()
    look[known] = mixed
    smallest[known] = np.minimum(own[known], low)
    return Edges(blocks, rows, own, look), kind, smallest


def _shown(docs: DataFrame, learnt: DataFrame, ranges: int, kind_ranges: int) -> DataFrame:
    """The bytes of each stretch that a group shows, with the smallest and largest document that looks for them."""
    names = ["range", "grp", "stretch", "many", "ids", "more", "bytes"]

    def show(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 5)], names=names)
        blocks, ids = _group_blocks(left)
        e = _edges(blocks, ids, right, kind_ranges)[0]
        part = (e.anchor % np.uint64(ranges)).astype(np.int64)
        full, blobs = _dealt(part, ranges, [(np.arange(len(part)), 4), (e.many, 1), (e.least, 8), (e.most - e.least, 8)])
        order = _by_part(part, ranges)
        cuts = np.searchsorted(part[order], [*full, ranges])
        size = e.many + SPAN - 1
        held = [blocks.bytes[_runs(e.first[o], size[o])].tobytes() for o in (order[x:y] for x, y in zip(cuts[:-1], cuts[1:]))]
        return pa.table([pa.array(full, pa.int32()), pa.array([left.column("grp")[0].as_py()] * len(full), pa.int32()), *blobs, pa.array(held, pa.binary())], names=names)

    return docs.groupBy("grp").cogroup(learnt.groupBy("grp")).applyInArrow(show, "range int, grp int, stretch binary, many binary, ids binary, more binary, bytes binary")


def _resolved(shown: DataFrame, ranges: int) -> DataFrame:
    """Back to each group: runs of strings in its stretches that a smaller document has, and the smallest such."""

    def meet(table: pa.Table) -> pa.Table:
        stretch, many, least, more = (_planes(table.column(c).to_pylist(), w) for c, w in (("stretch", 4), ("many", 1), ("ids", 8), ("more", 8)))
        many, least = many.astype(np.int64), least.view("<i8")
        most = least + more.view("<i8")
        sizes = np.array([len(x) for x in table.column("many").to_pylist()], np.int64)
        source = np.repeat(np.arange(len(sizes)), sizes)
        b = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        wide = many + SPAN - 1
        of, offset = np.repeat(np.arange(len(many)), many), _runs(np.zeros(len(many), np.int64), many)
        bucket = buckets(b)[_runs(np.cumsum(wide) - wide, many)]
        order = np.argsort(bucket)
        heads = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        low = np.empty(len(order), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[of][order], heads), np.diff(np.append(heads, len(order))))
        told = np.flatnonzero(low < most[of])
        of, offset, low = of[told], offset[told], low[told]
        new = np.ones(len(told), bool)
        new[1:] = (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1) | (low[1:] != low[:-1])
        run = np.flatnonzero(new)
        length = np.diff(np.append(run, len(told)))
        full, blobs = _dealt(source[of[run]], len(sizes), [(stretch[of[run]], 4), (offset[run], 1), (length, 1), (low[run], 8)])
        groups = table.column("grp").to_pylist()
        return pa.table([pa.array([groups[k] for k in full], pa.int32()), *blobs], names=["grp", "stretch", "begin", "length", "lows"])

    return shown.repartition(ranges, "range").groupBy("range").applyInArrow(meet, "grp int, stretch binary, begin binary, length binary, lows binary")


def _removed(docs: DataFrame, learnt: DataFrame, resolved: DataFrame, ranges: int) -> DataFrame:
    """Results of the documents of all groups."""
    nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    answers = learnt.select("grp", "range", "kinds", "low", "mixed", *nothing("stretch", "begin", "length", "lows"))
    answers = answers.union(resolved.select("grp", F.lit(None).cast("int").alias("range"), *nothing("kinds", "low", "mixed"), "stretch", "begin", "length", "lows"))

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks, ids = _group_blocks(left)
        edges, kind, smallest = _edges(blocks, ids, right, ranges)
        b = blocks.bytes
        gone = np.zeros(len(b) + 1, np.int64)
        doc_ids = ids[blocks.doc] if len(blocks.doc) else np.zeros(0, np.int64)
        whole = smallest[kind] < doc_ids
        np.add.at(gone, blocks.first[whole], 1)
        np.add.at(gone, blocks.last[whole] + SPAN, -1)
        rest = np.flatnonzero(~whole & (edges.base[kind] >= 0))
        stretch, begin, length, lows = (_planes([x for x in right.column(c).to_pylist() if x is not None], w).view("<i8") for c, w in (("stretch", 4), ("begin", 1), ("length", 1), ("lows", 8)))
        if len(rest) and len(stretch):
            low = np.full(edges.many.sum(), NONE, np.int64)  # of each slot
            low[_runs(edges.start[stretch] + begin, length)] = np.repeat(lows, length)
            many = blocks.last[rest] - blocks.first[rest] + 1
            place = _runs(blocks.first[rest], many)
            ok = low[edges.slot[_runs(edges.base[kind[rest]], many)]] < np.repeat(doc_ids[rest], many)
            np.add.at(gone, place[ok], 1)
            np.add.at(gone, place[ok] + SPAN, -1)
        covered = np.cumsum(gone[:-1]) > 0
        step = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        owner = np.repeat(np.arange(len(ids)), np.diff(np.append(blocks.begins, len(b))))
        # A run goes on past the end of a document only on paper.
        cut_at = np.flatnonzero(covered[1:] & covered[:-1] & (owner[1:] != owner[:-1])) + 1 if len(b) else np.zeros(0, np.int64)
        begin, end = np.sort(np.append(begin, cut_at)), np.sort(np.append(end, cut_at))
        of = owner[begin] if len(begin) else np.zeros(0, np.int64)
        edges = np.searchsorted(of, np.arange(len(ids) + 1))
        spans = [np.stack([begin[x:y], end[x:y]], 1) - blocks.begins[d] for d, (x, y) in enumerate(zip(edges[:-1], edges[1:]))]
        return _result(left.column("doc_id"), left.column("text").to_pylist(), spans)

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        return cover(left, right) if left.num_rows else _result(left.column("doc_id"), [], [])

    return docs.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(group, _RESULT)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, ranges = int(max(8, -(-total // GROUP_BYTES))), int(max(8, -(-total // BUCKET_BYTES)))
    takes_part = F.coalesce(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN), F.lit(False))
    keyed = rows.filter(takes_part).withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    dealt = bucketed(keyed, "grp", max(8, groups // 4))
    learnt = written(_learnt(_sent(dealt, ranges), ranges), "suffix-kinds")
    found = _removed(dealt, learnt, _resolved(_shown(dealt, learnt, 4 * ranges, ranges), 4 * ranges), ranges)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, "text"):
            yield from _result(piece.column(0), texts, [np.zeros((0, 2), np.int64)] * len(texts)).to_batches()

    rest = rows.filter(~takes_part).mapInArrow(whole, _RESULT)
    return found.union(rest).withColumnRenamed("doc_id", id_col)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that earlier documents hold in strings of 50 bytes, and a digest of the rest."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: The same rows by all strings of 50 bytes, on hexadecimal text, taken from pieces of 249 bytes.
OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CAST(k * 200 AS BIGINT) AS base, substr(h, k * 400 + 1, 498) AS piece FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 199) // 200)) AS k FROM d)),
w AS (SELECT doc_id, base + o AS p, substr(piece, o * 2 + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(200, length(piece) // 2 - 49))) AS o FROM c WHERE length(piece) >= 100)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN f USING (s) WHERE low < doc_id),
r AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
runs AS (SELECT doc_id, run, min(p) AS b, max(p) + 50 AS e FROM r GROUP BY ALL),
gaps AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS was FROM runs),
t AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS gone, count(*) AS spans, max(e) AS last, string_agg(substr(h, was * 2 + 1, (b - was) * 2), '' ORDER BY b) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, coalesce(last, 0) * 2 + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
