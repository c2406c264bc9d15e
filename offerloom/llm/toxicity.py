"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters the network twice: as an embedding of the whole word and as
the mean of embeddings of its character 3- to 5-grams, both in hashed tables.
A GRU reads a window of words forwards, another one backwards; an attention
layer pools their states and a logistic unit scores the window. All parameters
are trained here, in numpy, by back-propagation through time and Adam.

Labels exist for documents only. A document is toxic as soon as one passage is,
so training is multiple-instance: after a first round on all windows, only the
better-scoring half of a toxic document's windows keeps the label. At scoring,
all overlapping windows of the whole text are run, the highest logit decides,
and a logistic calibration fitted on a held-aside part of the learning sample
turns it into a score.

The input-to-gate products depend on the word alone; they are computed once for
each distinct word, kept in a bounded cache, and only the recurrent part runs
per position.

Defined results: a null, empty or wordless text scores the base rate of the
learning sample; without labels of both kinds every text does (0 if there are
none); repeated rows score alike; an empty table gives an empty table; further
columns of the input are not read.
"""

from __future__ import annotations

import re
import ctypes
import gc
import pickle
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import fold_key, slices

POSITIVES, NEGATIVES = 1000, 2000  # bound of the learning sample
HARD, EASY = 4, 2  # of a document's windows, the best-scoring and the random ones that a round learns from; all are scored each round
WINDOW, STRIDE = 48, 24  # in words
WORDS, GRAMS, DIM, HIDDEN = 1 << 14, 1 << 15, 8, 8
MIN_EPOCHS, MAX_EPOCHS, STEPS, BATCH, RATE = 4, 30, 200, 128, 0.01
CUTOFF = 0.3
CACHE = 200_000  # distinct words whose products a worker keeps
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows(n: int) -> range:
    """First words of the overlapping windows that cover n words."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def word_keys(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word index, hashed n-gram indices of all words in a row, and where each word's begin."""
    coded = [f"^{w}$".encode("utf-8", "replace") for w in vocabulary]
    index = np.fromiter((zlib.crc32(c) % WORDS for c in coded), np.int64, len(coded))
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    b = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(coded)), sizes)
    grams, owners = [], []
    for n in (3, 4, 5):
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint32(16777619)
        inside = owner[: len(h)] == owner[n - 1 :]
        grams.append(((h[inside] ^ (h[inside] >> np.uint32(15))) % np.uint32(GRAMS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    if not grams:
        return index, np.zeros(0, np.int64), np.zeros(len(coded), np.int64)
    gram, of = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return index, gram[order], np.searchsorted(of[order], np.arange(len(coded)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


class Network:
    """Parameters, forward and backward passes. Products of all gates lie side by side: z, r, n forwards, then backwards."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "word": draw(WORDS, DIM, scale=0.1),
            "gram": draw(GRAMS, DIM, scale=0.3),
            "in": draw(2 * DIM, 6 * HIDDEN, scale=0.3),
            "in_b": np.zeros(6 * HIDDEN, np.float32),
            "rec": draw(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": draw(2 * HIDDEN, scale=0.1),
            "out": draw(2 * HIDDEN, scale=0.3),
            "out_b": np.zeros(1, np.float32),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step, self.rate = 0, RATE
        self.slope, self.shift, self.base = 1.0, 0.0, 0.0
        self.trained = False

    def inputs(self, index: np.ndarray, gram: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Input vectors of distinct words (word embedding next to mean n-gram embedding) and how many n-grams each has."""
        many = np.diff(np.append(at, len(gram)))
        mean = np.zeros((len(index), DIM), np.float32)
        if len(gram):
            mean = np.add.reduceat(self.p["gram"][gram], np.minimum(at, len(gram) - 1), axis=0)
            mean = np.where(many[:, None] > 0, mean / np.maximum(many, 1)[:, None], 0).astype(np.float32)
        whole = self.p["word"][index]
        if keep is not None:
            whole = whole * keep[:, None]
        return np.concatenate([whole, mean], 1), many

    def products(self, vocabulary: list[str]) -> np.ndarray:
        return self.inputs(*word_keys(vocabulary))[0] @ self.p["in"] + self.p["in_b"]

    def run(self, ids: np.ndarray, mask: np.ndarray, table: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of windows: ids and mask are (windows, WINDOW); table holds each word's gate products."""
        n, steps = ids.shape
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for d in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            part = np.ascontiguousarray(table[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN])
            rec = self.p["rec"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x, u = part[ids[:, t]], h @ rec
                zr = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                before = h
                h = new + z * (before - new)
                if not (here := mask[:, t]).all():
                    h = np.where(here[:, None], h, before)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
                if tape is not None:
                    tape.append((d, t, before, z, r, new, u[:, 2 * HIDDEN :]))
        weight = np.where(mask.T, states @ self.p["att"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if tape is not None:
            tape.append((states, weight, pooled))
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def learn(self, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, cost: np.ndarray, keys, rng) -> None:
        """One step of Adam on windows; ids index the distinct words described by keys."""
        index, gram, at = keys
        keep = (rng.random(len(index)) > 0.3).astype(np.float32)  # whole words drop out, their n-grams stay
        x, many = self.inputs(index, gram, at, keep)
        tape: list = []
        logit = self.run(ids, mask, x @ self.p["in"] + self.p["in_b"], tape)
        states, weight, pooled = tape.pop()
        d_logit = ((sigmoid(logit) - y) * cost / cost.sum()).astype(np.float32)
        g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.p["att"]
        g["att"] = np.einsum("tn,tnh->h", d_score, states)
        d_table = np.zeros((len(index), 6 * HIDDEN), np.float32)
        g["rec"] = np.zeros_like(self.p["rec"])
        d_h = [np.zeros_like(tape[0][2]), np.zeros_like(tape[0][2])]
        while tape:
            d, t, before, z, r, new, u_n = tape.pop()
            here = mask[:, t][:, None]
            total = d_h[d] + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            live = np.where(here, total, 0)
            d_new = live * (1 - z) * (1 - new * new)
            d_z = live * (before - new) * z * (1 - z)
            d_r = d_new * u_n * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_new * r], 1)
            g["rec"][d] += before.T @ d_u
            d_h[d] = np.where(here, live * z + d_u @ self.p["rec"][d].T, total)
            np.add.at(d_table[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN], ids[:, t], np.concatenate([d_z, d_r, d_new], 1))
        g["in"], g["in_b"] = x.T @ d_table, d_table.sum(0)
        d_x = d_table @ self.p["in"].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], index, d_x[:, :DIM] * keep[:, None])
        g["gram"] = np.zeros_like(self.p["gram"])
        np.add.at(g["gram"], gram, np.repeat(d_x[:, DIM:] / np.maximum(many, 1)[:, None], many, axis=0))
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, grad in g.items():
            self.m[k] = np.float32(0.9) * self.m[k] + np.float32(0.1) * grad
            self.v[k] = np.float32(0.999) * self.v[k] + np.float32(0.001) * grad * grad
            self.p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)

    def frozen(self) -> Network:
        self.m = self.v = {}
        return self


def cut(ids: np.ndarray, starts) -> tuple[np.ndarray, np.ndarray]:
    """Windows of one text as rows of word ids, and which places hold a word."""
    places = np.asarray(starts)[:, None] + np.arange(WINDOW)
    mask = places < len(ids)
    return np.where(mask, ids[np.minimum(places, max(0, len(ids) - 1))] if len(ids) else 0, 0), mask


def train(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 7) -> Network:
    """Fit the network and its calibration on a bounded sample of documents; prior is the share of toxic ones among all labelled."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    net.base = prior if prior is not None else float(y.mean()) if len(y) else 0.0
    if len(set(labels)) < 2:
        return net.frozen()
    vocabulary: dict[str, int] = {}
    ids, mask, of = [], [], []
    for i, text in enumerate(texts):
        own = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], np.int64)
        if not len(own):
            continue
        rows, here = cut(own, windows(len(own)))
        ids.append(rows.astype(np.int32))
        mask.append(here)
        of.append(np.full(len(rows), i))
    ids, mask, of = np.concatenate(ids), np.concatenate(mask), np.concatenate(of)
    index, gram, at = word_keys(list(vocabulary))
    ends = np.append(at[1:], len(gram))
    aside = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))])
    for klass in (0, 1):  # both parts need both classes
        own = np.flatnonzero(y == klass)
        aside[own[: max(1, len(own) // 2)]] |= not aside[own].any()
        if aside[own].all():
            aside[own] = False
    learnt = np.flatnonzero(~aside[np.arange(len(texts))])
    contrast(net, ids, mask, of, learnt, y, index, gram, at, ends)
    logit = np.zeros(len(ids), np.float32)
    epochs = min(MAX_EPOCHS, max(MIN_EPOCHS, -(-STEPS * BATCH // min(len(ids), (HARD + EASY) * len(texts)))))
    many = np.bincount(of, minlength=len(texts))[of]
    for epoch in range(epochs):
        if epoch:
            logit = forward(net, ids, mask, index, gram, at)
        hard, easy = ranks(of, -logit if epoch else rng.random(len(ids))), ranks(of, rng.random(len(ids)))
        toxic = (hard < HARD + EASY) & (hard < (many + 1) // 2)  # only the better half of a toxic text keeps its label
        use = ~aside[of] & np.where(y[of] == 1, toxic, (hard < HARD) | (easy < EASY))
        net.rate = RATE * (1 - 0.8 * epoch / epochs)
        rows = rng.permutation(np.flatnonzero(use))
        ratio = min(8.0, max(1.0, float((y[of[rows]] == 0).sum() / max(1, (y[of[rows]] == 1).sum())) ** 0.5))
        for k in range(0, len(rows), BATCH):
            r = rows[k : k + BATCH]
            distinct, local = np.unique(ids[r], return_inverse=True)
            lens = ends[distinct] - at[distinct]
            begin = np.cumsum(lens) - lens
            take = np.repeat(at[distinct] - begin, lens) + np.arange(lens.sum())
            net.learn(local.reshape(ids[r].shape), mask[r], y[of[r]], np.where(y[of[r]] == 1, ratio, 1).astype(np.float32), (index[distinct], gram[take], begin), rng)
    logit = forward(net, ids, mask, index, gram, at)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, of, logit)
    known = np.isfinite(top)
    net.slope, net.shift = calibration(top[known & aside], y[known & aside]) if len(set(y[known & aside])) == 2 else (1.0, 0.0)
    drawn = float(y[known & aside].mean())  # the sample holds more toxic documents than the table
    if 0 < drawn < 1 and 0 < net.base < 1:
        net.shift += float(np.log(net.base / (1 - net.base)) - np.log(drawn / (1 - drawn)))
    net.trained = True
    return net.frozen()


def forward(net: Network, ids, mask, index, gram, at) -> np.ndarray:
    table = net.inputs(index, gram, at)[0] @ net.p["in"] + net.p["in_b"]
    return np.concatenate([net.run(ids[k : k + 1024], mask[k : k + 1024], table) for k in range(0, len(ids), 1024)])


def ranks(of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each window among its document's by ascending key; of is sorted."""
    order = np.lexsort((key, of))
    out = np.empty(len(of), np.int64)
    out[order] = np.arange(len(of)) - np.searchsorted(of, of)
    return out


def contrast(net: Network, ids, mask, of, learnt, y, index, gram, at, ends) -> None:
    """Start the first dimension of both embedding tables from how unevenly the classes use a word or n-gram.

    The value is the two-sample z of document frequencies, shrunk where few
    documents have the feature; with little data the rest of the network then
    has something to recur on.
    """
    many = [max(1, int((y[learnt] == k).sum())) for k in (0, 1)]
    counts = {"word": np.zeros((2, WORDS)), "gram": np.zeros((2, GRAMS))}
    bounds = np.searchsorted(of, np.arange(len(y) + 1))
    for i in learnt:
        rows = slice(bounds[i], bounds[i + 1])
        own = np.unique(ids[rows][mask[rows]])
        counts["word"][int(y[i]), np.unique(index[own])] += 1
        if len(own):
            counts["gram"][int(y[i]), np.unique(np.concatenate([gram[at[w] : ends[w]] for w in own]))] += 1
    for k, (clean, toxic) in counts.items():
        df = clean + toxic
        p = (df + 0.5) / (sum(many) + 1)
        z = (toxic / many[1] - clean / many[0]) / np.sqrt(p * (1 - np.minimum(p, 0.99)) * (1 / many[0] + 1 / many[1]))
        net.p[k][:, 0] = np.clip(z * df / (df + 4), -6, 6) / 3


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge-regularised logistic regression of labels on logits."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * x).sum() + 0.05 * (a - 1), (p - y).sum() + 0.05 * b])
        hess = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


class Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores texts with a trained network; keeps gate products of a bounded number of words."""

    def __init__(self, net: Network):
        self.net, self.seen, self.table = net, Vocabulary(), np.zeros((0, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not self.net.trained:
            return np.full(len(texts), self.net.base)
        if len(self.seen) > CACHE:
            self.seen, self.table = Vocabulary(), self.table[:0]
        known = len(self.seen)
        rows = []
        for t in texts:
            own = words(t)
            rows.append(np.fromiter(map(self.seen.__getitem__, own), np.int32, len(own)))
        if len(self.seen) > known:
            fresh = list(self.seen)[known:]
            self.table = np.concatenate([self.table, *(self.net.products(fresh[k : k + 20_000]) for k in range(0, len(fresh), 20_000))])
        cuts = [cut(r, windows(len(r))) if len(r) else None for r in rows]
        full = [i for i, c in enumerate(cuts) if c]
        out = np.full(len(texts), self.net.base)
        if full:
            ids, mask = np.concatenate([cuts[i][0] for i in full]), np.concatenate([cuts[i][1] for i in full])
            logit = np.concatenate([self.net.run(ids[k : k + 1024], mask[k : k + 1024], self.table) for k in range(0, len(ids), 1024)])
            at = np.cumsum([0] + [len(cuts[i][0]) for i in full[:-1]])
            top = np.maximum.reduceat(logit.astype(np.float64), at)
            out[full] = 1 / (1 + np.exp(-np.clip(self.net.slope * top + self.net.shift, -40, 40)))
        return out


def fit(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bounds: tuple[int, int] = (POSITIVES, NEGATIVES)) -> Network:
    """Train on at most bounds[0] toxic and bounds[1] other documents, chosen by a hash of their ids.

    One task trains, as the sample is bounded; the driver gets the parameters only.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(~held_out(F.col("_id")))
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = rows.filter("_y = 1").orderBy(order, "_id").limit(bounds[0]).union(rows.filter("_y = 0").orderBy(order, "_id").limit(bounds[1]))
    # The broadcast side has at most sum(bounds) rows of two numbers.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").limit(2 * sum(bounds)).select("_id", "_text", "_y")
    prior = rows.agg(F.avg("_y")).first()[0]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (zlib.crc32(str(r["_id"]).encode()), r["_id"], r["_text"] or ""))
        net = pickle.dumps(train([r["_text"] for r in own], [r["_y"] for r in own], prior))
        del own
        returned()
        yield pa.RecordBatch.from_arrays([pa.array([net], pa.binary())], names=["net"])

    found = sample.coalesce(1).mapInArrow(learn, "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else train([], [], prior)


def returned() -> None:
    """Give freed memory back to the machine, where the C library can: training frees large arrays that its allocator would hold on to."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id (and the columns in `keep`) with score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for piece, texts in slices(batches, "_text", 1_500_000):
            s = scorer(texts)
            names = piece.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(s), pa.array((s >= CUTOFF).astype(np.int32))], names=[*names, "score", "predicted"])

    rows = docs.select(F.col(text_col).alias("_text"), *dict.fromkeys([id_col, *keep]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(scan, f"{schema}, score double, predicted int")


def held_out(column):
    return F.coalesce((fold_key(column) % 4) == 2, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; folds of crc32(doc_id) mod 4 = 2 are held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
