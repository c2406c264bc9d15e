"""Quality of texts by nearest-neighbour voting in a latent semantic space.

Fitting takes at most PER_CLASS labelled texts of each class. Their features
(hashed words, hashed shapes of words and of marks between them, and bins of a
few ratios such as distinct words to words) are weighted by tf-idf and reduced
by a truncated singular value decomposition, trained here in numpy. The labelled
latent vectors and the projection have a fixed largest size and are broadcast.

Every document of the table is then mapped to the same space, by its whole text,
and compared with all labelled vectors in blocks of exact cosine products; the
NEIGHBOURS nearest vote with their labels, weighted by similarity. Both classes
weigh the same in a vote, and BASE votes of the base rate keep texts apart from
all labelled ones near it.

Defined results: null, empty and wordless texts have no features but the bins,
and are scored by these; without labels of both kinds every text scores the base
rate (0.5 without any label); ties between neighbours go to the smaller id;
repeated rows score alike; an empty table gives an empty one; further columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.arrow import fold_key, slices

PER_CLASS = 1500  # bound of the learning sample, each class
WORDS, SHAPES, BINS = 4096, 2048, 128  # features of each kind
RANK, NEIGHBOURS, BASE = 48, 25, 0.5
CUTOFF = 0.3
BLOCK = 512  # documents multiplied at once
CACHE = 200_000  # distinct tokens whose features a worker keeps
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CHANGES = [(re.compile(p), r) for p, r in ((r"[^\W\d_]*[A-Z][^\W\d_]*[A-Z][^\W\d_]*", "A"), (r"[^\W\d_]+", "a"), (r"\d+", "0"))]


class Tokens(dict):
    """Feature numbers of a token: of its word (or -1) and of its shape."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > CACHE:
            self.clear()
        word = token[0].isalnum() or token[0] == "_"
        shape = token
        for pattern, kind in _CHANGES:
            shape = pattern.sub(kind, shape)
        own = zlib.crc32(token.lower().encode("utf-8", "replace")) % WORDS if word else -1
        self[token] = out = (own, zlib.crc32(shape.encode("utf-8", "replace")) % SHAPES)
        return out


def _bins(text: str, tokens: list[str]) -> list[int]:
    """One bin of each of eight ratios, sixteen bins a ratio."""
    words = [t for t in tokens if t[0].isalnum()]
    n, chars, lines = max(1, len(words)), max(1, len(text)), [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    ratios = (
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(len, words)) / n / 16,
        (len(tokens) - len(words)) / max(1, len(tokens)),
        sum(w.isupper() for w in words) / n,
        sum(w.isdigit() for w in words) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log2(chars) / 20,
    )
    return [16 * k + min(15, int(16 * r)) for k, r in enumerate(ratios)]


def features(text: str | None, known: Tokens) -> np.ndarray:
    """Damped relative frequencies of words, then of pairs of shapes, then bins."""
    text = text or ""
    tokens = _TOKEN.findall(text)
    out = np.zeros(WORDS + SHAPES + BINS, np.float32)
    if tokens:
        own = np.array([known[t] for t in tokens], np.int64)
        words, shapes = own[:, 0], own[:, 1]
        out[:WORDS] = np.bincount(words[words >= 0], minlength=WORDS)
        pairs = (shapes[:-1] * 31 + shapes[1:]) % SHAPES if len(shapes) > 1 else shapes
        out[WORDS : WORDS + SHAPES] = np.bincount(pairs, minlength=SHAPES)
        for part in (out[:WORDS], out[WORDS : WORDS + SHAPES]):
            np.sqrt(part / max(1, part.sum()), out=part)
    out[[WORDS + SHAPES + b for b in _bins(text, tokens)]] = 0.3
    return out


class Model:
    """Projection and labelled latent vectors; votes."""

    def __init__(self, base: float):
        self.base, self.idf, self.axes, self.vectors, self.labels = base, None, None, None, None

    def latent(self, x: np.ndarray) -> np.ndarray:
        out = (x * self.idf) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def vote(self, latent: np.ndarray) -> np.ndarray:
        near = latent @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        if k < near.shape[1]:
            order = np.argsort(-near, axis=1, kind="stable")[:, :k]
        else:
            order = np.broadcast_to(np.arange(k), near.shape)
        sim = np.maximum(np.take_along_axis(near, order, 1).astype(np.float64), 0) ** 4
        good = self.labels[order]
        return ((sim * good).sum(1) + BASE * self.base) / (sim.sum(1) + BASE)

    def score(self, texts: list[str | None], known: Tokens) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.base)
        out = np.empty(len(texts))
        for k in range(0, len(texts), BLOCK):
            out[k : k + BLOCK] = self.vote(self.latent(np.stack([features(t, known) for t in texts[k : k + BLOCK]])))
        return out


def train(texts: list[str | None], labels: list[int], base: float, seed: int = 5) -> Model:
    """Fit idf, axes (randomised subspace iteration) and labelled vectors."""
    model, rng = Model(base), np.random.default_rng(seed)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return model
    known = Tokens()
    x = np.stack([features(t, known) for t in texts])
    df = (x > 0).sum(0)
    model.idf = np.where(df > 1, np.log((1 + len(x)) / (1 + df)) + 0.3, 0).astype(np.float32)
    x *= model.idf
    q = rng.normal(size=(x.shape[1], min(RANK + 8, len(x)))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    model.axes = np.ascontiguousarray((q @ v.T)[:, :RANK]).astype(np.float32)
    latent = x @ model.axes
    model.vectors = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    model.labels = y.astype(np.float64)
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from at most per_class documents of each label, chosen by a hash of their ids."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(~held_out(F.col("_id")))
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = rows.filter("_y = 1").orderBy(order, "_id").limit(per_class).union(rows.filter("_y = 0").orderBy(order, "_id").limit(per_class))
    # The broadcast side has at most 2 * per_class rows of two numbers.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").limit(4 * per_class).collect()
    sample = sorted(sample, key=lambda r: (r["_id"], r["_text"] or ""))
    base = rows.agg(F.avg("_y")).first()[0]
    return train([r["_text"] for r in sample], [r["_y"] for r in sample], 0.5 if base is None else float(base))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id (and the columns in `keep`) with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for piece, texts in slices(batches, "_text", 4_000_000):
            s = sent.value.score(texts, known)
            yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array(s), pa.array((s >= CUTOFF).astype(np.int32))], names=[*piece.schema.names[1:], "score", "predicted"])

    rows = docs.select(F.col(text_col).alias("_text"), *dict.fromkeys([id_col, *keep]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(scan, f"{schema}, score double, predicted int")


def held_out(column):
    return F.coalesce((fold_key(column) % 5) == 0, F.lit(False))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; folds of crc32(doc_id) mod 5 = 0 are held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
