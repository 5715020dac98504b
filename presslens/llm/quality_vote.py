"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A text is a bag of hashed byte trigrams, weighted by inverse document frequencies counted over all
documents, together with a few terms for its shape (length, symbols, capitals, repeated words). A
truncated singular value decomposition of a bounded sample of labelled documents (``LABELLED``, the
first ones by a hash of doc_id) gives the space. The labelled vectors are broadcast, every document
meets all of them in blocks of cosine products, and its ``NEIGHBOURS`` nearest vote, weighted by
similarity. Only the text enters a score.

Labels are learned only from rows whose CRC-32 of doc_id leaves a remainder other than 0 by 5. Null
labels say nothing; a document with several labels has their mean, one with several texts is learned from one of them. A null text is read as empty,
and an empty one has its shape terms, so it is scored like any other. Without any label scores are
0.5. A null doc_id hashes like an empty string. Repeated rows are scored alike; no rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm.common import materialize, table

LABELLED, DIMENSIONS, NEIGHBOURS, SHARPNESS = 3000, 48, 25, 8
GRAMS = 4096
LEVELS, SHAPE_WEIGHT = 12, 0.35
SHAPES = ("length", "line_length", "symbols", "capitals", "distinct", "word_length")
TERMS = GRAMS + LEVELS * len(SHAPES)
DOCS_AT_ONCE = 128
CAPITALS = np.isin(np.arange(256), np.arange(65, 91))
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!=@^~_{}[]\\/+", np.uint8))


def grams(text: bytes) -> np.ndarray:
    """How often each hashed trigram of bytes occurs."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAMS, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=GRAMS)


def shape(text: bytes) -> np.ndarray:
    """The level of each shape term, from 0 to ``LEVELS - 1``."""
    b, words = np.frombuffer(text, np.uint8), text.split()
    counts = np.bincount(b, minlength=256)
    n, w = max(len(b), 1), max(len(words), 1)
    logs = [np.log2(1 + len(words)) * 0.75, np.log2(1 + len(b) / (1 + counts[10])) * 0.9]
    shares = [counts[SYMBOLS].sum() / n * 3, counts[CAPITALS].sum() / n * 3, len(set(words)) / w * 0.999, min(n / w / 16, 0.999)]
    return np.minimum([int(x) for x in logs] + [int(s * LEVELS) for s in shares], LEVELS - 1)


def features(texts: list[bytes | None], idf: np.ndarray) -> np.ndarray:
    """A row of unit length for each text: trigrams, then one term for the level of each shape."""
    x = np.zeros((len(texts), TERMS))
    for row, text in enumerate(texts):
        counts = grams(text or b"")
        x[row, :GRAMS] = np.log1p(counts) * idf
        norm = np.sqrt((x[row] * x[row]).sum())
        x[row] /= norm or 1
        x[row, GRAMS + np.arange(len(SHAPES)) * LEVELS + shape(text or b"")] = SHAPE_WEIGHT
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.space
        return y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-12)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosines = self.project(features(texts, self.idf)) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-3) ** SHARPNESS
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each hashed trigram occurs, over all of them, and how many there are: one sum per trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(GRAMS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                n += grams(t.as_py() or b"") > 0
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, GRAMS)), pa.array(np.concatenate([[total], n]))], names=["gram", "n"])

    sums = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = {r["gram"]: r["n"] for r in sums.collect()}
    return np.array([found.get(g, 0) for g in range(GRAMS)], np.float64), found.get(-1, 0)


def remainder(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED, seed: int = 3) -> Model:
    n, total = document_frequencies(docs, text)
    idf = np.log((1 + total) / (1 + n)) + 0.05
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key) != 0)).groupBy(F.col(key).alias("k")).agg(F.avg(label).alias("y"))
    chosen = materialize(known.orderBy(F.xxhash64("k"), "k").limit(most), "labelled")  # bounded by ``most``
    spec = docs.sparkSession.sparkContext.broadcast(idf)
    kind = chosen.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                x = features(part.column(2).to_pylist(), spec.value)
                used = [np.flatnonzero(r) for r in x]
                terms = pa.array([u.astype(np.int16) for u in used], pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), terms, pa.array([r[u] for r, u in zip(x, used, strict=True)], pa.list_(pa.float64()))], names=["k", "y", "terms", "weights"])

    # one text for each label, however often its document is repeated; of several that with the smallest hash
    body = F.col(text).cast("binary")
    met = docs.select(F.col(key).alias("d"), F.struct(F.xxhash64(body).alias("h"), body.alias("t")).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("k"))
    once = met.groupBy("k").agg(F.first("y").alias("y"), F.min("t").alias("t")).select("k", "y", "t.t")
    rows = once.mapInArrow(run, f"k {kind}, y double, terms array<short>, weights array<double>").collect()  # bounded by ``most``
    rows.sort(key=lambda r: r["k"])
    x = np.zeros((len(rows), TERMS))
    for i, r in enumerate(rows):
        x[i, r["terms"]] = r["weights"]
    y = np.array([r["y"] for r in rows])
    if not len(y):
        return Model(idf, np.zeros((TERMS, 1)), np.zeros((0, 1)), y)
    # randomised range finder with a few power steps, then an exact decomposition of the small rest
    rank = min(DIMENSIONS, len(y))
    basis = x.T @ np.random.default_rng(seed).standard_normal((len(y), min(rank + 16, len(y))))
    for _ in range(4):
        basis = np.linalg.qr(basis)[0]
        basis = x.T @ (x @ basis)
    basis = np.linalg.qr(basis)[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    model = Model(idf, np.ascontiguousarray(basis @ right[:rank].T), np.empty(0), y)
    model.vectors = model.project(x)
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row. The model is broadcast: its size is set by LABELLED, TERMS and DIMENSIONS."""
    spec = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spec.value.score(part.column(1).to_pylist()), pa.float64())], names=[key, "score"])

    return docs.select(key, F.col(text).cast("binary").alias("t")).mapInArrow(run, f"`{key}` {kind}, score double")


def op8_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
