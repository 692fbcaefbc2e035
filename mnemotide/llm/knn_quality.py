"""Quality by nearest-neighbour voting: labelled latent-semantic vectors, exact blocked cosines, weighted votes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import bounded_sample, trigram_counts

BITS = 12


def repetition(text: str) -> np.ndarray:
    """Square roots of three rates: words equal to the one before, to the second before, lines seen before."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n = max(1, len(words))
    one = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    two = sum(a == b for a, b in zip(words, words[2:], strict=False)) / n
    return np.sqrt([one, two, 1 - len(set(lines)) / max(1, len(lines))])


def term_vector(text: str | None) -> np.ndarray:
    """Raw terms of a whole text: log counts of hashed byte trigrams, then the repetition rates."""
    text = text or ""
    return np.concatenate([np.log1p(trigram_counts(text.encode("utf-8", "surrogatepass"), BITS)), repetition(text)]).astype(np.float32)


@dataclass
class Model:
    """What scoring needs: weights of terms, the latent basis, labelled latent unit vectors and their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    power: float

    def latent(self, terms: np.ndarray) -> np.ndarray:
        return _latent(terms, self.idf, self.basis)

    def scores(self, latent: np.ndarray) -> np.ndarray:
        """Mean label of the nearest labelled vectors, weighted by a power of their cosine; else the mean label. Of vectors
        that tie for the last place the first count, in the order of their documents' ids."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(latent), prior)
        sims = latent @ self.vectors.T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        tied = (sims >= np.take_along_axis(sims, near, 1).min(axis=1)[:, None]).sum(axis=1) > k
        near[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** self.power
        total = weight.sum(axis=1)
        voted = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, voted, prior), 0, 1)


def _weighted(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Trigram part scaled by idf to length 1, repetition rates as they are."""
    n = len(idf)
    out = terms.astype(np.float32).copy()
    out[:, :n] *= idf
    norm = np.sqrt((out[:, :n] ** 2).sum(axis=1, keepdims=True))
    out[:, :n] /= np.where(norm > 0, norm, 1)
    return out


def _latent(terms: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = _weighted(terms, idf) @ basis
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return (z / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(terms: np.ndarray, labels: np.ndarray, dims: int = 64, neighbours: int = 16, power: float = 8.0, seed: int = 11) -> Model:
    """Latent-semantic analysis by a randomised truncated singular value decomposition with a fixed seed."""
    n = 1 << BITS
    idf = (np.log((1 + len(terms)) / (1 + (terms[:, :n] > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = _weighted(terms, idf)
    width = min(dims + 16, *rows.shape) if len(rows) else 0
    if not width:
        return Model(idf, np.zeros((rows.shape[1], 1), np.float32), np.zeros((0, 1), np.float32), labels, neighbours, power)
    y = rows @ np.random.default_rng(seed).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = rows @ (rows.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(q.T @ rows, full_matrices=False)
    basis = np.ascontiguousarray(vt[:dims].T, np.float32)
    return Model(idf, basis, _latent(terms, idf, basis), labels.astype(np.float64), neighbours, power)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            rows = [term_vector(t) for t in part.column(0).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            cells = [pa.array([i.astype(np.int16) for i in at], pa.list_(pa.int16())), pa.array([r[i] for r, i in zip(rows, at, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*cells, part.column(1), part.column(2)], names=["at", "value", "label", "id"])


def fit_on(docs: DataFrame, labelled: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Model:
    """A model from at most `sample_rows` labelled documents (those with the lowest hash of the id), fitted here.

    `labelled` has ids and labels; several labels of a document are averaged, null labels and ids drop. Of
    documents that repeat an id the smallest text counts.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    chosen = bounded_sample(known.groupBy("id").agg(F.avg("label").alias("label")), sample_rows, "id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    once = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = once.select("text", "label", "id").mapInArrow(_terms, f"at array<short>, value array<float>, label double, id {once.schema['id'].dataType.simpleString()}").collect()
    found.sort(key=lambda r: r.id)
    terms = np.zeros((len(found), (1 << BITS) + 3), np.float32)
    for i, r in enumerate(found):
        terms[i, r["at"]] = r["value"]
    return fit(terms, np.array([r.label for r in found], np.float64), **options)


def _scored(shared, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                terms = np.stack([term_vector(t) for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(m.scores(m.latent(terms))), *part.columns[1:]], names=["score", *part.schema.names[1:]])

    return run


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block: int = 256) -> DataFrame:
    """(doc_id, score, predicted, columns in `keep`): one row for each row of `docs`, in one pass, no shuffle.

    The broadcast model has at most sample_rows * dims + 4099 * (dims + 1) numbers, whatever the input. Every
    document meets every labelled vector, in blocks. Null and empty texts have no terms and score the mean label.
    Repeated rows score each; a null id passes through; very long texts are read whole. An empty table gives an empty result; without labels all
    score 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = ", ".join(["score double, _id long", *[f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]])
    out = given.mapInArrow(_scored(shared, block), schema)
    return out.select(F.col("_id").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
