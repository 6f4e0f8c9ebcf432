"""Quality by nearest-neighbour voting in a latent space.

A text's features are counts of its terms (lower-case words, hashed), of its words' shapes (letters, capitals, digits
and signs, with runs shortened) and of shape pairs, hashed to buckets, and of bins of whole-text ratios such as the share
of repeated words. Counts are damped, weighted by inverse document frequency and projected by a truncated singular value
decomposition. The labelled
vectors, at most MOST_LABELLED, are broadcast; every document's cosines with all of them are computed in blocks, and
the NEIGHBOURS nearest vote by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import hash_share, held_out, keyed_text, prepare

#: The bounds of what is learnt from and broadcast: labelled rows (expected) and latent dimensions.
MOST_LABELLED, DIMENSIONS, NEIGHBOURS = 4000, 48, 15
BUCKETS, BINS, SHARPNESS, GOOD = 1024, 16, 4, 0.7
#: Buckets of terms, and their weight beside that of shapes.
TERMS, TERM_WEIGHT = 1024, 0.6
#: Directions beyond the wanted ones, and rounds of the iteration that finds them.
SPARE, ROUNDS = 16, 8

_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1{2,}", re.S)


def features(text: bytes) -> tuple[list[int], list[float]]:
    """(feature ids, damped counts) of a UTF-8 text; ids below BUCKETS are hashed shapes, then come binned ratios and hashed terms."""
    words = text.split()
    shapes = [_RUNS.sub(rb"\1\1", s) for s in text.translate(_SHAPE).split()] if words else []
    counts: Counter = Counter()
    for shape, n in Counter(shapes).items():
        counts[zlib.crc32(shape) % BUCKETS] += n
    for (a, b), n in Counter(pairwise(shapes)).items():
        counts[zlib.crc32(a + b" " + b) % BUCKETS] += n
    n, lines = max(1, len(words)), text.split(b"\n")
    lowered = Counter(text.lower().split())
    letters = sum(text.count(c) for c in (b"e", b"a", b"i", b"o", b"n"))
    ratios = (
        min(1.0, np.log1p(len(words)) / 10),
        len(lowered) / n,
        max(lowered.values(), default=0) / n,
        sum(a == b for a, b in pairwise(words)) / n,
        len(set(lines)) / len(lines),
        min(1.0, len(text) / n / 20),
        letters / max(1, len(text)),
        sum(text.count(c) for c in (b"*", b"%", b"#", b"$", b"&", b"|", b"!", b"_", b"=")) / n / 4,
    )
    ids = list(counts)
    values = [float(1 + np.log(counts[k])) for k in ids]
    for k, ratio in enumerate(ratios):  # neighbouring bins overlap, so near values stay near
        place = min(ratio, 1.0) * (BINS - 1)
        low = int(place)
        ids += [BUCKETS + k * BINS + low, BUCKETS + k * BINS + min(low + 1, BINS - 1)]
        values += [2 * (1 - place + low), 2 * (place - low)]
    terms: Counter = Counter()
    for word, count in lowered.items():
        terms[BUCKETS + 8 * BINS + zlib.crc32(word) % TERMS] += count
    ids += list(terms)
    values += [TERM_WEIGHT * float(1 + np.log(x)) for x in terms.values()]
    return ids, values


SIZE = BUCKETS + 8 * BINS + TERMS


def dense(rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
    out = np.zeros((len(rows), SIZE), np.float32)
    for k, (ids, values) in enumerate(rows):
        np.add.at(out[k], ids, values)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def main_axes(rows: np.ndarray, k: int) -> np.ndarray:
    """The first k right singular vectors as columns, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(5).standard_normal((rows.shape[1], min(k + SPARE, *rows.shape)))
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :k]


class Model:
    """Weights (idf), projection, and the labelled latent vectors with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
        weighted = unit(counts * self.weights)
        self.axes = main_axes(weighted, min(dimensions, *weighted.shape)).astype(np.float32)
        self.vectors, self.labels = unit(weighted @ self.axes), labels.astype(np.float32)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        near = unit(unit(counts * self.weights) @ self.axes) @ self.vectors.T  # exact cosines with all labelled rows
        k = min(neighbours, near.shape[1])
        # of equally near rows the one with the smaller id, which comes first, is taken
        edge = np.partition(near, -k, axis=1)[:, -k, None]
        rank = np.where(near > edge, 2, np.where(near == edge, 1, 0)).astype(np.int8)
        best = np.argsort(-rank, axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** SHARPNESS
        return (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most: int = MOST_LABELLED) -> Model | None:
    """A model of a hash sample of about `most` labelled rows at most that aren't held out; None if there are none."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.where(hash_share(F.col("id"), 23, most, known.count())).dropDuplicates(["id"])
    rows = keyed_text(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", "text", "label")

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["id", "label", "ids", "counts"])

    found = sorted((r["id"], r["label"], r["ids"], r["counts"]) for r in rows.mapInArrow(run, "id long, label int, ids array<int>, counts array<float>").collect())
    return Model(dense([(r[2], r[3]) for r in found]), np.array([r[1] for r in found])) if found else None


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from GOOD on).

    Learns from labels 0 and 1 of rows that aren't held out; a score sees the whole text only. Null texts count as
    empty, which are scored by their neighbours like any other; with nothing to learn from every score is 0.5. A null
    doc_id isn't held out and has no label. Of equally near labelled rows those with the smaller ids vote. Repeated rows
    each get their row, an empty table gives none, and only the named columns are read. Of a very long text only its
    features are held, 512 texts at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, id_col, text_col, label_col))

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = dense([features(t) for t in part["text"].cast(pa.binary()).to_pylist()])
                found = model.scores(counts) if model else np.full(len(counts), 0.5)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.clip(found, 0, 1).astype(np.float64))], ["doc_id", "score"])

    prepare(docs.sparkSession)
    out = keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
