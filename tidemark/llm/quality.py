"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of hashed terms (character trigrams, their shapes, and coarse style terms for repetition, case and signs), damped
by log, weighted by inverse document frequency and folded into a few latent dimensions of a singular value decomposition. The labelled
vectors, a bounded number, go to every task; each block of documents takes exact cosines with all of them, and the NEIGHBOURS nearest
vote with their similarity as weight.

Defined results: a null or empty text has no terms and gets the labels' mean as score; so does a text that is like no labelled one; with
nothing to learn from, every score is 0.5; texts of any length count whole; repeated rows come back as often as they came; labels whose
document is missing, or that are null, are left out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import arrow_rows, mix, table, texts
from tidemark.llm.language_id import held_out

#: Hashed terms, latent dimensions, labelled rows that are learned from (about, by hash of the text) and neighbours that vote.
TERMS, LATENT, LEARN_ROWS, NEIGHBOURS = 2048, 48, 4_000, 15
#: Style terms follow the hashed ones: so many levels of each trait, so much weight.
LEVELS, TRAITS, STYLE_WEIGHT = 10, 6, 1.5
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
SAMPLE = pa.schema([("label", pa.int32()), ("terms", pa.binary())])


def _shapes() -> np.ndarray:
    """For each code point below U+0500 its shape: A, a, 0, blank, or the sign itself; others are letters."""
    out = np.arange(0x500, dtype=np.uint64)
    for c in range(0x500):
        x = chr(c)
        if x.isalpha():
            out[c] = ord("A" if x.isupper() else "a")
        elif x.isdigit():
            out[c] = ord("0")
    return out


_SHAPE = _shapes()


def terms(text: str) -> np.ndarray:
    """The damped term vector of a text (TERMS + LEVELS * TRAITS floats); zeros for an empty one."""
    out = np.zeros(TERMS + LEVELS * TRAITS, np.float32)
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shape = np.where(points < 0x500, _SHAPE[np.minimum(points, 0x4FF).astype(np.int64)], np.uint64(ord("a")))
    half = TERMS // 2
    for i, x in enumerate((points, shape)):
        if len(x) >= 3:
            code = (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]
            out[i * half : (i + 1) * half] = np.bincount((mix(code) >> np.uint64(33)).astype(np.int64) % half, minlength=half)
    np.log1p(out, out=out)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(text)
    traits = (
        len(set(words)) / len(words) if words else 1,
        len(set(lines)) / len(lines) if lines else 1,
        float((shape == ord("A")).sum()) / n,
        float(((shape != ord("a")) & (shape != ord("A")) & (shape != ord(" "))).sum()) / n,
        min(1, len(words) / 200),
        sum(map(str.__eq__, words, words[1:])) / len(words) if words else 0,
    )
    for k, x in enumerate(traits):
        # linear between the two nearest levels
        at = min(max(x, 0), 1) * (LEVELS - 1)
        low = int(at)
        out[TERMS + k * LEVELS + low] += low + 1 - at
        if low + 1 < LEVELS:
            out[TERMS + k * LEVELS + low + 1] += at - low
    return out


class LatentVotes:
    """Labelled latent vectors and the way into their space."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels, self.neighbours = labels.astype(np.float32), neighbours
        if not len(labels):
            return
        seen = (vectors > 0).sum(0)
        self.weight = np.log((1 + len(vectors)) / (1 + seen)).astype(np.float32) + 0.1
        self.weight[TERMS:] = STYLE_WEIGHT
        x = self.weighted(vectors)
        _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.axes = axes[:, ::-1][:, :latent].astype(np.float32)
        self.known = self.fold(vectors)

    def weighted(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors * self.weight
        for part in (slice(0, TERMS), slice(TERMS, None)):  # hashed and style terms weigh alike in any text
            size = np.linalg.norm(x[:, part], axis=1, keepdims=True)
            x[:, part] /= np.where(size > 0, size, 1)
        return x

    def fold(self, vectors: np.ndarray) -> np.ndarray:
        x = self.weighted(vectors) @ self.axes
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        like = self.fold(vectors) @ self.known.T
        k = min(self.neighbours, like.shape[1])
        near = np.argpartition(-like, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(like, near, 1), 0).astype(np.float64)
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)


def learn_votes(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> LatentVotes:
    """Fit on about `rows` labelled rows of docs(doc_id, text) and labels(doc_id, quality), drawn by hash of doc_id; that many vectors reach the driver."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    share = min(1.0, rows / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [terms(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], schema=SAMPLE)

    got = texts(docs).join(labels, "doc_id").select("label", "text").mapInArrow(run, from_arrow_schema(SAMPLE)).collect()
    got = sorted((bytes(r["terms"]), r["label"]) for r in got)
    vectors = np.frombuffer(b"".join(t for t, _ in got), np.float32).reshape(len(got), TERMS + LEVELS * TRAITS)
    return LatentVotes(vectors, np.array([y for _, y in got], np.int64))


def quality(docs: DataFrame, votes: LatentVotes, at_once: int = 500) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text). A map over the scan; what is broadcast is bounded by the fit's parameters."""
    shared = docs.sparkSession.sparkContext.broadcast(votes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                scores = shared.value.scores(np.stack([terms(t) for t in part.column(1).to_pylist()]))
                empty = np.array([not t for t in part.column(1).to_pylist()])
                scores[empty] = shared.value.prior
                yield arrow_rows(list(zip(part.column(0).to_pylist(), scores.tolist(), strict=True)), OUT)

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, from_arrow_schema(OUT))


def op5_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality(docs, learn_votes(docs, labels.where(~held_out(5, 0))))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
