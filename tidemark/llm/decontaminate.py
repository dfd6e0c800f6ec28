"""Benchmark decontamination by spaced seeds.

A mask keeps some word positions of a span and ignores the rest, so its hash survives substitutions at ignored positions. Test items and
documents are hashed under the same masks and joined on the hash; around each hit the aligned words are compared, and a hit stands where
a window of WINDOW words (the whole item where it is shorter) has at least SIMILAR of its words in common.

MASKS find every window of 13 words with up to 2 substitutions, wherever these fall. An item of fewer words has masks of its own length,
one more than the substitutions that SIMILAR allows it, no two of which keep the same position: one of them is left untouched. tests/llm
checks all placements for every length.

Words are runs without ASCII white space, in lower case and without ASCII signs. Defined results: a null or empty text or item has no words and matches nothing;
rows that repeat a doc_id count as one document; a null doc_id or item_id is a value like any other; windows that share equally many words
all count, so ties change nothing; texts of any length count whole;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import arrow_rows, loose_words, mix, table, texts

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 9))
WINDOW, SIMILAR = 13, 0.8
#: Bits of the filter of test hashes that every task holds: its size is fixed, whatever the test set's.
FILTER_BITS = 1 << 24
SEEDS = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("around", pa.binary()), ("before", pa.int32()), ("words", pa.int32())])
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("item_start", pa.int32()), ("item_end", pa.int32()), ("same", pa.int32()), ("words", pa.int32())])


def masks_of(n: int, window: int = WINDOW, similar: float = SIMILAR, masks: tuple = MASKS) -> tuple:
    """The masks of an item of n words: every k-th position from each of k beginnings where it is shorter than a window."""
    if n >= window:
        return masks
    k = n - int(np.ceil(similar * n - 1e-9)) + 1
    return tuple(dict.fromkeys(tuple(range(0, n - first, k)) for first in range(k)))


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash under a mask at each position where its span fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, offset in enumerate(mask):
        out = mix(out + words[offset : offset + n] + np.uint64(k * 0x9E3779B9 + mask[-1]))
    return out


def _filter_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def seeds(rows: DataFrame, key: str, masks, reach: int, only=None) -> DataFrame:
    """id, hash, at, and the word hashes around each seed (`before` of them before it); masks: a function of the number of words;
    only: a broadcast filter of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.unpackbits(np.frombuffer(only.value, np.uint8), bitorder="little") if only is not None else None
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = loose_words(text)
                for mask in masks(len(words)):
                    hashes, span = seed_hashes(words, mask), mask[-1] + 1
                    where = np.arange(len(hashes)) if keep is None else np.flatnonzero(keep[_filter_places(hashes, len(keep))].all(0))
                    for at in where.tolist():
                        start = max(0, at - reach)
                        out.append((i, int(hashes[at : at + 1].view(np.int64)[0]), at, words[start : at + span + reach].tobytes(), at - start, len(words)))
                if len(out) > 2000:
                    yield arrow_rows(out, SEEDS)
                    out = []
            yield arrow_rows(out, SEEDS)

    return rows.select(F.col(key).cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, from_arrow_schema(SEEDS))


def hash_filter(tests: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bit set of the hashes in tests(hash), made of the parts' bit sets; `bits` in all, however many hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            held[_filter_places(batch.column(0).to_numpy().view(np.uint64), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in tests.select("hash").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row["bits"], np.uint8)
    return whole.tobytes()


def overlaps(docs: DataFrame, tests: DataFrame, masks: tuple = MASKS, window: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """Verified overlaps of docs(doc_id, text) with tests(item_id, text), a row for each document, item and alignment: word ranges
    (end exclusive) that the standing windows cover, the same words in the best window, and its length.

    Only document seeds that pass the filter are shuffled, each with the few words around it; Spark broadcasts the test seeds only if
    they are small, by its own threshold, and splits skewed ones otherwise.
    """
    spark = docs.sparkSession

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(loose_words(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    short = tests.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lengths, "n long").where(f"n between 1 and {window - 1}").distinct().collect()  # a window's length of rows at most
    each = {n: masks_of(n, window, similar, masks) for n in range(1, window + 1)}
    every = tuple(dict.fromkeys([*masks, *(m for r in short for m in each[r["n"]])]))
    wanted = seeds(tests, "item_id", lambda n: each.get(min(n, window), ()), window)
    only = spark.sparkContext.broadcast(hash_filter(wanted))
    found = seeds(docs, "doc_id", lambda n: every, window, only)
    pairs = found.select([F.col(c).alias(f"d_{c}") for c in found.columns]).join(wanted, F.col("d_hash") == F.col("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["d_around"], np.uint64), np.frombuffer(r["around"], np.uint64)
                back = min(r["d_before"], r["before"])
                a, b = a[r["d_before"] - back :], b[r["before"] - back :]
                n, size = min(len(a), len(b)), min(window, r["words"])
                if n < size:
                    continue
                equal = np.concatenate(([0], np.cumsum(a[:n] == b[:n])))
                same = equal[size:] - equal[:-size]
                good = np.flatnonzero(same >= similar * size - 1e-9)
                if len(good):
                    low, high = int(good[0]), int(good[-1]) + size
                    doc, item = r["d_at"] - back, r["at"] - back
                    out.append((r["d_id"], r["id"], doc + low, doc + high, item + low, item + high, int(same.max()), size))
            yield arrow_rows(out, HITS)

    hits = pairs.select("d_id", "d_at", "d_around", "d_before", "id", "at", "around", "before", "words").mapInArrow(run, from_arrow_schema(HITS))
    return (
        hits.groupBy("doc_id", "item_id", (F.col("doc_start") - F.col("item_start")).alias("diagonal"))
        .agg(F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"), F.min("item_start").alias("item_start"), F.max("item_end").alias("item_end"), F.max("same").alias("same_words"), F.max("words").alias("window_words"))
        .drop("diagonal")
    )


def decontaminate(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """docs without those that overlap a test item; all columns of docs."""
    hit = overlaps(docs, tests).select(F.struct("doc_id").alias("hit")).distinct().alias("found")
    return docs.alias("docs").join(hit, F.col("docs.doc_id").eqNullSafe(F.col("found.hit.doc_id")), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
