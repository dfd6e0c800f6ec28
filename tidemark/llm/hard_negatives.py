"""Hard-negative mining over integer vectors, with exact scores from a residue number system.

Scores are inner products of integer components. The components are taken modulo a few primes below 1024, as centred residues in float32; a
matrix product over at most DIMS components then stays below 2^24 and is exact. The residues of a score under all primes give the signed score
back by the Chinese remainder theorem. How many primes are needed follows from the largest squared norm of all rows, which bounds every score.

Anchors are a stated query set that meets every row. Rows stay where they are: each task scores the rows of its partition in blocks, against
the anchors, which it reads in batches from the shared folder. Tasks return an anchor's best rows of each block only, and windows over these
select the whole table's best. A first pass finds the positives, a second the negatives within the positives' windows.

Defined results: rows with a null label, vector or vec_id, or with a component that is null or not finite, take no part; of rows that repeat
a vec_id the one with the smallest label, then the smallest vector, counts; of vectors of unlike lengths the shorter one goes on with zeros;
an anchor without other rows of its label has no positives and no result; equal scores come in order of vec_id; an empty table gives an empty
result; other columns are not read. Scores have to be below 2^51: longer vectors than that are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import cut, drop_written, open_shared, table

#: Components of one float32 product: DIMS times the square of half a prime stays below 2^24.
DIMS, LARGEST = 64, 1023
#: Rows of a block, anchors of a batch. Results do not depend on them.
ROWS, ANCHORS = 8192, 128
#: No score may reach this.
LIMIT = 1 << 51
LEAST = np.iinfo(np.int64).min

BEST = pa.schema([(c, pa.int64()) for c in ("anchor_id", "other_id", "score")])
WITHIN = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])


def primes_for(bound: int) -> list[int]:
    """The largest primes up to LARGEST whose product tells all integers from -bound to bound apart."""
    found, product = [], 1
    for n in range(LARGEST, 1, -1):
        if product > 2 * bound + 1:
            break
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            found.append(n)
            product *= n
    return found


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime, centred on 0, as float32."""
    out = []
    for p in primes:
        r = matrix % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (int64) of all rows of two matrices given as residues."""
    value, product = None, 1
    for x, y, p in zip(a, b, primes, strict=True):
        left = np.zeros((len(x), len(y)), np.int64)
        for at in range(0, x.shape[1], DIMS):
            left += (x[:, at : at + DIMS] @ y[:, at : at + DIMS].T).astype(np.int64)
        left %= p
        if value is None:
            value = left
        else:  # the next digit of the score in mixed radix
            value = value + product * ((left - value) * pow(product, -1, p) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


def best(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest keys of each row, without those that are LEAST."""
    if keys.shape[1] > k:
        columns = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]
    else:
        columns = np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    rows = np.broadcast_to(np.arange(len(keys))[:, None], columns.shape)
    there = keys[rows, columns] != LEAST
    return rows[there], columns[there]


def as_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    lens = np.asarray(pa.compute.list_value_length(vectors))
    out = np.zeros((len(vectors), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)] = np.asarray(vectors.flatten())
    return out


class Block:
    """Rows in order of vec_id, as residues."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, width: int, primes: list[int]):
        ids = np.asarray(batch["vec_id"])
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], np.asarray(batch["label"])[order]
        vectors = batch["vector"]
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        self.residues = residues(as_matrix(vectors, width)[order], primes)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task in tables of so many rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if n and n + part.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def anchor_batches(files: list[str]) -> Iterator[pa.RecordBatch]:
    for uri in files:
        with open_shared(uri) as f:
            yield from pq.ParquetFile(f).iter_batches(ANCHORS)


def integer_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (floor of the scaled components) of rows(vec_id, label, embedding) that take part, one a vec_id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where("vec_id is not null and label is not null and embedding is not null").where(whole)
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, vector of integers).

    An anchor's positives are its best rows of the same label. The negatives of both are the best rows of other labels whose score lies
    between low and high percent of the positive's. Anchors go to the shared folder; rows are written there once and read twice.
    """
    rows = cut(rows, "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(squares), F.max(F.size("vector"))).first()
    bound, width = int((top[0] or 0) * 1.001) + 1, max(top[1] or 0, 1)
    if bound >= LIMIT:
        raise ArithmeticError(f"scores may reach {bound}; they have to stay below {LIMIT}")
    primes = primes_for(bound)
    at_once = max(1, min(ROWS, (1 << 62) // (bound + 1)))  # a score and a place share 64 bits

    anchors = cut(rows.where(is_anchor).select("vec_id", "label", "vector"), "anchors")
    files = anchors.inputFiles()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, at_once):
            block = Block(part, width, primes)
            place = np.arange(len(block.ids))[::-1]
            for batch in anchor_batches(files):
                some = Block(batch, width, primes)
                score = scores(some.residues, block.residues, primes)
                peer = (some.labels[:, None] == block.labels) & (some.ids[:, None] != block.ids)
                r, c = best(np.where(peer, score * len(place) + place, LEAST), positives)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some.ids[r], block.ids[c], score[r, c])], schema=BEST)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    found = rows.mapInArrow(nearest, from_arrow_schema(BEST)).withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    found = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "other_id", "score"))).alias("peers"))
    ready = cut(anchors.join(found, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "vector", "peers.other_id", "peers.score"), "anchors")
    ready_files = ready.inputFiles()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, at_once):
            block = Block(part, width, primes)
            place = np.arange(len(block.ids))[::-1]
            for batch in anchor_batches(ready_files):
                batch = batch.take(pa.array(np.argsort(np.asarray(batch["vec_id"]), kind="stable")))
                some = Block(batch, width, primes)
                score = scores(some.residues, block.residues, primes)
                keys = np.where(some.labels[:, None] != block.labels, score * len(place) + place, LEAST)
                peers, marks = (np.asarray(batch[c].flatten()) for c in ("other_id", "score"))
                lens = np.asarray(pa.compute.list_value_length(batch["score"]))
                start = np.cumsum(lens) - lens
                for k in range(positives):
                    own = np.flatnonzero(lens > k)
                    if not len(own):
                        break
                    mark = marks[start[own] + k]
                    inside = (score[own] >= (-(-low * mark // 100))[:, None]) & (score[own] <= (high * mark // 100)[:, None])
                    r, c = best(np.where(inside, keys[own], LEAST), negatives)
                    r_all = own[r]
                    columns = (some.ids[r_all], peers[start[r_all] + k], mark[r], block.ids[c], score[r_all, c])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=WITHIN)

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    mined = rows.mapInArrow(within, from_arrow_schema(WITHIN)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = cut(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for done in (rows, anchors, ready):
        drop_written(done)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""
