"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: of every WINDOW consecutive K-word grams the one with the smallest hash (so any shared run of WINDOW + K - 1 words has a seed).
2. A seed that several documents have refers each of them to the first, the smallest doc_id: links grow with the occurrences of a seed,
   not with their square.
   Seeds that are SPANS words apart are so linked again, as one run with all words between them: where parts of a passage stand alone in
   earlier documents, the runs over its seams still lead to the first document that has it whole. Every run that stands word for word in
   earlier documents and has 70 words or more (LEAST words and two windows) has a run of LEAST words or more among its own.
   A shared seed and the next shared one SPANS words on also refer to the first document that has both so, whatever stands between: parts
   whose first documents differ, or that stand elsewhere in the source before, are so met where they follow one another, over a change
   at their seam.
3. The seeds and ends of runs that a document shares with one earlier document are chained: an ordered run of matches, each worth its words less GAP for
   every word skipped on either side. The best predecessor is taken among the seeds at most REACH words before, on either side.
   A chain that is no passage takes in all seeds that both texts have around it, whoever has them first.
4. Chains are aligned word by word between their seeds (equal diagonals directly, others by longest common subsequence), extended at both
   ends, and cut to their best part; a passage has at least LEAST words with SIMILAR of them in common, in order.

Words are runs without ASCII white space, A-Z lowered; positions count words. Defined results: null, empty and short texts have no
passages; a passage that repeats only inside one document is none; the earliest document with a seed is its source and not reported for
it; rows with a null doc_id take no part; doc_id names a text, so of rows that repeat one with another text only one is aligned; ties go to the smaller doc_id,
then position; texts of any length count whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import BASE, arrow_rows, cut, drop_written, gram_hashes, mix, table, texts, word_hashes
from tidemark.llm.ngram_join import id_filter

K, WINDOW, GAP, LEAST, SIMILAR, PAD = 6, 12, 0.15, 48, 0.8, 64
#: Words between two seeds of a chain at most, on either side.
REACH = 60
#: Words from the first seed of a run to its last, at least. The first: any LEAST words in common hold a run (SPANS + 2 * (WINDOW - 1) + K
#: words at most); the second: the run alone has LEAST words.
SPANS = (LEAST - K - 2 * (WINDOW - 1), LEAST - K)
#: width: words from the first seed of a run to its last; 0 for a seed.
#: Odd multipliers of the hashes of two seeds; any odd numbers would do.
PAIR_A, PAIR_B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
SEEDS = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("width", pa.int32())])
CHAINS = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("source_first", pa.int32()), ("source_last", pa.int32()), ("anchors", pa.binary())])
FOUND = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), *((c, pa.int32()) for c in ("start", "end", "source_start", "source_end", "same_words"))])


def minimizers(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's seeds, in order; a hash that follows itself counts once."""
    if len(words) < k:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = gram_hashes(words, k)
    w = min(window, len(h))
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, w).argmin(1) + np.arange(len(h) - w + 1))
    found = h[at]
    keep = np.concatenate(([True], found[1:] != found[:-1]))
    return found[keep].view(np.int64), at[keep].astype(np.int32)


def spans(words: np.ndarray, pos: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, positions and widths of a text's runs from one seed to another; pos: of all seeds, keep: those that other texts may have.

    Last come pairs of such seeds, whatever stands between: a seed and the next of them a span further on, as long as a chain reaches it."""
    powers = np.full(len(words) + 1, BASE, np.uint64)
    back = np.full(len(words) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[:-1], dtype=np.uint64)))
    hashes, starts, widths = [], [], []
    for span in SPANS:
        last = np.searchsorted(pos, pos + span)
        i = np.flatnonzero((last < len(pos)) & keep & keep[np.minimum(last, len(pos) - 1)])
        a, b = pos[i], pos[last[i]]
        hashes.append(mix((sums[b + K] - sums[a]) * back[a] + np.uint64(span)).view(np.int64))
        starts.append(a)
        widths.append(b - a)
    held = pos[keep]
    grams = gram_hashes(words, K) if len(held) else words
    for span in SPANS:
        last = np.searchsorted(held, held + span)
        i = np.flatnonzero(last < len(held))
        i = i[held[last[i]] - held[i] <= REACH]
        a, b = held[i], held[last[i]]
        hashes.append(mix(grams[a] * PAIR_A + grams[b] * PAIR_B).view(np.int64))
        starts.append(a)
        widths.append(b - a)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(widths)


def seeds(docs: DataFrame, only=None) -> DataFrame:
    """hash, doc_id, pos, width of all seeds; only: a broadcast filter of hashes, seeds in which also make runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(only.value, np.uint8), bitorder="little") if only is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, hashes, ids, places, widths = batch.slice(at, 500), [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = word_hashes(text)
                    h, pos = minimizers(words)
                    width = np.zeros(len(h), np.int32)
                    if bits is not None and len(h):
                        keep = bits[(mix(h.view(np.uint64)) & np.uint64(len(bits) - 1)).astype(np.int64)] > 0
                        runs = spans(words, pos, keep)
                        h, pos, width = (np.concatenate(x) for x in zip((h[keep], pos[keep], width[keep]), runs, strict=True))
                    hashes.append(h)
                    places.append(pos)
                    widths.append(width)
                    ids.append(np.full(len(h), doc_id, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, ids, places, widths)], schema=SEEDS)

    return docs.mapInArrow(run, from_arrow_schema(SEEDS))


def chains(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Indexes of the seeds of each chain, best first, each seed in one chain at most. x, y: positions in the two texts.

    score(j) = K + the best score(i) - GAP * (skipped words) over i before j and at most REACH before it, in both texts. Only seeds in
    reach are looked at, so a far one never hides a near one; a text has a bounded number of them.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    one = len(x) > 1 and bool(((x - y) == x[0] - y[0]).all())
    x, y = x.tolist(), y.tolist()
    score, before = [float(K)] * len(x), [-1] * len(x)
    # on one diagonal no predecessor is better than the seed before, which adds K and costs no more
    for j in range(1, len(x)) if one else ():
        if 0 < x[j] - x[j - 1] <= REACH:
            value = K + score[j - 1] - 2 * GAP * (x[j] - x[j - 1])
            if value > score[j]:
                score[j], before[j] = value, j - 1
    low = 0  # the first seed in reach
    for j in () if one else range(len(x)):
        xj, yj = x[j], y[j]
        while xj - x[low] > REACH:
            low += 1
        for i in range(low, j):
            if x[i] < xj and 0 < yj - y[i] <= REACH:
                value = K + score[i] - GAP * (xj - x[i] + yj - y[i])
                if value > score[j]:
                    score[j], before[j] = value, i
    out, used = [], [False] * len(x)
    for j in sorted(range(len(x)), key=lambda j: (-score[j], j)):
        path, i = [], j
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if len(path) > 1 and x[path[0]] - x[path[-1]] + K + 2 * WINDOW >= LEAST // 2:
            out.append(order[path[::-1]])
    return out


def chain_table(matches: DataFrame) -> DataFrame:
    """Chains of matches(doc_id, source_id, pos, source_pos, width, source_width), a pair of documents at a time in sorted partitions."""

    def made(key: tuple, x: np.ndarray, y: np.ndarray, width: np.ndarray, source_width: np.ndarray) -> list[tuple]:
        runs = width > 0
        x, y = (np.concatenate((v, v[runs] + w[runs])) for v, w in ((x, width), (y, source_width)))
        if len(x) < 2:
            return []
        both = np.unique(x.astype(np.int64) << 32 | y)
        x, y = both >> 32, both & 0xFFFFFFFF
        rows = []
        for path in chains(x, y):
            a, b = x[path].astype(np.int32), y[path].astype(np.int32)
            rows.append((*key, int(a[0]), int(a[-1]) + K, int(b[0]), int(b[-1]) + K, np.stack([a, b]).tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(6)]
            part = part if rest is None else [np.concatenate(p) for p in zip(rest, part, strict=True)]
            if not len(part[0]):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]))))
            rows = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                rows += made((int(part[0][s]), int(part[1][s])), *(p[s:e] for p in part[2:]))
            rest = [p[starts[-1] :] for p in part]
            yield arrow_rows(rows, CHAINS)
        if rest is not None and len(rest[0]):
            yield arrow_rows(made((int(rest[0][0]), int(rest[1][0])), *rest[2:]), CHAINS)

    keys = ("doc_id", "source_id")
    return matches.select(*keys, "pos", "source_pos", "width", "source_width").repartition(*keys).sortWithinPartitions(*keys, "pos", "source_pos").mapInArrow(run, from_arrow_schema(CHAINS))


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at: dict[int, int] = {}
    for i, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for w in a:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def align_diagonal(a: np.ndarray, b: np.ndarray, first: int, last: int, shift: int) -> tuple[int, int, int, int, int] | None:
    """align() for a chain from first to last in a whose seeds all stand `shift` words further in b: the best run of words."""
    first, last = max(first - PAD, 0, -shift), min(last + PAD, len(a), len(b) - shift)
    same = a[first:last] == b[first + shift : last + shift]
    gained = np.concatenate(([0.0], np.cumsum(same - SIMILAR)))
    lowest = np.minimum.accumulate(gained)
    end = int((gained - lowest).argmax())
    start = end - int(gained[end::-1].argmin())  # of equal ones the last: no more words than needed
    if end - start < LEAST:
        return None
    return first + start, first + end, first + start + shift, first + end + shift, int(same[start:end].sum())


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """The passage around a chain of seeds at x in a and y in b: start and end in both, and the words in common; or None."""
    if ((x - y) == x[0] - y[0]).all():
        return align_diagonal(a, b, int(x[0]), int(x[-1]) + K, int(y[0] - x[0]))
    pieces = []  # a start, a end, b start, b end, same
    for i in range(len(x)):
        if i and (pieces[-1][1] > x[i] or pieces[-1][3] > y[i]):  # overlaps the seed before
            step = max(pieces[-1][1] - x[i], pieces[-1][3] - y[i])
            if step >= K:
                continue
            pieces.append((x[i] + step, x[i] + K, y[i] + step, y[i] + K, K - step))
        else:
            if i:
                sa, sb = a[pieces[-1][1] : x[i]], b[pieces[-1][3] : y[i]]
                same = int((sa == sb).sum()) if len(sa) == len(sb) else common(sa.tolist(), sb.tolist())
                pieces.append((pieces[-1][1], x[i], pieces[-1][3], y[i], same))
            pieces.append((x[i], x[i] + K, y[i], y[i] + K, K))
    # words before and after, along the diagonal
    def words(at: int, other: int, n: int) -> list[tuple]:
        same = (a[at : at + n] == b[other : other + n]).astype(int).tolist()
        return [(at + k, at + k + 1, other + k, other + k + 1, same[k]) for k in range(n)]

    at, other = int(pieces[0][0]), int(pieces[0][2])
    n = min(at, other, PAD)
    head = words(at - n, other - n, n)
    at, other = int(pieces[-1][1]), int(pieces[-1][3])
    tail = words(at, other, min(len(a) - at, len(b) - other, PAD))
    pieces = head + pieces + tail
    best, low, total, start = 0.0, None, 0.0, 0
    for i, (a0, a1, b0, b1, same) in enumerate(pieces):
        if total <= 0:
            total, start = 0.0, i
        total += same - SIMILAR * max(a1 - a0, b1 - b0)
        if total > best:
            best, low = total, (start, i)
    if low is None:
        return None
    kept = pieces[low[0] : low[1] + 1]
    a0, a1, b0, b1 = int(kept[0][0]), int(kept[-1][1]), int(kept[0][2]), int(kept[-1][3])
    return (a0, a1, b0, b1, int(sum(p[4] for p in kept))) if min(a1 - a0, b1 - b0) >= LEAST else None


def align_anew(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """align() for a chain that is no passage by itself, with the other seeds that both texts have around it; the first passage of their chains that meets it."""
    (h, at), (other, place) = minimizers(a), minimizers(b)
    order = np.argsort(other, kind="stable")
    low, high = np.searchsorted(other[order], h), np.searchsorted(other[order], h, side="right")
    once = high - low == 1  # what stands several times there is met through its neighbours
    both = np.unique(np.concatenate((x.astype(np.int64) << 32 | y, at[once].astype(np.int64) << 32 | place[order[low[once]]])))
    if len(both) == len(x):
        return None
    low, high = int(x[0]), int(x[-1]) + K
    x, y = both >> 32, both & 0xFFFFFFFF
    return next((got for path in chains(x, y) if (got := align(a, b, x[path], y[path])) and got[0] < high and got[1] > low), None)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, source_id, source_start, source_end, same_words: each passage that a document shares with an earlier one."""
    docs = texts(docs).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession

    def first_holders(some: DataFrame) -> DataFrame:
        """(hash, source_id) of what several documents have."""
        return some.groupBy("hash").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("other")).where("source_id < other").select("hash", "source_id")

    first = cut(first_holders(seeds(docs)), "shared-seeds")
    only = spark.sparkContext.broadcast(id_filter(first.select("hash")))
    held_by = cut(seeds(docs, only), "seeds-and-runs")
    both_kinds = first.union(first_holders(held_by.where("width > 0")))
    met = cut(held_by.join(both_kinds, "hash"), "met")
    drop_written(held_by)
    source = met.where("doc_id = source_id").groupBy("hash").agg(F.min(F.struct("pos", "width")).alias("at"))
    source = source.select("hash", F.col("at.pos").alias("source_pos"), F.col("at.width").alias("source_width"))
    source = cut(source, "source-places")
    matches = met.where("doc_id > source_id").join(source, "hash").select("doc_id", "source_id", "pos", "source_pos", "width", "source_width")
    found = cut(chain_table(matches), "chains")
    wanted = spark.sparkContext.broadcast(id_filter(found.select(F.col("doc_id").alias("id")).union(found.select("source_id"))))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little")
        for batch in batches:
            keep = np.flatnonzero(bits[(mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(len(bits) - 1)).astype(np.int64)]) if batch.num_rows else []
            for at in range(0, len(keep), 500):
                some = batch.take(pa.array(keep[at : at + 500]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([word_hashes(t).astype(np.uint32).tobytes() for t in some.column(1).to_pylist()], pa.binary())], names=["id", "words"])

    held = cut(docs.mapInArrow(chosen, "id long, words binary").dropDuplicates(["id"]), "words")

    def around(low: str, high: str):
        return F.substring("words", F.greatest(F.col(low) - PAD, F.lit(0)) * 4 + 1, (F.col(high) + PAD) * 4 - F.greatest(F.col(low) - PAD, F.lit(0)) * 4)

    both = found.join(held, found["doc_id"] == held["id"]).select(*found.columns, around("first", "last").alias("a"))
    both = both.join(held, both["source_id"] == held["id"]).select("doc_id", "source_id", "first", "source_first", "anchors", "a", around("source_first", "source_last").alias("b"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["anchors"], np.int32).reshape(2, -1)
                left, other = max(r["first"] - PAD, 0), max(r["source_first"] - PAD, 0)
                a, b = (np.frombuffer(r[c], np.uint32) for c in "ab")
                got = align(a, b, x - left, y - other) or align_anew(a.astype(np.uint64), b.astype(np.uint64), x - left, y - other)
                if got:
                    rows.append((r["doc_id"], r["source_id"], got[0] + left, got[1] + left, got[2] + other, got[3] + other, got[4]))
            yield arrow_rows(rows, FOUND)

    result = cut(both.mapInArrow(aligned, from_arrow_schema(FOUND)).distinct(), "passages")
    for done in (first, met, source, found, held):
        drop_written(done)
    return result


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
