"""Best-fit packing of token pieces by patterns, fitted to the histogram of lengths by non-negative least squares.

A document becomes pieces of at most `capacity` tokens: only longer ones are cut, into full pieces behind a first one that may be shorter.
Lengths are counted over all pieces. Patterns are the ways in which up to three lengths fill a sequence exactly; how often each is used is the
non-negative least-squares solution that comes nearest to the histogram (an active-set solution, long lengths weighing more, since short ones
are easily placed). Repeat counts are rounded down and held to what there is; the residual lengths are packed best fit, longest first, many
equal ones at once. All of this works on the counts of `capacity` lengths, whatever the corpus; the plan has a row for each run of equal
lengths in a kind of sequence, of which there are at most a few a length. Pieces take their places by their rank among pieces of their length:
ranks within a task are counted while it runs, what other tasks hold before them is a window over (task, length) counts.

Defined results: a null text counts as empty and gives one piece, the end id alone; texts of any length are encoded whole; rows that repeat a
doc_id are packed each; pieces of equal length are alike, so which takes which place follows the order of the input's rows; an empty table gives
an empty result; token_pieces() reads no other columns, pack() keeps all, whatever their names, but for given sequence_id and offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.bpe import ByteBpe, default_path, few_at_once
from tidemark.llm.common import cut, table, texts

#: Active-set rounds and solutions in one, patterns that may enter in one, the least gain (of the largest count) for which one enters, and the
#: part of the misfit that a round has to take away.
ROUNDS, TURNS, ENTER, GAIN, LESS = 40, 8, 64, 1e-6, 1e-4
#: How much more than a piece that is left a piece weighs that is not there.
OVER = 8
#: The weight of a length's misfit: its share of the sequence to this power, over the root of its count (so that a hot length rules nothing).
POWER = 1.0
#: More than any count of pieces of one length.
MANY = 1 << 50
PIECES = "doc_id long, piece int, start long, length long, ids binary"

_LOADED: dict[str, object] = {}


def byte_encoder(path: str):
    """text -> ids (uint32) as the tokenizers library gives them for a byte-level vocabulary file. Ranks of merges are the ids of what they
    make, which holds for files whose vocabulary is listed in the order of its merges; others are refused. Why ranks are as good as listed
    pairs: see token_tables.WordTokenizer; the tests check its condition for every token."""
    if path not in _LOADED:
        import tiktoken

        bpe = ByteBpe(path)
        made = [token for token, _ in sorted(bpe.made.items(), key=lambda x: x[1][2])]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of the merges")
        special = {t: i for t, i in bpe.special.items()}
        ranks = {b: i for b, i in bpe.ids.items() if i not in special.values()}
        _LOADED[path] = tiktoken.Encoding("byte_bpe", pat_str=PUBLISHED, mergeable_ranks=ranks, special_tokens=special)
    coder = _LOADED[path]
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


#: The pre-tokenizer's pattern as published, a fixed value of the format.
PUBLISHED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit integers) of each document's ids with end_id after them, cut into
    pieces of at most capacity; a map over the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for part in few_at_once(batches, 200):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, ids[a:b].tobytes()))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a sequence with one, two or three of the given lengths, ascending in a row of three (0: none)."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [np.array([[0, 0, capacity]])] if there[capacity] else []
    for first in [0, *lengths[lengths * 3 <= capacity].tolist()]:
        second = np.arange(max(first, 1), (capacity - first) // 2 + 1)
        second = second[there[second] & there[capacity - first - second]]
        found.append(np.stack([np.full_like(second, first), second, capacity - first - second], axis=1))
    return np.concatenate(found)


def fit_patterns(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns in use and how often each, as non-negative least squares of the counts by length (index 0 is ignored).

    Using more of a length than there is weighs OVER times as much as leaving some, since only what is left can still be placed. An active set
    in blocks: each round lets the patterns enter that gain most and share no length, solves for all in use with the weights that the misfit's
    signs ask for, takes out those that would fall below zero, and goes on until neither changes.
    """
    scale = counts[1:].max(initial=0)
    if not len(patterns) or not scale:
        return np.empty(0, np.int64), np.empty(0)
    want = counts / scale
    want[0] = 0
    plain = (np.arange(len(counts)) / (len(counts) - 1)) ** POWER / np.sqrt(np.maximum(counts, 1))

    def fitted(used: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.bincount(patterns[used].ravel(), np.repeat(x, 3), len(counts))
        out[0] = 0
        return out

    def weights(fit: np.ndarray) -> np.ndarray:
        return np.where(fit > want, OVER, 1) * plain

    # squared length of a pattern's column, in which a length that comes twice counts four times, and three times nine times
    equal = (patterns[:, :2] == patterns[:, 1:]) & (patterns[:, 1:] > 0)
    norm = (plain[patterns] ** 2).sum(1) + 2 * (equal * plain[patterns[:, 1:]] ** 2).sum(1) + 2 * equal.all(1) * plain[patterns[:, 0]] ** 2
    used, x, error = np.empty(0, np.int64), np.empty(0), np.inf
    best = (used, x)
    for _ in range(ROUNDS):
        fit = fitted(used, x)
        weight = weights(fit)
        now = float(((weight * (want - fit)) ** 2).sum())
        if now >= error * (1 - LESS):
            break
        error, best = now, (used, x)
        gain = (weight**2 * (want - fit))[patterns].sum(1) / np.sqrt(norm)
        gain[used] = 0
        taken, entering = np.zeros(len(counts), bool), []
        for k in np.argsort(-gain, kind="stable")[: ENTER * 50].tolist():
            if gain[k] <= GAIN or len(entering) == ENTER:
                break
            if not taken[patterns[k]].any():
                entering.append(k)
                taken[patterns[k]] = True
                taken[0] = False
        used = np.append(used, np.array(entering, np.int64))
        for turn in range(TURNS):
            if not len(used):
                break
            matrix = np.zeros((len(counts), len(used)))
            np.add.at(matrix, (patterns[used], np.arange(len(used))[:, None]), 1)
            matrix *= weight[:, None]
            gram = matrix.T @ matrix
            gram[np.diag_indices_from(gram)] += 1e-9
            x = np.linalg.solve(gram, matrix.T @ (weight * want))
            stays = x > 0
            used, x = used[stays], x[stays]
            before, weight = weight, weights(fitted(used, x))
            if stays.all() and (turn > TURNS // 2 or (before == weight).all()):
                break
    return best[0], best[1] * scale


def plan_sequences(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences that hold counts[L] pieces of each length L: (how many, [(length, pieces of it), ..]). counts has capacity + 1
    entries."""
    counts = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    patterns = exact_patterns(np.flatnonzero(counts[1:]) + 1, capacity) if counts.any() else np.empty((0, 3), np.int64)
    used, repeats = fit_patterns(patterns, counts.astype(float))
    kinds: list[tuple[int, list[tuple[int, int]]]] = []
    for k in np.argsort(-repeats, kind="stable"):
        runs = [(int(n), int(c)) for n, c in zip(*np.unique(patterns[used[k]][patterns[used[k]] > 0], return_counts=True), strict=True)]
        times = min([int(repeats[k] + 1e-6), *(int(counts[n]) // c for n, c in runs)])
        if times:
            kinds.append((times, runs[::-1]))
            for n, c in runs:
                counts[n] -= times * c
    return kinds + best_fit(counts)


def best_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of the lengths, longest first, each into the fullest sequence that has room; sequences alike are handled as one."""
    capacity = len(counts) - 1
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # room -> kinds
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                each = min(left, capacity // n)
                times = left // each
                open_.setdefault(capacity - each * n, []).append((times, [(n, each)]))
                left -= times * each
                continue
            times, runs = open_[room].pop()
            if not open_[room]:
                del open_[room]
            # a sequence that stays the fullest with room takes on more of this length
            each = min(left, room // n)
            taken = min(times, left // each)
            if taken < times:
                open_.setdefault(room, []).append((times - taken, runs))
            open_.setdefault(room - each * n, []).append((taken, [*runs, (n, each)]))
            left -= taken * each
    return [kind for room in sorted(open_) for kind in open_[room]]


class Places:
    """Where the pieces of a length go by rank: arrays of runs, sorted by (length, first rank)."""

    def __init__(self, kinds: list[tuple[int, list[tuple[int, int]]]]):
        rows, at, sequence = [], {}, 0
        for times, runs in kinds:
            offset = 0
            for n, each in runs:
                first = at.get(n, 0)
                at[n] = first + times * each
                rows.append((n * MANY + first, n, first, each, sequence, offset))
                offset += n * each
            sequence += times
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 6)

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of each piece."""
        run = self.rows[np.searchsorted(self.rows[:, 0], length * MANY + rank, "right") - 1]
        along = rank - run[:, 2]
        return run[:, 4] + along // run[:, 3], run[:, 5] + along % run[:, 3] * length


def with_longs(df: DataFrame, *names: str) -> StructType:
    return StructType([*df.schema.fields, *(StructField(n, LongType()) for n in names)])


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset: as few sequences of at most capacity as the plan finds, without gaps."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            length = np.asarray(batch["length"])
            if len(length) and (length.min() < 1 or length.max() > capacity):
                raise ValueError(f"lengths have to be 1 to {capacity}")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, int)
            sizes = np.diff(np.append(start, len(ordered)))
            ranks = np.empty(len(length), np.int64)
            ranks[order] = np.arange(len(ordered)) - np.repeat(start, sizes) + seen[ordered]
            seen[ordered[start]] += sizes
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(ranks)], names=[*batch.schema.names, "part", "rank"])

    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = pieces.select(F.struct(*columns).alias("own"), F.col("length").cast("long").alias("length"))
    ranked = cut(inner.mapInArrow(rank, with_longs(inner, "part", "rank")), "pieces")
    tally = ranked.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    places = Places(plan_sequences(counts))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    joined = ranked.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).select("own", "length", "rank", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places(np.asarray(batch["length"]), np.asarray(batch["rank"]) + np.asarray(batch["before"]))
                yield pa.RecordBatch.from_arrays([*batch["own"].flatten(), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return joined.mapInArrow(place, with_longs(pieces.select(*columns), "sequence_id", "offset"))


def op12_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    found = token_pieces(table(spark, sf_dir, "documents"), path or default_path("byte_bpe_50k.json"))
    return pack(found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
