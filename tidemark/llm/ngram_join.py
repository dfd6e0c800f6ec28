"""Exact Jaccard self-join of word-shingle sets, as connected components, by set relations.

1. A set's shingle hashes are its elements, in one global order (by hash). Equal sets are one node from the start.
2. Index lists: each node enters the lists of its prefix, long enough that two linked sets share at least need() list elements. Lists are
   kept apart by length: a short list (up to SHORT nodes) gives its pairs, which are counted; a long list gives none. Entries hold the
   size of their set and the position of the element in it. A list stands in order of size, and a pair is skipped if sizes or positions
   leave too few elements before and after the shared one: a linked pair is so skipped in none of its lists.
3. A pair is a candidate if its count, together with the elements of long lists it may share, reaches need(). Sets whose prefix lies in
   long lists to that extent are candidates of each other where they share a long list. No other pair can link. Candidates fall into
   clusters (components), most of them small.
4. In a cluster, sets stand in order of size, in blocks: a block of sets too small or too large is skipped by its position, single sets by
   the parity of their elements' bits. Answers come from answers: a set found linked to another takes over all that the other reaches,
   and none of these is compared with it again. A large cluster is cut into chunks, every two of which meet in a task.
5. The links found are a spanning forest of each chunk pair; components of all of them, over all chunks, are the result.

A list that fills up within one task is marked there, and only the mark and the task's own rows go on, so one shingle in a third of all
documents does not make a large list anywhere. Nothing is capped: long lists and large clusters take another way, not a smaller one.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; fewer than SIZE words make one shingle; null, empty and blank texts have
the empty set, n_shingles 0, and link with nothing; equal rows link; rows that repeat a doc_id come back as often; the component of a
document is the smallest doc_id it reaches (null only if all are null); an empty table gives an empty result; other columns are not
read. Elements are 64-bit hashes of shingles and nodes 64-bit hashes of sets; two different ones agree with probability 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import arrow_rows, cut, drop_written, mix, shingle_set, table, texts
from tidemark.llm.components import components

SIZE, SHORT, CHUNK, BLOCK = 5, 16, 4096, 64
#: Similarity as a fraction, so that the test is exact in integers.
NUM, DEN = 80, 100
#: Least list elements of a set, and their share of it.
LEAST, SHARE = 40, 0.25
FILTER_BITS = 1 << 25
#: List elements that a task holds before it sends them on.
AT_ONCE = 3_000_000

NODES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])
#: kind 0: node is in the list of element; 1: the list is long; 2: node is in a list known to be long.
ENTRIES = pa.schema([("element", pa.int64()), ("node", pa.int64()), ("kind", pa.int8()), ("n", pa.int32()), ("pos", pa.int32())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("long", pa.bool_())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def least_shared(n):
    """The least common elements of a set of n with a linked one."""
    return -(-NUM * n // DEN)


def listed(n):
    """How many of a set's n elements are index entries."""
    return np.minimum(n, np.maximum(np.maximum(LEAST, np.ceil(SHARE * n).astype(np.int64)), n - least_shared(n) + 1))


def _need(n):
    return np.maximum(1, listed(n) - (n - least_shared(n)))


#: need() may be least where the share overtakes the least length.
_TURN = np.array([int(LEAST / SHARE), int(LEAST / SHARE) + 1], np.int64)


def need(n: np.ndarray) -> np.ndarray:
    """The list elements that a set of n shares at least with any set it links with: the least over all sizes it can link with."""
    n = np.asarray(n, np.int64)
    low, high = -(-NUM * n // DEN), DEN * n // NUM
    out = np.minimum(np.minimum(_need(n), _need(low)), _need(high))
    for t in _TURN:
        out = np.where((low <= t) & (t <= high), np.minimum(out, _need(t)), out)
    return out


def node_of(elements: np.ndarray) -> int:
    """A hash of a whole set."""
    h = mix(elements.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(len(elements)))
    return int((mix(h.sum(dtype=np.uint64).reshape(1)) ^ np.uint64(len(elements))).view(np.int64)[0])


def nodes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, node (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingle_set(text, size)
                rows.append((doc_id, len(own), node_of(own) if len(own) else None))
            yield arrow_rows(rows, NODES)

    return docs.mapInArrow(run, from_arrow_schema(NODES))


def entries(docs: DataFrame, size: int) -> DataFrame:
    """Index entries; equal sets of one task enter once, and lists that are long within the task are marked."""

    def sent(elements: list[np.ndarray], owners: list[tuple[int, int]]) -> pa.RecordBatch:
        element, lens = np.concatenate(elements), np.array([len(x) for x in elements])
        node, n = (np.repeat(np.array([o[k] for o in owners], kind), lens) for k, kind in ((0, np.int64), (1, np.int32)))
        pos = (np.arange(len(element)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
        order = np.argsort(element, kind="stable")
        element, node, n, pos = element[order], node[order], n[order], pos[order]
        start = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
        count = np.diff(np.append(start, len(element)))
        long = np.repeat(count > SHORT, count)
        marks = element[start[count > SHORT]]
        none = np.zeros(len(marks), np.int64)
        kind = np.concatenate((np.where(long, 2, 0), none + 1)).astype(np.int8)
        columns = [np.concatenate((element, marks)), np.concatenate((node, none)), kind, *(np.concatenate((x, none)).astype(np.int32) for x in (n, pos))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        seen: set[int] = set()
        total = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, size)
                if not len(own) or (node := node_of(own)) in seen:
                    continue
                seen.add(node)
                held.append(own[: int(listed(np.int64(len(own))))])
                owners.append((node, len(own)))
                total += len(held[-1])
                if total >= AT_ONCE:
                    yield sent(held, owners)
                    held, owners, seen, total = [], [], set(), 0
        if held:
            yield sent(held, owners)

    return docs.mapInArrow(run, from_arrow_schema(ENTRIES))


def list_relations(index: DataFrame) -> DataFrame:
    """The pairs of short lists, and (node, element) of long ones as (a, b, long).

    The entries of a list meet in one task, sorted; those already known to be in a long list only pass through, wherever.
    """
    place = F.when(F.col("kind") == 2, F.col("node")).otherwise(F.col("element"))
    index = index.repartition(place).sortWithinPartitions("element", "n", "node", "kind")

    def done(element: np.ndarray, node: np.ndarray, kind: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        through = kind == 2
        passed = element[through], node[through]
        element, node, kind, n, pos = (x[~through] for x in (element, node, kind, n, pos))
        if not len(element):
            return pa.RecordBatch.from_arrays([pa.array(passed[1]), pa.array(passed[0]), pa.array(np.ones(len(passed[0]), bool))], schema=PAIRS)
        keep = np.concatenate(([True], (element[1:] != element[:-1]) | (node[1:] != node[:-1]) | (kind[1:] != kind[:-1])))
        element, node, kind, n, pos = (x[keep] for x in (element, node, kind, n, pos))
        start = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
        count = np.diff(np.append(start, len(element)))
        marked = np.add.reduceat(kind == 1, start) > 0
        long = marked | (count > SHORT)
        is_long = np.repeat(long, count) & (kind == 0)
        out_a, out_b = [passed[1], node[is_long]], [passed[0], element[is_long]]
        out_long = [np.ones(len(out_a[0]) + len(out_a[1]), bool)]
        for k in range(2, SHORT + 1):
            at = start[(count == k) & ~long]
            if len(at):
                rows = at[:, None] + np.arange(k)
                i, j = np.triu_indices(k, 1)
                x, y = rows[:, i].ravel(), rows[:, j].ravel()  # sizes ascend
                x, y = (v[DEN * n[x] >= NUM * n[y].astype(np.int64)] for v in (x, y))
                most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
                x, y = (v[(NUM + DEN) * most.astype(np.int64) >= NUM * (n[x].astype(np.int64) + n[y])] for v in (x, y))
                out_a.append(np.minimum(node[x], node[y]))
                out_b.append(np.maximum(node[x], node[y]))
                out_long.append(np.zeros(len(out_a[-1]), bool))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_long)], schema=PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(5)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
            if not len(part[0]):
                continue
            # the last list may go on in the next batch
            cut_at = int(np.searchsorted(part[0], part[0][-1]))
            rest = [x[cut_at:] for x in part]
            if cut_at:
                yield done(*[x[:cut_at] for x in part])
        if rest is not None and len(rest[0]):
            yield done(*rest)

    return index.mapInArrow(run, from_arrow_schema(PAIRS))


class Cluster:
    """Sets of one task, joined with each other or side against side."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        rows = sorted({(len(x) // 8, node, side, x) for node, side, x in rows})
        self.node = [r[1] for r in rows]
        self.side = np.array([r[2] for r in rows])
        self.n = np.array([r[0] for r in rows], np.int64)
        self.sets = [np.frombuffer(r[3], np.int64) for r in rows]
        bits = np.stack([np.bincount(s & 1023, minlength=1024) & 1 for s in self.sets]).astype(np.uint8)
        self.bits = np.packbits(bits, axis=1).view(np.uint64)

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links."""
        n, label, out = self.n, np.arange(len(self.n)), []
        ends = n[np.minimum(np.arange(BLOCK - 1, len(n) + BLOCK - 1, BLOCK), len(n) - 1)]  # largest size of each block
        apart = len(set(self.side.tolist())) > 1
        for i in range(1, len(n)):
            low = least_shared(n[i])
            first = int(np.searchsorted(ends, low)) * BLOCK  # whole blocks of smaller sets are skipped
            if first >= i:
                continue
            least = -(-NUM * (n[first:i] + n[i]) // (NUM + DEN))
            open_ = (n[first:i] >= low) & (label[first:i] != label[i])
            if apart:
                open_ &= self.side[first:i] != self.side[i]
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            differ = np.bitwise_count(self.bits[first + at] ^ self.bits[i]).sum(1, dtype=np.int64)
            ok = differ <= n[first + at] + n[i] - 2 * least[at]
            at, differ = at[ok], differ[ok]
            at = at[np.argsort(differ, kind="stable")] + first
            while len(at):
                j = int(at[0])
                shared = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                at = at[1:]
                if DEN * shared >= NUM * (n[i] + n[j] - shared):
                    out.append((self.node[i], self.node[j]))
                    label[label == label[j]] = label[i]
                    at = at[label[at] != label[i]]  # the other's answers are this set's answers
        return out


def cluster_links(members: DataFrame) -> DataFrame:
    """Links of members(task, side, node, elements), grouped by task; one task's members are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            for task, side, node, elements in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if task != now:
                    if len(rows) > 1:
                        out += Cluster(rows).links()
                    now, rows = task, []
                rows.append((node, side, elements))
            yield arrow_rows(out, LINKS)
            out = []
        if len(rows) > 1:
            out += Cluster(rows).links()
        yield arrow_rows(out, LINKS)

    return members.repartition("task").sortWithinPartitions("task").mapInArrow(run, from_arrow_schema(LINKS))


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bit set of hashed ids(id), of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            held[(mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(row["bits"], np.uint8)
    return whole.tobytes()


def chosen_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, set_node, elements of about the documents in ids(id): those whose bit is set, others by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        for batch in batches:
            if not batch.num_rows:
                continue
            ids_ = batch.column(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(bits[(mix(ids_.astype(np.int64).view(np.uint64)) & np.uint64(len(bits) - 1)).astype(np.int64)])
            for at in range(0, len(keep), 500):
                some = batch.take(pa.array(keep[at : at + 500]))
                sets = [shingle_set(t, size) for t in some.column(1).to_pylist()]
                made = [pa.array([node_of(x) if len(x) else None for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), *made], names=["doc_id", "set_node", "elements"])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, set_node long, elements binary")


def similar_components(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    docs = texts(docs).select(F.col("doc_id").cast("long"), "text")
    known = cut(nodes(docs, size), "nodes")
    # one document stands for each node; rows without an id stand in only through rows that have one
    stands = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    relations = cut(list_relations(entries(docs, size)), "relations")
    long = relations.where("long").select(F.col("a").alias("node"), F.col("b").alias("element"))
    sizes = stands.select("node", "n")

    def with_need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(need(n)), pa.array(_need(n))], names=["node", "n", "h", "need", "own_need"])

    in_long = long.groupBy("node").agg(F.count(F.lit(1)).alias("h"))
    facts = cut(sizes.join(in_long, "node", "left").select("node", "n", F.coalesce("h", F.lit(0)).alias("h")).mapInArrow(with_need, "node long, n long, h long, need long, own_need long"), "facts")
    pairs = relations.where("not long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    fa = facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"), F.col("own_need").alias("needa"))
    fb = facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"), F.col("own_need").alias("needb"))
    pairs = pairs.join(fa, "a").join(fb, "b").where((F.col("c") + F.least("ha", "hb") >= F.least("needa", "needb")) & (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM))
    dense = facts.where("h >= need").select("node")
    # elements are hashes over the same range as nodes: they take part as nodes of their own kind
    far = long.join(dense, "node").select(F.col("node").alias("a"), F.xxhash64(F.col("element"), F.lit("list")).alias("b"))
    clusters = components(pairs.select("a", "b").union(far)).withColumnRenamed("component", "cluster")
    inside = clusters.join(stands, "node").select("node", "cluster", "rep")
    count = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    inside = cut(inside.join(count, "cluster").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int")), "clusters")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    sets = chosen_sets(docs, inside.select(F.col("rep").alias("id")), size).dropDuplicates(["doc_id", "set_node"])  # rows may repeat a doc_id
    members = inside.where("rep is not null").join(sets, (F.col("rep") == F.col("doc_id")) & (F.col("node") == F.col("set_node"))).select("cluster", "node", "chunks", own.alias("side"), "elements")
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select(F.xxhash64("cluster", F.least("side", "other"), F.greatest("side", "other")).alias("task"), "side", "node", "elements")
    links = cut(cluster_links(members), "links")
    joined = components(links)
    # the component's smallest doc_id
    named = stands.join(joined, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    named = cut(named, "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    result = known.join(named.join(smallest, "component").select("node", "component_id"), "node", "left")
    for done in (relations, facts, inside, links):
        drop_written(done)
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, y AS other FROM both_ways UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.other = both_ways.x
)
SELECT documents.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(documents.doc_id, coalesce(min(reach.other), documents.doc_id)) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN reach ON reach.doc_id = documents.doc_id GROUP BY documents.doc_id
"""
