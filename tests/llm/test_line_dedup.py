"""Line dedup against brute force: equal lines, edit distances, connected groups, and the share of similar lines that blocks find."""

import itertools
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import line_dedup


def normal(line):
    return re.sub(r"\s+", " ", line.lower()).strip(" ")


def similar_pairs(pairs):
    """Of pairs of texts, whether each is similar; edit distances by another engine."""
    con = duckdb.connect()
    table = pa.table({"i": list(range(len(pairs))), "a": [a for a, _ in pairs], "b": [b for _, b in pairs]})
    con.register("t", table)
    return [r[0] for r in con.execute("select 5 * levenshtein(a, b) <= greatest(length(a), length(b)) from t order by i").fetchall()]


def linked_pairs(pairs):
    """As similar_pairs(), and by words, too."""
    return [ok and 5 * word_distance(a.split(" "), b.split(" ")) <= max(a.count(" "), b.count(" ")) + 1 for ok, (a, b) in zip(similar_pairs(pairs), pairs, strict=True)]


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def similar(a, b):
    return linked_pairs([(a, b)])[0]


def brute(docs, linked=None):
    """The text that stays of each document: of each connected group of lines the first occurrence, blank lines all."""
    lines = sorted({n for _, t in docs for x in (t or "").split("\n") if (n := normal(x))})
    up = {n: n for n in lines}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    pairs = [(a, b) for a, b in itertools.combinations(lines, 2) if 5 * abs(len(a) - len(b)) <= max(len(a), len(b))] if linked else []
    for (a, b), ok in zip(pairs, linked(pairs) if pairs else [], strict=True):
        if ok:
            up[root(a)] = root(b)
    first = {}
    for i, t in docs:
        for p, x in enumerate((t or "").split("\n")):
            if n := normal(x):
                first[root(n)] = min(first.get(root(n), (i, p)), (i, p))
    out = {}
    for i, t in docs:
        kept = [x for p, x in enumerate((t or "").split("\n")) if not normal(x) or first[root(normal(x))] == (i, p)]
        out[i] = "\n".join(kept)
    return out


def test_equal_lines(spark):
    docs = [(1, prose(1, 12) + "\nshort line\n" + prose(2, 9)), (2, "Short  line\n" + prose(2, 9).upper() + "\n" + prose(3, 8)), (3, None), (4, ""), (5, prose(1, 12)), (6, "a  b c\td e\n\na b c d e\n \n")]
    table = spark.createDataFrame([(*d, 1, "x", 7, 8) for d in docs], "doc_id long, text string, pos int, all string, n_lines int, _drop int")
    got = line_dedup.drop_lines(table)
    assert got.columns == ["doc_id", "text", "pos", "all", "_drop", "n_lines", "n_dropped"]
    assert {r["doc_id"]: r["text"] or "" for r in got.collect()} == brute(docs)
    assert {(r["pos"], r["all"], r["_drop"]) for r in got.collect()} == {(1, "x", 8)}


def test_null_and_repeated_ids(spark):
    line, other = prose(4, 10), prose(5, 11)
    docs = spark.createDataFrame([(None, line), (1, line + "\n" + other), (2, other), (2, other)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in line_dedup.drop_lines(docs).collect()))
    assert got == [(0, line, 0), (1, other, 1), (2, "", 1), (2, "", 1)]


def test_fuzzy_lines(spark):
    """Whole result against all pairs of lines by edit similarity: near copies of one, two or three words of lines of 8 to 60 words."""
    rng = random.Random(5)
    docs = []
    for k in range(60):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}w" for _ in range(rng.randint(8, 60))]
        docs.append((len(docs), " ".join(words)))
        for _ in range(2):
            changed = list(words)
            for at in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 12))):
                changed[at] = f"new{rng.randrange(1000)}"
            docs.append((len(docs), " ".join(changed)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs, linked_pairs)
    assert all(got[k] == want[k] or got[k] for k in want)  # nothing goes that brute force keeps
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)  # blocks miss few of the copies with several words changed


def test_edit_similarity(spark):
    rng = random.Random(3)
    pairs = [("", "a"), ("abcde", "abcde"), ("abcde", "abcdx"), ("abcde", "abxyx"), ("aaaa", "aaaaa"), ("aaaa", "aaaaaa"), ("zzzz5", "zzzz6")]
    for _ in range(300):
        a = [rng.choice("abc ef") for _ in range(rng.randint(1, 80))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        pairs.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.near(F.col("a"), F.col("b")).alias("ok")).collect()
    assert [r["ok"] for r in got] == similar_pairs([(r["a"], r["b"]) for r in got])
    odd = spark.createDataFrame([("äöü€5", "äöü€6", True), ("äöü€5", "äöx€6", False)], "a string, b string, want boolean")
    assert odd.where(line_dedup.near(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_very_long_lines(spark):
    """Lines far over PIECE: changes all over, few (linked) or many (not)."""
    base = [f"w{k}x{k * 7919 % 1009}" for k in range(30_000)]
    few, many = list(base), list(base)
    for k in range(5, 30_000, 97):
        few[k] = f"n{k}y{k % 7}"
    for k in range(0, 30_000, 2):
        many[k] = f"other{k}y{k % 7}"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(few)), (3, " ".join(many))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.drop_lines(docs).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_scripts_without_blanks(spark):
    text = "".join(chr(0x4E00 + k * 37 % 4000) for k in range(80))
    docs = [(1, text), (2, text[:30] + "了" + text[31:]), (3, "".join(chr(0x4E00 + k * 41 % 4000) for k in range(80)))]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("leaders", [1, 8])
def test_paths_in_buckets(spark, monkeypatch, leaders):
    """Windows that move over a text: only neighbours are similar, and each path of them is one group, whoever is compared first."""
    monkeypatch.setattr(line_dedup, "LEADERS", leaders)
    docs, want = [], {}
    for case in range(8):
        words = [f"k{case}word{i:04d}" for i in range(140)]
        for step in range(4):
            want[len(docs)] = int(step > 0)
            docs.append((len(docs), " ".join(words[6 * step : 6 * step + 100])))
    linked = {(a, b) for a, b in itertools.combinations(range(8), 2) if similar(docs[a][1], docs[b][1])}
    assert linked == {(k, k + 1) for k in (0, 1, 2, 4, 5, 6)}
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


#: Words of a line, and the share of them that is changed: at least how many of the similar pairs share a block.
RECALL = {
    (6, 1): 0.8, (8, 1): 0.9, (10, 1): 0.9, (12, 1): 0.9, (20, 1): 0.98, (20, 2): 0.8, (40, 1): 0.98, (40, 2): 0.9, (40, 4): 0.75, (80, 1): 0.98, (80, 4): 0.95, (80, 8): 0.75,
    (160, 8): 0.95, (160, 16): 0.75, (600, 30): 0.85,
}


def test_recall_by_length(spark):
    """Pairs of lines whose edit similarity is 0.8 or more by brute force, by number of words and of changed words: the share that meets in a block."""
    rng = random.Random(11)
    vocabulary = ["the", "of", "and", "to", "in", "a", "is", "that", *["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(4000)]]
    rows, groups = [], {}
    for (n, wrong), _ in RECALL.items():
        for _ in range(120):
            words = [rng.choice(vocabulary[:8]) if rng.random() < 0.35 else rng.choice(vocabulary) for _ in range(n)]
            other = list(words)
            for at in rng.sample(range(n), wrong):
                other[at] = rng.choice(vocabulary[8:])
            a, b = " ".join(words), " ".join(other)
            if a != b and (n > 200 or similar(a, b)):
                groups.setdefault((n, wrong), []).append(len(rows))
                rows += [(len(rows), a), (len(rows) + 1, b)]
    found = line_dedup.distinct_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    at = found.select("h1", "at.doc_id")
    keys = {}
    for r in line_dedup.blocks(found).join(at, "h1").collect():
        keys.setdefault(r["doc_id"], set()).add(r["key"])
    shares = {k: sum(bool(keys.get(i, set()) & keys.get(i + 1, set())) for i in v) / len(v) for k, v in groups.items()}
    short = {k: round(shares[k], 3) for k, least in RECALL.items() if shares[k] < least}
    assert not short, short
