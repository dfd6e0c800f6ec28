"""No link between lines is lost: candidates and whole results of line dedup against all pairs by brute force."""

import random

from pyspark.sql import functions as F

from tests.llm.test_line_dedup import brute, similar_pairs, word_distance
from tidemark.llm import line_dedup


def spaced(line):
    return len(line.encode()) <= 16 * (line.count(" ") + 1)


def near(a, b):
    return 5 * word_distance(a, b) <= max(len(a), len(b))


def linked(pairs):
    """In characters and, unless neither line has blanks, in words. The other engine counts bytes, so it takes ASCII only."""
    plain = all(a.isascii() and b.isascii() for a, b in pairs)
    chars = similar_pairs(pairs) if plain else [near(a, b) for a, b in pairs]
    return [x and (not (spaced(a) or spaced(b)) or near(a.split(" "), b.split(" "))) for x, (a, b) in zip(chars, pairs, strict=True)]


def edited(rng, words, wrong, kinds, new):
    out = list(words)
    for _ in range(wrong):
        at, kind = rng.randrange(len(out)), rng.choice(kinds)
        if kind == "insert":
            out.insert(at, new())
        elif kind == "delete" and len(out) > 1:
            del out[at]
        else:
            out[at] = new()
    return out


def check(spark, lines):
    docs = list(enumerate(lines))
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs, linked)
    assert [k for k in want if got[k] != want[k]] == []
    return sum(x != w for x, w in zip(lines, want.values(), strict=True))


def test_every_number_of_changes(spark):
    """Lines of 4 to 90 words with as many words changed, added and removed as the rule allows; short words, too."""
    rng = random.Random(41)
    lines = []
    for n in [*range(4, 31), 40, 45, 60, 90]:
        for kinds in (["change"], ["insert"], ["delete"], ["change", "insert", "delete"]):
            size = rng.choice([2, 3, 7])
            word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(size, size + 1)))  # noqa: E731, B023
            words = [word() for _ in range(n)]
            lines += [" ".join(words), " ".join(edited(rng, words, max(1, n // 5), kinds, word))]
    assert check(spark, lines) > 80


def test_common_and_repeated_words(spark):
    """Few words, so that pairs of words stand in many lines and several times in one."""
    rng = random.Random(42)
    lines = []
    for _ in range(60):
        words = [rng.choice("aa bb cc ddd".split()) for _ in range(rng.randint(4, 24))]
        lines += [" ".join(words), " ".join(edited(rng, words, len(words) // 5, ["change", "insert", "delete"], lambda: rng.choice("aa bb eee".split())))]
    assert check(spark, lines) > 20


def test_characters_without_blanks(spark):
    rng = random.Random(43)
    lines = []
    for n in (6, 9, 10, 14, 25, 60):
        for kinds in (["change"], ["insert"], ["delete"]):
            sign = lambda: chr(0x4E00 + rng.randrange(3000))
            signs = [sign() for _ in range(n)]
            lines += ["".join(signs), "".join(edited(rng, signs, n // 5, kinds, sign))]
    assert check(spark, lines) >= 15


def test_words_added_to_a_long_line(spark):
    """A thousand words and ninety more all over: the distance of pieces, added, is far over the true one."""
    rng = random.Random(44)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))
    words = [word() for _ in range(1000)]
    docs = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 90, ["insert"], word)))]
    got = line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(1, 0), (2, 1)]


def test_only_lines_of_possible_pairs_are_fetched(spark, monkeypatch):
    """Lines that share words but can be no pair are told apart by bits; what is fetched does not depend on the filter's size for its result."""
    rng = random.Random(45)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    lines = ["one common start " + " ".join(word() for _ in range(9)) for _ in range(150)]
    lines += [" ".join(edited(rng, lines[k].split(" "), 2, ["change"], word)) for k in (3, 70)]
    rows, plain = {}, line_dedup.cut

    def counted(df, name="cut", **options):
        out = plain(df, name, **options)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    assert check(spark, lines) == 2
    assert max(rows["line-texts"]) < 20
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 64)
    assert check(spark, lines) == 2


def test_small_buckets_are_done_at_once(spark, monkeypatch):
    """Few lines that share a block leave no rows for the turns, whether they are linked or not; the result does not depend on what is small."""
    rng = random.Random(46)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    lines = []
    for _ in range(8):
        start = " ".join(word() for _ in range(10))
        lines += [start + " " + " ".join(word() for _ in range(3)) for _ in range(3)]
        lines += [" ".join(edited(rng, lines[-1].split(" "), 2, ["change"], word)), " ".join(edited(rng, lines[-3].split(" "), 2, ["insert"], word))]
    rows, plain = {}, line_dedup.cut

    def counted(df, name="cut", **options):
        out = plain(df, name, **options)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    dropped = check(spark, lines)
    assert dropped >= 14
    assert (rows["members"], rows["asked"]) == (0, 0)
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    assert check(spark, lines) == dropped
    assert rows["members"] > 0


def test_common_pairs_of_rare_words_come_last(spark):
    """Two words that stand nowhere but together, in all lines, are rarer than the others, but their pair is the commonest: it is no line's block."""
    rng = random.Random(47)
    lines = [" ".join([*(rng.choice(WORDS) for _ in range(20)), "near", "by", *(rng.choice(WORDS) for _ in range(20))]) for _ in range(400)]
    found = line_dedup.distinct_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert line_dedup.blocks(found).groupBy("key").count().agg({"count": "max"}).first()[0] < 100


WORDS = [f"{a}{b}{c}" for a in "kst" for b in "aeiou" for c in "mn"]


def test_script_is_never_less_than_the_distance(spark):
    """Changes and characters of the way that link tests try first, against distances by brute force, for words changed, added and left out."""
    rng = random.Random(48)
    pairs = []
    for _ in range(60):
        words = [rng.choice(WORDS[:12]) for _ in range(rng.randint(1, 14))]
        pairs.append((" ".join(words), " ".join(edited(rng, words, rng.randint(0, 5), ["change", "insert", "delete"], lambda: rng.choice(["x", *WORDS])))))
    cost = line_dedup.script(F.split("a", " "), F.split("b", " "))
    close = 0
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", cost.alias("cost"), line_dedup.linked(F.col("a"), F.col("b")).alias("ok")).collect():
        changes, chars = r["cost"] >> 40, r["cost"] & (1 << 40) - 1
        assert changes >= word_distance(r["a"].split(" "), r["b"].split(" ")) and chars >= word_distance(r["a"], r["b"])
        assert r["ok"] == linked([(r["a"], r["b"])])[0]
        close += changes == word_distance(r["a"].split(" "), r["b"].split(" "))
    assert close > 30
