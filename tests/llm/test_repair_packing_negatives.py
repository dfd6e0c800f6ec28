"""Conversation repair, packing and hard negatives against brute force, on edge cases and on empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import conversation_repair as cr
from tidemark.llm import hard_negatives as hn
from tidemark.llm import packing
from tidemark.llm.bpe import default_path
from tidemark.llm.conversation_repair import PAIRS, TERMINALS, best_of, combine, damage, repair, repair_digests, repaired_turns

PATTERN = re.compile(r"(s?(ua)+)?")


def plain_repair(word):
    """The least (cost, audit) over all edits of a word of symbols, with up to two insertions in every gap."""
    choices = []
    for s in word:
        own = [("D", "", 2)]
        if s != "d":
            more = 5 if s.isupper() else 0
            own += [("K", s.lower(), more), *(("R", r, 1 + more) for r in "ua")]
        choices.append(own)
    gap = [("", "", 0), *(("I" * len(r), r, 5 * len(r)) for r in ("u", "a", "ua", "au"))]
    best = (1 << 30, "")
    for edits in itertools.product(*choices):
        for gaps in itertools.product(gap, repeat=len(word) + 1):
            if sum(len(g[0]) for g in gaps) > 2:
                continue
            steps = [gaps[0]] + [x for e, g in zip(edits, gaps[1:], strict=True) for x in (e, g)]
            if PATTERN.fullmatch("".join(x[1] for x in steps)):
                best = min(best, (sum(x[2] for x in steps), "".join(x[0] for x in steps)))
    return best


def full_chart(word):
    """The same grammar with every split of every span."""
    cells = {(k, k + 1): TERMINALS[s] for k, s in enumerate(word)}
    for size in range(2, len(word) + 1):
        for i in range(len(word) - size + 1):
            found = [cr.join(cells[i, j], cells[j, i + size]) for j in range(i + 1, i + size)]
            cells[i, i + size] = tuple(min(x) for x in zip(*found, strict=True))
    return cells[0, len(word)]


def test_cells_against_all_edits():
    r = random.Random(4)
    assert best_of(combine([])) == (0, "") == plain_repair("")
    for _ in range(60):
        word = "".join(r.choices("suaxSUAXd", k=r.randint(1, 3)))
        assert best_of(combine([TERMINALS[s] for s in word])) == plain_repair(word), word


def test_one_split_a_span_is_enough():
    r = random.Random(5)
    known = {}
    for _ in range(60):
        word = "".join(r.choices("suauauaxSUAXd", k=r.randint(1, 14)))
        got = combine([TERMINALS[s] for s in word], list(word), known)
        whole = full_chart(word)
        assert [g for g in got if g[0] < 1 << 50] == [w for w in whole if w[0] < 1 << 50], word
    assert len(PAIRS) == 11 and known


def conversation(rows):
    """The contract's result for one conversation, by a left-to-right walk over its damaged (turn, role, text) rows."""
    out = []
    for turn, role, text in rows:
        k = zlib.crc32(f"{' ' if rows.key is None else rows.key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            role, text = "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(turn, role, text)] * (2 if k == 3 else 1)
    out.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, word, blank, duplicate, truncated = set(), "", 0, 0, 0
    for _, role, text in out:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        if not bare:
            word, blank = word + "d", blank + 1
        elif (role, text) in seen:
            word, duplicate = word + "d", duplicate + 1
        else:
            s = role[:1] if role[:1] in ("s", "u", "a") else "x"
            word, truncated = word + (s.upper() if bare[-1] not in ".!?" else s), truncated + (bare[-1] not in ".!?")
        seen.add((role, text))
    states = {"0": (0, "", []), "U": (5, "I", ["user:"]), "A": (10, "II", ["user:", "assistant:"])}
    for (_, role, text), s in zip(out, word, strict=True):
        new = {}

        def put(state, cost, audit, lines, new=new):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, lines)

        for state, (cost, audit, lines) in states.items():
            put(state, cost + 2, audit + "D", lines)
            more = 5 if s.isupper() else 0
            if s != "d":
                to, name = ("A", "assistant") if state == "U" else ("U", "user")
                put(to, cost + 1 + more, audit + "R", [*lines, f"{name}:{text}"])
                if s.lower() == to.lower() or (s.lower() == "s" and state == "0"):
                    put("S" if s.lower() == "s" else to, cost + more, audit + "K", [*lines, f"{role}:{text}"])
        for _ in range(2):
            for state in list(new):
                cost, audit, lines = new[state]
                to, name = ("A", "assistant") if state == "U" else ("U", "user")
                put(to, cost + 5, audit + "I", [*lines, f"{name}:"])
        states = new
    cost, audit, lines = min(states[s] for s in "0A" if s in states)
    turns = [t for t, _, _ in out if t is not None]
    initials = [role[:1] for _, role, _ in out]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return rows.key, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


class Rows(list):
    key = None


def check_repair(spark, rows):
    df = spark.createDataFrame([(*r, 1.0, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, part double, stats string, copies int")
    by = {}
    for c, *row in rows:
        if c not in by:
            by[c] = Rows()
            by[c].key = c
        by[c].append(tuple(row))
    got = sorted((tuple(r) for r in repair_digests(repair(damage(df))).collect()), key=repr)
    assert got == sorted((conversation(x) for x in by.values()), key=repr)
    return df


def test_conversations_on_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (2, None, None, None), (2, None, "user", "a b"), (2, 5, "tool", "x!"), (2, 5, "", "y!"),
        (3, 0, "user", "hi."), (3, 0, "user", "hi."), (3, 0, "user", "hi."), (3, 4, "assistant", " \t\n"), (None, 1, "user", "q?"), (None, 2, "assistant", "long. " * 30_000), (None, None, "user", "q?"),
        (4, 1, "assistant", "é. \r\n"), (4, 2, "system", "s."), (4, 9, "user", " "), (5, -3, "user", "same."), (5, 7, "user", "same."), (6, None, None, None),
    ]
    rows += [(7 + k % 40, k // 40, ("user", "assistant", "system", "user", "x")[k * k % 5], ("yes.", "no!", "well", "", f"t{k}.", " ")[k * 7 % 6]) for k in range(400)]
    df = check_repair(spark, rows)
    left = repaired_turns(repair(damage(df))).collect()
    assert all(PATTERN.fullmatch("".join(r["role"][0] for r in sorted((x for x in left if x["conv_id"] == c), key=lambda r: r["position"]))) for c in {r["conv_id"] for r in left})
    none = df.limit(0)
    assert repair_digests(repair(damage(none))).count() == 0 and repaired_turns(repair(damage(none))).count() == 0


def test_a_conversation_over_many_partitions(spark):
    r = random.Random(1)
    rows = [(1, k, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["same.", f"t {k}.", f"cut {k}", " "])) for k in range(1500)] + [(2, 0, "user", "x.")]
    check_repair(spark, rows + [(1, 7, "user", "again.")] * 400)


def test_all_turns_dropped(spark):
    key = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    check_repair(spark, [(key, 0, "user", "x.")])


def lists(df):
    return [tuple(r) for r in df.collect()]


def test_byte_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = default_path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.byte_encoder(path)
    r = random.Random(2)
    signs = "aeE 1'sd\n\t.!?,é日語  🙂́İß'll <|endoftext|>"
    texts = ["", "a" * 5000, " " * 900, "<|endoftext|><|endoftext|> x", *("".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(4000))]
    assert all(encode(x).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_pieces_and_packing(spark, edge_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in lists(edge_docs.select("doc_id", "text")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, 64)]
        want += [(doc_id, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(itertools.pairwise(edges))]
    pieces = packing.token_pieces(edge_docs.repartition(3), default_path("byte_bpe_50k.json"), 64)
    packed = packing.pack(pieces, 64).collect()
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(want, key=repr)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in packed], 64)
    assert packing.pack(packing.token_pieces(no_docs, default_path("byte_bpe_50k.json"))).collect() == []


def check_sequences(rows, capacity):
    sequences = {}
    for s, offset, length in sorted(rows):
        assert offset == sequences.get(s, 0)
        sequences[s] = offset + length
    assert max(sequences.values()) <= capacity and len(sequences) >= -(-sum(r[2] for r in rows) // capacity)
    return len(sequences)


def test_packing_by_length_only(spark):
    """Skewed lengths with clashing names over several partitions; and close to the least number of sequences."""
    r = np.random.default_rng(3)
    lengths = [*r.integers(1, 101, 3000).tolist(), *[34] * 2000, *[100] * 50]
    df = spark.createDataFrame([(k, n, "p", 1.0) for k, n in enumerate(lengths)], "doc long, length long, _part string, x double").repartition(5)
    out = packing.pack(df, 100).collect()
    assert sorted(x["doc"] for x in out) == list(range(len(lengths)))
    n = check_sequences([(x["sequence_id"], x["offset"], x["length"]) for x in out], 100)
    plain = sum(k for k, _ in packing.best_fit(np.bincount(lengths, minlength=101)))
    assert n <= 1.01 * plain
    even = np.bincount([20 if n == 34 else n for n in lengths], minlength=101)  # lengths that do fill sequences
    assert sum(k for k, _ in packing.plan_sequences(even)) <= 1.005 * (even * np.arange(101)).sum() / 100 + 1
    with pytest.raises(Exception, match="lengths have to be"):
        packing.pack(df.withColumn("length", df["length"] + 100), 100).count()


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plans_hold_every_piece():
    r = np.random.default_rng(6)
    for k in range(12):
        capacity = int(r.integers(8, 60))
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = r.integers(0, 30, capacity) * (r.random(capacity) < 0.5) * (1 + 1000 * (k % 3 == 0))
        for kinds in (packing.plan_sequences(counts), packing.best_fit(counts)):
            held = np.zeros(capacity + 1, np.int64)
            for times, runs in kinds:
                assert times > 0 and sum(n * c for n, c in runs) <= capacity
                for n, c in runs:
                    held[n] += times * c
            assert (held == counts).all()
        if k % 3:
            assert sum(t for t, _ in packing.best_fit(counts)) == one_by_one(np.repeat(np.arange(capacity + 1), counts), capacity)
    assert packing.plan_sequences(np.zeros(9, np.int64)) == []


def test_patterns_and_their_fit():
    lengths = np.array([1, 2, 3, 5, 8, 10])
    found = {tuple(x) for x in packing.exact_patterns(lengths, 10).tolist()}
    want = {tuple([0] * (3 - n) + list(c)) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(lengths.tolist(), n) if sum(c) == 10}
    assert found == want
    patterns = packing.exact_patterns(np.array([4, 6, 2, 8]), 10)
    counts = np.zeros(11)
    counts[[4, 6, 2, 8]] = [40, 20, 15, 5]  # 20 times 4+6, 5 times 2+8, 10 times 2+4+4
    used, x = packing.fit_patterns(patterns, counts)
    fit = np.zeros(11)
    np.add.at(fit, patterns[used].ravel(), np.repeat(x, 3))
    assert np.allclose(fit[1:], counts[1:], atol=0.05)


def test_residue_scores_are_exact():
    r = np.random.default_rng(8)
    for top, dims in ((3, 1), (300, 64), (1 << 15, 200), (1 << 21, 130)):
        a, b = r.integers(-top, top + 1, (7, dims)), r.integers(-top, top + 1, (9, dims))
        bound = int(max((a * a).sum(1).max(), (b * b).sum(1).max()))
        primes = hn.primes_for(bound)
        assert (hn.scores(hn.residues(a, primes), hn.residues(b, primes), primes) == a @ b.T).all()
    assert all(hn.DIMS * (p // 2) ** 2 < 1 << 24 for p in hn.primes_for(1 << 50))


def plain_negatives(rows, positives, negatives):
    clean = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (label, [int(np.floor(256 * x)) for x in v])
        clean[i] = min(row, clean.get(i, row))
    out = []
    for a, (label, v) in clean.items():
        if a % 100:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, own) for i, (own, w) in clean.items() if i != a)
        for s, p, own in [x for x in ranked if x[2] == label][:positives]:
            fits = [x for x in ranked if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block", [hn.ROWS, 7])
def test_hard_negatives(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    rows = [(100 * k if k < 12 else 1000 + 7 * k, int(r.integers(0, 3)), r.integers(-1, 3, 6).astype(float).tolist(), 1.0, "x") for k in range(300)]
    hot = [0.5, 0.25, 1.0, 0.0, 0.5, -0.25]
    rows += [(20_000 + k, k % 2, hot, 1.0, "x") for k in range(300)] + [(20_100, 0, hot, 1.0, "x")] * 50
    rows += [(1, None, hot, 0.0, ""), (2, 1, None, 0.0, ""), (3, 1, [1.0, None], 0.0, ""), (4, 1, [float("nan")], 0.0, ""), (5, 1, [float("inf")], 0.0, ""), (None, 1, hot, 0.0, ""), (7700, 9, hot, 0.0, ""), (8, 1, [], 0.0, ""), (9, 0, [1.0, 1.0], 0.0, ""), (-100, 0, hot, 0.0, ""), (20_101, 0, [9.0] * 6, 0.0, "")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score double, place string").repartition(5)
    monkeypatch.setattr(hn, "ROWS", block)
    got = hn.hard_negatives(hn.integer_rows(df), F.col("vec_id") % 100 == 0)
    want = plain_negatives(rows, 5, 10)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 100
    if block == 7:
        assert hn.hard_negatives(hn.integer_rows(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0
        assert hn.hard_negatives(hn.integer_rows(df.where("vec_id = 7700")), F.col("vec_id") % 100 == 0).count() == 0
        with pytest.raises(ArithmeticError):
            hn.hard_negatives(hn.integer_rows(df.withColumn("embedding", F.array(F.lit(1e7)))), F.col("vec_id") % 100 == 0)


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    from tidemark.llm import token_tables

    path = default_path("word_bpe_49k.json")
    t, encoder = Tokenizer.from_file(path), token_tables.WordTokenizer(path)
    assert encoder.by_piece
    r = random.Random(11)
    signs = "aeIİiS'sd\n\t\x01.!?,éΣσ日語\u0327\u0307\u0301 ßǅ'll 12½<|endoftext|>"
    texts = ["\u0130\u0327", "I\u0327\u0307", "", *("".join(r.choices(signs, k=r.randint(1, 40))) for _ in range(6000))]
    got = encoder.encode(texts)
    assert [np.frombuffer(x, f"<u{encoder.width}").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def merged(symbols, rank):
    """The symbols after all listed merges, lowest rank first."""
    while True:
        pairs = [(rank.get(p, 1 << 60), k) for k, p in enumerate(itertools.pairwise(symbols))]
        best = min(pairs, default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return symbols
        k = best[1]
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_token_comes_out_whole(name):
    """The condition under which merging by rank is merging by the listed pairs, and ids follow the order of merges."""
    import json

    with open(default_path(name), encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {p: k for k, p in enumerate(pairs)}
    made = [model["vocab"][a + b] for a, b in pairs]
    assert made == sorted(made) and len(set(made)) == len(made)
    end = model.get("end_of_word_suffix") or ""
    for token in model["vocab"]:
        if token in special:
            continue
        body = token[: -len(end)] if end and token.endswith(end) and token != end else token
        symbols = [*body[:-1], body[-1] + token[len(body) :]]
        assert merged(symbols, rank) == [token], token
