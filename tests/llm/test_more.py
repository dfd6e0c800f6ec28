"""Operators against plain versions of their rules, and the pipeline on odd rows."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tidemark.llm import bpe, language_id, passages


def plain_grams(text):
    """n-grams of 1 to 3 characters of a text whose runs of non-letters are one blank each; blanks alone are none."""
    clean = " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or clean[-1] != " ":
            clean += c
    clean = clean if clean[-1] == " " else clean + " "
    return [g for n in (1, 2, 3) for k in range(len(clean) - n + 1) if (g := clean[k : k + n]) != " "]


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def ranked(counts, top=300):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:top]


def test_out_of_place_distances(spark):
    """Profiles, distances and the chosen language of a plain version."""
    texts = {"xx": [prose(k, 60) for k in range(4)], "yy": ["zwei drei vier fünf sechs " + prose(k, 40).replace("the", "der").replace("q", "k") for k in range(4)]}
    learn = spark.createDataFrame([(lang, t) for lang, ts in texts.items() for t in ts], "lang string, text string")
    profiles = language_id.learn_profiles(learn)
    want = {lang: ranked(collections.Counter(g for t in ts for g in plain_grams(t))) for lang, ts in texts.items()}
    assert profiles == {k: [code(g) for g in v] for k, v in want.items()}
    asked = [(1, "the fox"), (2, "zwei der"), (3, prose(9, 30)), (4, "Fünf — 123"), (5, "99"), (6, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(spark.createDataFrame(asked, "doc_id long, text string"), profiles).collect()}
    for i, t in asked:
        own = ranked(collections.Counter(plain_grams(t or "")))
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        apart = {k: sum(abs(v.index(g) - r) if g in v else 300 for r, g in enumerate(own)) for k, v in want.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(1 - apart[best] / (300 * len(own)))


def test_bpe_bounds(spark, monkeypatch):
    """Very long words, tiny tries and word tables: the same ids as the library's."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MAX_NODES", 200)
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    path = bpe.default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a" * 3000, "abcdefghij" * 400 + " x", prose(3, 400), "ÄÖü" * 500, prose(4, 300), "", prose(3, 400)]
    encoder = bpe.Encoder(bpe.loaded(path))
    for part in (texts[:3], texts[3:5], texts[5:]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)] == [t.encode(x, add_special_tokens=False).ids for x in part]


def test_alignment_on_a_diagonal():
    """The best run of words of a chain on one diagonal, against all runs."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(60, 140))
        a = rng.integers(0, 1 << 30, n).astype(np.uint32)
        b = a.copy()
        b[rng.random(n) < 0.15] += 1
        seeds = np.array([k for k in range(n - passages.K) if (a[k : k + passages.K] == b[k : k + passages.K]).all()])
        if len(seeds) < 2:
            continue
        got = passages.align(a, b, seeds, seeds)
        same = (a == b).astype(float) - passages.SIMILAR
        best = max((same[i:j].sum() for i in range(n) for j in range(i + 1, n + 1)), default=0)
        if got is None:
            continue
        i, j, x, y, words = got
        assert (i, j) == (x, y) and words == (a[i:j] == b[i:j]).sum() and same[i:j].sum() == pytest.approx(best)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, pos int, sim long")


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and extra columns go through all stages; nothing clean is lost."""
    long = " ".join(f"word{k}x{k % 71}" for k in range(30_000))
    rows = [
        (1, None, None, None, None, 0, 0), (2, "", "en", "a", 0, 0, 0), (3, "123 !!", "en", "a", 6, 0, 0), (4, prose(1, 60), "en", "a", 1, 1, 1), (4, prose(1, 60), "en", "a", 1, 1, 1),
        (None, prose(2, 70), "en", "b", 1, 0, 0), (5, long, "en", "b", 1, 0, 0), (6, prose(3, 80) + "\n" + prose(4, 20), None, "c", 1, 0, 0), (7, prose(3, 80), "en", "c", 1, 0, 0), (8, "the item of the test is here word for word and whole in this text", "en", "c", 1, 0, 0),
    ]
    tests = spark.createDataFrame([(1, "the item of the test is here word for word and whole in this text"), (2, None)], "item_id long, text string")
    for name, docs in (("some", table(spark, rows)), ("none", table(spark, []))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        tests.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns[0] == "doc_id"
        kept = sorted((r["doc_id"] or 0) for r in out.collect())
        if name == "none":
            assert kept == []
        else:
            assert {0, 5, 6} <= set(kept) and not {1, 2, 3, 7, 8} & set(kept) and 4 in kept
            assert out.where("not restored").count() == 0
