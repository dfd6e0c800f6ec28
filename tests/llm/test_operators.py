"""Each operator against brute force on edge cases, on empty tables, and on the smallest table."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import bpe, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, passages, quality, token_tables, warc
from tidemark.llm.common import shared_folder
from tidemark.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def tidy(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    return df.sort_values(list(df.columns), key=lambda c: c.map(repr)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    pd.testing.assert_frame_equal(tidy(QUERIES[name](spark, SF).toPandas()), tidy(c.execute(ORACLES[name]).df()), check_dtype=False)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, edge_docs, weak):
    from pyspark.sql import functions as F

    same = spark.createDataFrame([(301, "q r"), (301, "q  r"), (301, "q  r"), (301, " qr "), (302, "qr"), (None, "q r s t")], "doc_id long, text string")
    edge_docs = edge_docs.select("doc_id", "text").union(same)
    groups = collections.defaultdict(list)
    for i, t in texts_of(edge_docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0, i))
    want = []
    for norm, members in groups.items():
        keep = min(members)[-1]
        stays = members.index(min(members))
        want += [(m[-1], keep, len(members), k == stays, hashlib.sha256(norm.encode()).hexdigest()) for k, m in enumerate(members)]
    digest = {"digest": lambda c: F.pmod(F.crc32(F.encode(c, "UTF-8")), F.lit(3))} if weak else {}
    assert rows(exact_dedup.exact_dedup(edge_docs, **digest), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_bpe(edge_docs):
    from tokenizers import Tokenizer

    path = bpe.default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, text in texts_of(edge_docs):
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    got = [(i, n, bytes(x), d) for i, n, x, d in rows(bpe.bpe_round_trip(edge_docs, path), "doc_id", "n_tokens", "ids", "decoded")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_token_tables(spark, edge_docs):
    from tokenizers import Tokenizer

    path = bpe.default_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    manifest = token_tables.write_token_tables(edge_docs, path, shared_folder(spark, "t"), end_id=2, shard_bytes=2000)
    got = token_tables.read_token_tables(manifest).toPandas().sort_values("start")
    ordered = sorted(texts_of(edge_docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = [[*t.encode(x, add_special_tokens=False).ids, 2] for _, x in ordered]
    assert [None if pd.isna(i) else int(i) for i in got["doc_id"]] == [i for i, _ in ordered]
    assert got["start"].tolist() == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    assert [zlib.crc32(b) for b in got["ids"]] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert manifest.count() > 1
    times = collections.Counter(i for i, _ in ordered)
    by_id = {i: x for (i, _), x in zip(ordered, ids, strict=True) if times[i] == 1}
    for m in manifest.collect():
        with token_tables.open_shared(m["path"]) as f:
            reader = token_tables.ShardReader(f)
            for doc_id, _ in list(reader):
                found = reader.get(doc_id)
                assert found is not None and (times[doc_id] > 1 or found.tolist() == by_id[doc_id])
            assert reader.get(999_999) is None


def test_warc(spark):
    same, small = "x" * 150, "y" * 99
    data = [(5, "u", same), (3, "a b\r\nc", same), (9, None, same), (1, "u", small), (2, "u", small), (7, "u", None), (None, "u", same), (8, "u", "é" * 50), (4, "u", "é" * 50), (4, "u", "é" * 50)]
    pages = spark.createDataFrame([(*r, 0) for r in data], "page_id long, url string, html string, digest int")
    got = warc.read_warc(warc.write_warc(pages, shared_folder(spark, "w"), file_bytes=600)).collect()
    first = {same: 3, "é" * 50: 4}
    want = []
    for i, _, html in data:
        raw = (html or "").encode()
        to = first.get(html) if len(raw) >= 100 and i is not None else None
        to = None if to == i else to
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to, raw if to is None else None))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=repr) == sorted(want, key=repr)


def test_warc_files_repeat(spark):
    """The same pages in other partitions give the same files; ranges of very uneven ids are cut by bytes."""
    data = [(k if k % 3 else k << 40, f"u{k}", ("z" * (k % 700)) + str(k) * 900) for k in range(900)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    found = []
    for some in (pages.repartition(7), pages.coalesce(1)):
        manifest = warc.write_warc(some, shared_folder(spark, "w"), file_bytes=3000).collect()
        files = {}
        for r in manifest:
            with warc.open_shared(r["path"]) as f:
                files[r["path"].rsplit("/", 1)[1]] = f.read()
        found.append(files)
        ordered = sorted(manifest, key=lambda r: (r["part"], r["seq"]))
        assert all(a["last_id"] <= b["first_id"] for a, b in itertools.pairwise(ordered))
        assert max(r["part"] for r in manifest) > 1 and sum(r["records"] for r in manifest) == len(data)
    assert found[0] == found[1] and len(found[0]) > 3


def shingles(text):
    w = text.encode().lower().split()
    k = min(5, len(w))
    return frozenset(b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join(spark, edge_docs, monkeypatch):
    from tests.llm.conftest import prose

    known = edge_docs.where("doc_id is not null")
    base = prose(50, 200).split()
    family = [(1000 + k, " ".join([*base[: k * 3], f"new{k}", *base[k * 3 + 1 :]])) for k in range(40)] + [(2000 + k, prose(50, 20) + f" tail{k} " + prose(60 + k, 90)) for k in range(40)]
    docs = known.select("doc_id", "text").union(spark.createDataFrame(family, "doc_id long, text string"))
    want = brute_components(texts_of(docs))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs).collect()}
    assert got == {(i, *v) for i, v in want.items()}
    monkeypatch.setattr(ngram_join, "CHUNK", 8)  # large clusters, by chunks
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs).collect()} == got


def test_ngram_join_of_repeated_ids(spark):
    from tests.llm.conftest import prose

    a, b = prose(70, 60).split(), prose(71, 60).split()
    docs = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"]))], "doc_id long, text string")
    assert rows(ngram_join.similar_components(docs), "doc_id", "n_shingles", "component_id") == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1)]


def test_ngram_join_needs_no_more_than_is_shared():
    for n in [*range(1, 400), 1000, 5000]:
        for m in {-(-80 * n // 100), n, 100 * n // 80}:
            shared = -(-80 * (n + m) // 180)
            least = min(ngram_join.listed(np.int64(n)) - (n - shared), ngram_join.listed(np.int64(m)) - (m - shared))
            assert max(1, least) >= ngram_join.need(np.array([n]))[0]


def test_masks_find_every_window():
    """All placements of the substitutions that SIMILAR allows, for every length of item."""
    for n in range(1, decontaminate.WINDOW + 1):
        masks, most = decontaminate.masks_of(n), int(n * (1 - decontaminate.SIMILAR) + 1e-9)
        assert all(m[0] == 0 and m[-1] < n for m in masks)
        for wrong in itertools.combinations(range(n), most):
            assert any(not {s + o for o in m} & set(wrong) for m in masks for s in range(n - m[-1]))


def test_decontaminate_short_items(spark):
    """Every placement of one or two changed words in items of 1 to 12 words, against the rule itself."""
    items, docs, want = [], [], set()
    for n in range(1, 13):
        words = [f"s{n}q{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for count in range(4):
            for wrong in itertools.combinations(range(n), count):
                doc = len(docs)
                docs.append((doc, " ".join(["before", *(f"z{doc}" if k in wrong else w for k, w in enumerate(words)), "after"])))
                if n - count >= decontaminate.SIMILAR * n - 1e-9:
                    want.add((doc, n))
    hits = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in hits.collect()} == want


def test_decontaminate(spark, edge_docs):
    from tests.llm.conftest import prose

    item = prose(21, 25)
    changed = item.split()
    changed[4], changed[15] = "other", "words"
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "alpha beta gamma"), (None, "no one has this at all in any text")], "item_id long, text string")
    docs = [(1, "before it " + item.upper() + " after"), (2, prose(22, 30) + " " + " ".join(changed) + "."), (3, prose(23, 60)), (4, "x alpha, beta gamma y"), (5, None), (None, item), (6, " ".join(item.split()[:8]))]
    hits = decontaminate.overlaps(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, hash int"), tests)
    assert sorted({(r["doc_id"], r["item_id"]) for r in hits.collect()}, key=repr) == sorted([(1, 1), (2, 1), (4, 4), (None, 1)], key=repr)
    kept = decontaminate.decontaminate(spark.createDataFrame([(*d, 7, 1) for d in docs], "doc_id long, text string, _hit int, hit int"), tests)
    assert rows(kept, "doc_id", "_hit", "hit") == [(3, 7, 1), (5, 7, 1), (6, 7, 1)]
    assert decontaminate.overlaps(edge_docs, tests.where("false")).count() == 0
    assert decontaminate.overlaps(edge_docs.where("false"), tests).count() == 0


def test_passages(spark, edge_docs):
    from tests.llm.conftest import prose

    part = prose(31, 90)
    fuzzy = part.split()
    fuzzy[30], fuzzy[55] = "other", "word"
    del fuzzy[70]
    docs = [(1, prose(32, 50) + " " + part + " " + prose(33, 40)), (2, prose(34, 70) + " " + part), (3, " ".join(fuzzy) + " " + prose(35, 60)), (4, prose(36, 120)), (5, None), (6, " ".join(part.split()[:30]))]
    got = passages.passages(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, pos int")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(2, 1), (3, 1)}
    for r in got:
        start = 70 if r["doc_id"] == 2 else 0
        assert abs(r["start"] - start) <= 3 and abs(r["end"] - start - (90 if r["doc_id"] == 2 else 89)) <= 3
    edge = {(r["doc_id"], r["source_id"]) for r in passages.passages(edge_docs).collect()}
    assert {(6, 5), (8, 7), (10, 7), (9, 7)} <= edge and all(a > b for a, b in edge)


def test_chains_beat_any_other(spark):
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = np.sort(rng.choice(60, 10, False)), rng.choice(60, 10, False)
        best = max(passages.chains(x, y), key=len, default=[])
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in itertools.pairwise(best))


def test_chains_of_several_passages():
    """A long passage's end is no better predecessor than a near seed: against the best score of any predecessor in reach."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        x, y, want, at, other = [], [], [], 0, 0
        for n in [60, *rng.integers(4, 8, rng.integers(1, 3)).tolist()]:
            step = rng.integers(4, 12, n)
            want.append((len(x), len(x) + n))
            x += (at + np.cumsum(step)).tolist()
            y += (other + np.cumsum(step)).tolist()
            at, other = x[-1] + int(rng.integers(61, 300)), y[-1] + int(rng.integers(61, 300))
        x, y = np.array(x), np.array(y)
        got = passages.chains(x, y)
        assert sorted((int(p[0]), int(p[-1]) + 1) for p in got) == want
        k = rng.permutation(len(x))[:50]
        x, y = x[k], y[k] + rng.integers(-3, 4, 50)
        best = {}
        for j in np.lexsort((y, x)):
            best[j] = passages.K + max([0, *(best[i] - passages.GAP * (x[j] - x[i] + y[j] - y[i]) for i in best if 0 < x[j] - x[i] <= passages.REACH and 0 < y[j] - y[i] <= passages.REACH)])
        path = max(passages.chains(x, y), key=len, default=[])
        score = len(path) * passages.K - passages.GAP * sum(x[b] - x[a] + y[b] - y[a] for a, b in itertools.pairwise(path))
        assert len(path) == 0 or score <= max(best.values()) + 1e-9


def test_second_passage_of_a_pair(spark):
    words = lambda seed, n: " ".join(f"v{seed}x{i}" for i in range(n))
    one, two, three = words(1, 400), words(2, 60), words(3, 70)
    docs = [(1, " ".join([one, words(4, 90), two, words(5, 80), three])), (2, " ".join([one, words(6, 100), two, words(7, 75), three]))]
    got = rows(passages.passages(spark.createDataFrame(docs, "doc_id long, text string")), "start", "end", "source_start", "source_end")
    assert got == [(0, 400, 0, 400), (500, 560, 490, 550), (635, 705, 630, 700)]


def test_passage_with_parts_quoted_earlier(spark):
    """A passage's parts stand alone in earlier documents: it is still found in the first that has it whole."""
    words = lambda seed, n: [f"u{seed}x{i}" for i in range(n)]
    docs, want = [], {}
    for case in range(60):
        sizes = [(26, 26), (30, 30), (40, 40), (20, 20, 20)][case % 4]
        whole, at, base = words(case, sum(sizes)), 0, case * 10
        for k, n in enumerate(sizes):
            docs.append((base + k, " ".join([*words(1000 + base + k, 30), *whole[at : at + n], *words(3000 + base + k, 30)])))
            at += n
        docs += [(base + k, " ".join([*words(5000 + base + k, 40 + k), *whole, *words(7000 + base + k, 35)])) for k in (7, 8)]
        want[base + 8] = (base + 7, 48, 48 + len(whole), 47, 47 + len(whole), len(whole))
    got = passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["source_id"], r["start"], r["end"], r["source_start"], r["source_end"], r["same_words"]) for r in got} == want


@pytest.mark.parametrize("repeated", [False, True])
def test_changed_seam_between_parts_that_stand_earlier(spark, repeated):
    """A s B and A t B, where A and B stand alone in earlier documents, or before in the source itself."""
    words = lambda seed, n: [f"q{seed}x{i}" for i in range(n)]
    docs, want = [], {}
    for case in range(40):
        base, a, b = case * 10, words(10 * case, 30 + case % 5), words(10 * case + 1, 30 + case % 7)
        alone = [[*words(5000 + base + k, 70), *part, *words(7000 + base + k, 70)] for k, part in enumerate((a, b))]
        near = [[*words(9000 + base + k, 70), *a, *middle, *b, *words(11000 + base + k, 70)] for k, middle in enumerate((["s"], ["t"] * (1 + case % 2)))]
        texts_ = [[*alone[0], *alone[1], *near[0]], near[1]] if repeated else [*alone, *near]
        docs += [(base + k, " ".join(t)) for k, t in enumerate(texts_)]
        want[base + len(texts_) - 1] = base + len(texts_) - 2
    got = [r for r in passages.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["doc_id"] in want]
    found = {r["doc_id"]: r["source_id"] for r in got}
    assert found.items() <= want.items() and len(found) >= 39  # one has no two seeds in common near enough on both sides of the seam
    assert all(58 <= r["end"] - r["start"] <= 72 and r["same_words"] >= 57 for r in got)


def test_spans_do_not_depend_on_place():
    rng = np.random.default_rng(7)
    run = rng.integers(0, 1 << 63, 70).astype(np.uint64)
    found = []
    for n in (5, 3000):
        words = np.concatenate((rng.integers(0, 1 << 63, n).astype(np.uint64), run, rng.integers(0, 1 << 63, 40).astype(np.uint64)))
        pos = passages.minimizers(words)[1]
        found.append({(int(h), int(w)) for h, p, w in zip(*passages.spans(words, pos, np.ones(len(pos), bool)), strict=True) if n <= p and p + w + passages.K <= n + 70})
    assert {h for h, w in found[0] & found[1] if w >= passages.SPANS[1]} and any(w < passages.SPANS[1] for _, w in found[0] & found[1])


def test_language_id(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.language_id(docs, language_id.learn_profiles(docs.where("doc_id % 2 = 0"))).join(docs, "doc_id").where("doc_id % 2 = 1").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97
    edge = language_id.language_id(edge_docs, language_id.learn_profiles(docs)).toPandas()
    assert len(edge) == edge_docs.count() and edge["score"].between(0, 1).all()
    assert set(edge[edge["doc_id"].isin([1, 2, 3, 20])]["lang_pred"]) == {"und"}
    assert set(language_id.language_id(edge_docs, {}).toPandas()["lang_pred"]) == {"und"}
    assert language_id.learn_profiles(no_docs) == {}
    text = "abab ba"
    counts = collections.Counter(g for n in (1, 2, 3) for i in range(len(" abab ba ") - n + 1) if (g := " abab ba "[i : i + n]) != " ")
    assert len(language_id.profile(text)) == len(counts)


def test_quality(spark, edge_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    votes = quality.learn_votes(docs, labels.where("doc_id % 4 <> 0"))
    got = quality.quality(docs, votes).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.85
    edge = quality.quality(edge_docs, votes).toPandas()
    assert len(edge) == edge_docs.count() and edge["score"].between(0, 1).all()
    none = quality.learn_votes(no_docs, labels)
    assert set(quality.quality(edge_docs, none).toPandas()["score"]) == {0.5}
    # exact votes: the blocked product against a plain one
    x = np.stack([quality.terms(t or "") for t in docs.limit(20).toPandas()["text"]])
    like = votes.fold(x) @ votes.known.T
    for row, score in zip(like, votes.scores(x), strict=True):
        near = np.sort(row)[::-1][: votes.neighbours]
        assert abs(score - np.average(votes.labels[np.argsort(-row)[: votes.neighbours]], weights=np.maximum(near, 0))) < 1e-5


def test_empty_tables(spark, no_docs):
    path = bpe.default_path("byte_bpe_50k.json")
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert bpe.bpe_round_trip(no_docs, path).count() == 0
    assert ngram_join.similar_components(no_docs).count() == 0
    assert line_dedup.drop_lines(no_docs).count() == 0
    assert passages.passages(no_docs).count() == 0
    assert language_id.language_id(no_docs, {}).count() == 0
    assert token_tables.read_token_tables(token_tables.write_token_tables(no_docs, bpe.default_path("word_bpe_49k.json"), shared_folder(spark, "t"))).count() == 0
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), shared_folder(spark, "w"))).count() == 0


def test_pipeline(spark):
    """Stages one after another: what each keeps is decided by brute force on the stage's own input where the method allows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut(stage(spark, docs, SF), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "ngram_jaccard":
            want = brute_components(texts_of(docs))
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in want.items() if i == c}
        if name == "bpe":
            assert out.where("not restored").count() == 0 and out.count() == docs.count()
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
