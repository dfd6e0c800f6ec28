"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams, most frequent first. A document's profile is compared with each language's
by out-of-place distance: the sum over the document's n-grams of how far apart their ranks are, or the profile's length for n-grams
that the language's profile lacks. The nearest language wins; of equal ones the first by name.

Letters are lower-cased, every run of other characters is one blank, and blanks take part in n-grams but are none by themselves.

Defined results: lang_pred is `und` and score 0 where a text is null or has no letter, or nothing was learned; texts of any length count
whole; score is 1 less the distance as a share of the largest possible one; repeated rows come back as often as they came; an empty
table gives an empty result; columns other than doc_id, text and (to learn) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.common import arrow_rows, table, texts

#: Longest n-gram (1 to 3: a code point takes 21 of 63 bits), profile length, and about how many rows of each language are learned from.
GRAM, TOP, LEARN_ROWS = 3, 300, 20_000
#: Characters whose n-grams are in memory at once while profiles are learned (a longer text stands alone), and rows taken at once.
HELD_CHARS, ROWS = 500_000, 256
UNKNOWN = "und"
COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


@cache
def letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, longest: int = GRAM) -> list[np.ndarray]:
    """The codes of all n-grams of a text, by length; [] if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return []
    clean = np.where(is_letter, points, 32).astype(np.int64)
    clean = np.concatenate(([32], clean, [32]))
    blank = clean == 32
    clean = clean[~(blank & np.concatenate(([False], blank[:-1])))]
    out, code = [clean[clean != 32]], clean
    for n in range(2, longest + 1):
        code = (code[:-1] << 21) | clean[n - 1 :]
        out.append(code)
    return out


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order, and how often each stands there."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def profile(text: str, top: int = TOP) -> np.ndarray:
    """The codes of a text's most frequent n-grams, most frequent first, equal ones by code."""
    found = [counted(c) for c in grams(text)]
    if not found:
        return np.empty(0, np.int64)
    codes, n = np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])
    if len(codes) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        codes, n = codes[n >= least], n[n >= least]
    return codes[np.lexsort((codes, -n))][:top]


def row_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of two columns, few of them as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def learn_profiles(docs: DataFrame, top: int = TOP, rows: int = LEARN_ROWS) -> dict[str, list[int]]:
    """Profiles by language from docs(text, lang): a sample of about `rows` rows a language, by hash of the row's content.

    Counts combine in Spark; what comes back is `top` codes a language.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")
    share = {r["lang"]: min(1.0, rows / r["n"]) for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return {}
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map([x for k, v in share.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")]

    def sent(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, codes in by.items():
            if codes:
                code, n = counted(np.concatenate(codes))
                langs = pa.array([lang]).take(pa.array(np.zeros(len(code), np.int64)))
                yield pa.RecordBatch.from_arrays([langs, pa.array(code), pa.array(n)], schema=COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        held = 0
        for lang, text in row_pairs(batches):
            by.setdefault(lang, []).extend(grams(text))
            held += len(text)
            if held >= HELD_CHARS:
                yield from sent(by)
                by, held = {}, 0
        yield from sent(by)

    total = docs.where(draw < limit).mapInArrow(run, from_arrow_schema(COUNTS)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = total.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "gram"))).alias("p"))
    return {r["lang"]: [x["gram"] for x in r["p"]] for r in best.collect()}


def language_id(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text). A map over the scan; profiles are `top` codes a language."""
    names = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sorted list of all languages' codes; for each code its rank in each language, or top.
        every = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in names])) if names else np.empty(0, np.int64)
        ranks = np.full((len(every) + 1, len(names)), top, np.int32)
        for j, k in enumerate(names):
            ranks[np.searchsorted(every, profiles[k]), j] = np.arange(len(profiles[k]))
        rows = []
        for doc_id, text in row_pairs(batches):
            own = profile(text, top)
            if not len(own) or not names:
                rows.append((doc_id, UNKNOWN, 0.0))
            else:
                at = np.searchsorted(every, own)
                at[(at == len(every)) | (every[np.minimum(at, len(every) - 1)] != own)] = len(every)
                theirs = ranks[at]
                apart = np.where(theirs == top, top, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
                best = int(apart.argmin())
                rows.append((doc_id, names[best], 1 - float(apart[best]) / (top * len(own))))
            if len(rows) == 5000:
                yield arrow_rows(rows, OUT)
                rows = []
        yield arrow_rows(rows, OUT)

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, from_arrow_schema(OUT))


def held_out(mod: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == rest, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id(docs, learn_profiles(docs.where(~held_out(3, 1))))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
