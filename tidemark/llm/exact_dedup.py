"""Exact dedup by skew-safe combining: dedup locally, merge salted digest groups, combine the salts' winners globally.

Full content is a grouping key at every stage, beside its digest, so that two contents of one digest never merge.

Defined results: a null text counts as empty; empty texts are equal to each other; of equal texts the one with the most code points
in the original text stays, then the smallest doc_id (a null doc_id comes last); rows that repeat a doc_id are each a row of their group and
come back as often as they came, one of them alone with kept set (of rows with the doc_id and length of the one that stays any, since
nothing tells them apart in the result); texts of any length count whole; an empty table gives an empty result; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, table, texts

#: Parts that a group of copies is spread over, at least; as many as the session's shuffle partitions if these are more.
SALTS = 64


def sha256_hex(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def exact_dedup(docs: DataFrame, salts: int | None = None, digest=sha256_hex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text).

    digest: any deterministic function of the content; weak ones only cost speed. Local combining is the map side of the first
    aggregate; the second works on at most `salts` rows of a content, and finds out for each digest whether it stands for one content,
    by comparing all of its contents. Where it does, rows join by their digest; where it does not, by the content itself (with SHA-256,
    of which no two contents are known to agree, by a second hash of the content). The join is on (digest, salt), so a hot group is
    spread there too.
    """
    salts = salts or max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = (
        texts(docs)
        .withColumn("norm", F.regexp_replace("text", f"{WHITE}+", ""))
        .select("doc_id", F.struct(F.length("text").alias("n"), (-F.col("doc_id")).alias("neg")).alias("rank"), F.coalesce(digest(F.col("norm")).cast("string"), F.lit("")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), F.xxhash64("norm").alias("other"), "norm")
    )
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("digest", "norm")
    same = Window.partitionBy("digest")
    won = salted.select(
        "digest", "salt", "norm",
        (-F.max("best").over(whole)["neg"]).alias("keep_id"),
        F.max("best").over(whole).alias("top"),
        F.sum("n").over(whole).alias("group_size"),
        (F.min("norm").over(same) != F.max("norm").over(same)).alias("shared"),
    )
    plain = digest is sha256_hex
    told_by = F.xxhash64("norm") if plain else F.col("norm")
    won = won.select("digest", "salt", F.col("keep_id").alias("best_id"), F.col("top")["n"].alias("best_n"), "group_size", F.when(F.col("shared"), told_by).alias("content"))
    back = rows.select("doc_id", F.col("rank.n").alias("n"), "digest", "salt", F.col("other" if plain else "norm").alias("own"))
    # rows alike in all that the result shows count together until one of them is told to stay
    back = back.repartition("digest", "salt").groupBy("digest", "salt", "doc_id", "n", "own").agg(F.count(F.lit(1)).alias("copies"))
    out = back.join(won, ["digest", "salt"]).where(F.col("content").isNull() | (F.col("content") == F.col("own")))
    best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n") == F.col("best_n"))
    sha = F.col("digest") if plain else sha256_hex(F.col("own"))
    out = out.select("doc_id", F.col("best_id").alias("keep_id"), "group_size", best.alias("best"), sha.alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
