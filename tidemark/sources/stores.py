"""Tables that are written in commits: insert or replace by key, next versions, logs. A commit counts when its manifest is there.

A commit writes its rows to a folder of its own, then its manifest under the next number, by a rename that fails where the number is taken (one
step on HDFS-like stores). Rows of tasks that ran twice or of writers that died are in no manifest and not read; of two writers one goes first
and the other tries again upon what is there then; a commit that names a token which has been committed does nothing. Manifests say where rows
are and in which order; of rows with equal keys the newest commit's counts. compact() keeps their number small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    """A table at a path (a URI of a folder that driver and executors share) with its keys; without keys a log, in which all rows stay."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str] = ()):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri() if "://" in self.path else self._fs.getUri())

    def manifests(self) -> list[dict]:
        """The commits in order: number, token, folders of rows (a compaction names all rows before it)."""
        folder = self._path(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
        return [json.loads(self._text(f"{self.path}/_commits/{n}")) for n in names]

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, number: int, content: dict) -> bool:
        """Whether the manifest could take this number."""
        temporary = self._path(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._context.makeQualified(temporary), self._context.makeQualified(self._path(f"{self.path}/_commits/{number:010d}.json")), none)
            return True
        except Py4JJavaError as error:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(f"{self.path}/rows/{name}")
        return name

    def commit(self, rows: DataFrame | Callable[[DataFrame], DataFrame], token: str | None = None) -> int | None:
        """The number under which rows were committed; None if the token had been. A function gets the table as it is and is asked again if
        another writer comes first."""
        while True:
            known = self.manifests()
            if token is not None and any(token in m["tokens"] for m in known):
                return None
            number = known[-1]["number"] + 1 if known else 1
            name = self._write(rows(self.read()) if callable(rows) else rows)
            while not self._claim(number, {"number": number, "tokens": [token] if token else [], "rows": [name], "whole": False}):
                if callable(rows) or token is not None:
                    break  # what it stood on has changed
                number += 1
            else:
                return number
            self._fs.delete(self._path(f"{self.path}/rows/{name}"), True)

    def _parts(self) -> list[tuple[int, str]]:
        out: list[tuple[int, str]] = []
        for m in self.manifests():
            out = ([] if m["whole"] else out) + [(m["number"], r) for r in m["rows"]]
        return out

    def history(self) -> DataFrame:
        """All committed rows with the number of their commit."""
        empty = self.spark.createDataFrame([], self.schema).withColumn("commit", F.lit(0).cast("long"))
        parts = self._parts()
        if not parts:
            return empty
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{r}" for _, r in parts])
        number = F.create_map(*[F.lit(x) for n, r in parts for x in (r, n)])[F.regexp_extract(F.input_file_name(), r"/rows/([0-9a-f]{32})/", 1)]
        return rows.withColumn("commit", number.cast("long"))

    def read(self) -> DataFrame:
        """The table: of rows with equal keys the newest commit's."""
        rows = self.history()
        if not self.keys:
            return rows.drop("commit")
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("commit"))
        return rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "commit")

    def compact(self) -> int | None:
        """Write the table as one commit that stands for all before it; None if another writer came first (nothing is lost then)."""
        known = self.manifests()
        if len(known) < 2:
            return None
        number = known[-1]["number"] + 1
        name = self._write(self.read())
        tokens = [t for m in known for t in m["tokens"]]
        return number if self._claim(number, {"number": number, "tokens": tokens, "rows": [name], "whole": True}) else None


RUNS = "model string, logged_at timestamp, dataset_hash string, parameters map<string,string>, metrics map<string,double>, features array<string>, metadata map<string,string>"


def run_log(spark: SparkSession, path: str) -> Store:
    """A log of runs: every row stays, metadata are the newest of their dataset (dataset_metadata)."""
    return Store(spark, path, RUNS)


def dataset_metadata(log: Store) -> DataFrame:
    """The newest metadata of each dataset hash; rows without a hash have none."""
    return log.history().where("dataset_hash is not null and dataset_hash not in ('', 'N/A')").groupBy("dataset_hash").agg(F.max_by("metadata", F.struct("commit", "logged_at")).alias("metadata"))


ENTRIES = "model_name string, version int, features array<string>, metrics map<string,double>, model_path string, registered_at timestamp"


def register_models(catalogue: Store, entries: DataFrame, token: str | None = None) -> int | None:
    """Add entries(model_name, features, metrics, model_path, registered_at), each under the next version of its model, in order of time."""

    def numbered(known: DataFrame) -> DataFrame:
        last = known.groupBy("model_name").agg(F.max("version").alias("last"))
        order = Window.partitionBy("model_name").orderBy("registered_at", "model_path")
        return entries.join(last, "model_name", "left").withColumn("version", F.coalesce("last", F.lit(0)) + F.row_number().over(order))

    return catalogue.commit(numbered, token)


def model_catalogue(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, ENTRIES, ("model_name", "version"))


def latest_run(scores: DataFrame) -> DataFrame:
    """The rows of the newest run, by percentile, highest first (place)."""
    newest = scores.agg(F.max("run_id").alias("run_id"))
    order = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("peer_percentile"), "symbol")
    return scores.join(F.broadcast(newest), "run_id").withColumn("place", F.row_number().over(order))  # one row


def export_results(predictions: DataFrame, metrics: DataFrame, path: str, mode: str) -> None:
    """Aligned prediction rows and flat metrics of every model of a validation mode, a folder a model; a mode that is exported again replaces its
    own folders."""
    for name, df in (("predictions", predictions), ("metrics", metrics)):
        out = df.withColumn("validation_mode", F.lit(mode))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("validation_mode", "model").parquet(f"{path}/{name}")
