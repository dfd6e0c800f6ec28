"""Session defaults and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; sizes stay with the cluster's own settings unless given. A local session that names no shared
    folder (spark.checkpoint.dir) gets a temporary one; on a cluster the setting is the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = builder.config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (spark.checkpoint.dir). A local session that names none gets a temporary one; a cluster without
    it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        base = _OWN[application]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what reads it several times computes it once, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
