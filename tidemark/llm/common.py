"""What several operators share: table access, shared folders, word positions and hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the 64-bit hashes; any odd numbers would do.
MIX_A, MIX_B, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
#: ASCII white space, as the contracts name it.
WHITE = r"[\x20\x09-\x0D]"
#: Folders of sessions that name none, by application.
_OWN: dict[str, str | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text with null as empty, and no other columns but those asked for."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared folder (spark.checkpoint.dir). Only local mode, where driver and executors share one disk, may leave
    it unset and gets a temporary folder; a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.setdefault(spark.sparkContext.applicationId, None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _OWN[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """df, written to the shared folder (with options of the Parquet writer) and read again: lineage ends there and a lost executor costs
    nothing."""
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark, name)
    df.write.options(**options).parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark remove the shuffle files of plans that are done
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame | None) -> None:
    """Remove a table of cut() that nothing will read again."""
    if df is None:
        return
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX_A
    h = h ^ (h >> np.uint64(27))
    h = h * MIX_B
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(BASE)
        np.multiply.accumulate(out, out=out)
    return out


#: Powers of BASE up to the longest word that is hashed at once; longer words wrap around.
_POW = _powers(256)


#: ASCII signs that loose_words() leaves out.
SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def loose_words(text: str) -> np.ndarray:
    """Word hashes of a text in lower case without ASCII signs; words of signs alone vanish."""
    return word_hashes(text.lower(), lower=False, drop=SIGNS)


def word_hashes(text: str, lower: bool = True, drop: bytes = b"") -> np.ndarray:
    """A 64-bit hash for each word ([^\\x20\\x09-\\x0D]+, A-Z lowered if asked) of a whole text, in order, as uint64. drop: bytes to leave out.

    bytes.split() and bytes.lower() know ASCII only, as the contracts ask; bytes of other characters are never white space.
    """
    raw = text.encode("utf-8", "surrogatepass")
    if lower:
        raw = raw.lower()
    if drop:
        raw = raw.translate(None, drop)
    words = raw.split()
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b"".join(words), np.uint8)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens) - lens
    at = np.arange(len(joined), dtype=np.int64) - np.repeat(starts, lens)
    long = at >= len(_POW)
    value = (joined.astype(np.uint64) + np.uint64(1)) * _POW[at & (len(_POW) - 1)]
    if long.any():
        value[long] = mix(value[long] + at[long].astype(np.uint64))
    return mix(np.add.reduceat(value, starts) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEP = _powers(64)[1:]


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` consecutive word hashes, in order; the whole sequence as one where it is shorter; none for no words."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * _STEP[i]
    return mix(out + np.uint64(k))


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes (int64)."""
    return np.unique(gram_hashes(word_hashes(text), size).view(np.int64))


class SharedFiles:
    """Files in a shared folder (a URI of any store that pyarrow knows), each whole or not there: written under a temporary name, then renamed."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.folder = folder
        self.fs, self.root = FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)

    def put(self, name: str, parts: list[bytes]) -> str:
        temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            for part in parts:
                out.write(part)
        self.fs.move(temporary, f"{self.root}/{name}")
        return f"{self.folder}/{name}"


def open_shared(uri: str):
    """A seekable binary file by its URI."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def arrow_rows(rows: list[tuple], schema):
    """A record batch of tuples."""
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
