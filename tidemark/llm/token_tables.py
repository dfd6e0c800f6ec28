"""Token ids as sorted-string-table shards.

Documents are keyed by doc_id in ascending order. A shard holds blocks of prefix-compressed keys with their ids, a sparse index (last
key and place of each block), a Bloom filter of the keys, and a footer, so that one document is found by two binary searches and one
block read. Shards roll by size. Each is written under a temporary name and renamed when whole; a manifest row names it, and only the
manifest's rows count, so a task that runs twice does no harm.

Block: entries of varint(shared key bytes), varint(other key bytes), varint(value bytes), key bytes, value; then restart offsets (u32
each, one in RESTART entries stores its whole key), their count (u32); all compressed with zlib. Key: empty for a null doc_id, else
doc_id as big-endian unsigned 64-bit with the sign bit flipped. Value: ids as little-endian u16 where the vocabulary allows, else u32.

Defined results: a null text counts as empty and holds the end id alone; a null doc_id sorts first; rows that repeat a doc_id are each
written, in order of their text; texts of any length are encoded whole; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.bpe import byte_symbols, default_path
from tidemark.llm.common import SharedFiles, arrow_rows, cut, open_shared, shared_folder, table, texts

MAGIC = b"TMSSTBL1"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, index bytes, filter at, filter bytes, documents, tokens, id bytes, magic
RESTART, BLOCK_BYTES, SHARD_BYTES = 16, 64 << 10, 32 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: The end-of-word mark of the vocabulary, and the sign that stands for it when pieces are merged.
END, MARK = "</w>", "\x01"
#: The pre-tokenizer's pattern of the files that are cut here, a fixed value of the format; files with another one go to the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lower-case text that has none of these takes the quicker form of the pre-tokenizer's pattern, equal for what is left of Latin-1.
ODD = re.compile(r"[^\t\n\r\x20-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\xff]")
LATIN = re.compile(r"[a-z\xb5\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|\d|[^\sa-z0-9\xb5\xdf-\xf6\xf8-\xff]+")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class ShardWriter:
    """Collects entries in key order; bytes() is the whole shard."""

    def __init__(self, width: int):
        self.width, self.out, self.index, self.keys, self.tokens = width, bytearray(), [], [], 0
        self._begin()

    def _begin(self) -> None:
        self.block, self.restarts, self.entries, self.before = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = _common(self.before, key)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.before, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.entries:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            packed = zlib.compress(raw, 1)
            self.index.append((self.before, len(self.out), len(packed)))
            self.out += packed
            self._begin()

    def bytes(self) -> bytes:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = 1
        bloom_raw = struct.pack("<Q", bits) + np.packbits(bloom, bitorder="little").tobytes()
        at = len(self.out)
        return bytes(self.out) + index + bloom_raw + FOOTER.pack(at, len(index), at + len(index), len(bloom_raw), len(self.keys), self.tokens, self.width, MAGIC)


class ShardReader:
    """Reads a shard through its footer: in key order, or one key by binary search. file: a seekable binary file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        at, n, bloom_at, bloom_n, self.documents, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table, or cut short")
        raw, p, self.index = self._read(at, n), 0, []
        while p < len(raw):
            k, p = _take(raw, p)
            key, p = raw[p : p + k], p + k
            place, p = _take(raw, p)
            length, p = _take(raw, p)
            self.index.append((key, place, length))
        bloom = self._read(bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        raw = zlib.decompress(self._read(*self.index[i][1:]))
        n = struct.unpack("<I", raw[-4:])[0]
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack(f"<{n}I", raw[end:-4])), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _take(raw, at)
            rest, at = _take(raw, at)
            n, at = _take(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            raw, _, end = self._block(i)
            for key, value in self._entries(raw, 0, end):
                yield id_of(key), self.ids(value)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of one document (the first of its rows), or None."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_places(key, self.bits)):
            return None
        i = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        if i == len(self.index):
            return None
        raw, restarts, end = self._block(i)

        def whole_key(at: int) -> bytes:
            return next(self._entries(raw, at, end))[0]

        j = bisect.bisect_left(restarts, key, key=whole_key)
        for k, value in self._entries(raw, restarts[max(0, j - 1)], end):
            if k >= key:
                return self.ids(value) if k == key else None
        return None


def token_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """The bytes of each token, MARK for its end-of-word mark, with its id."""
    symbol = byte_symbols()
    bare = {t: t.removesuffix(END) for t in vocab}
    return {bytes(symbol[c] for c in bare[t]) + (MARK.encode() if bare[t] != t else b""): i for t, i in vocab.items()}


class WordTokenizer:
    """Ids as the tokenizers library gives them for a vocabulary of words with an end mark.

    Normalised text is cut into pieces by the pre-tokenizer's pattern, and each piece, closed by MARK, is merged by ranks: a token's bytes with
    MARK for its end-of-word mark, ranked by id. Merging whatever makes a token, by rank, is the same as merging the listed pairs, if every token
    comes out whole of its own symbols: where two tokens stand side by side that make a third, nothing has merged across their outer
    borders, so they are the state in which that third is made from its symbols, and its last merge is the listed one. The tests check that
    condition for every token. Files of another shape, and texts that hold MARK or a special token's string, go to the library.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [t["content"] for t in spec["added_tokens"]]
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        model = spec["model"]
        self.by_piece = (
            [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
            and [p["type"] for p in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and splits[0]["pattern"] == {"Regex": PATTERN}
            and model.get("end_of_word_suffix") == END and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
        )
        if self.by_piece:
            self.pattern = regex.compile(PATTERN)
            ranks = token_ranks({t: i for t, i in model["vocab"].items() if t not in self.special})
            self.coder = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})

    def library(self, strings: list[str]) -> list[bytes]:
        return [np.array(x.ids, f"<u{self.width}").tobytes() for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, normalised; None if only the library can tell: for a special token's string, and where lower case is no longer
        composed, since the library would compose the piece again."""
        if "<|" in text and any(s in text for s in self.special):
            return None
        low = text.lower()
        if not ODD.search(low):
            return LATIN.findall(low)
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.pattern.findall(low) if unicodedata.is_normalized("NFC", low) else None

    def encode(self, batch: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self.library(batch)
        found = [None if MARK in t else self.pieces(t) for t in batch]
        whole = iter(self.library([t for t, f in zip(batch, found, strict=True) if f is None]))
        kind = f"<u{self.width}"
        return [next(whole) if f is None else self.coder.encode_to_numpy(MARK.join(f) + MARK).astype(kind).tobytes() if f else b"" for f in found]


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("documents", "tokens", "bytes", "first_id", "last_id"))])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write_token_tables(docs: DataFrame, path: str, folder: str, end_id: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode docs(doc_id, text), each with end_id after it, and write shards under folder; the manifest, one row a shard.

    One range shuffle of the texts by doc_id; encoding and writing happen in the same tasks, which hold one shard at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, files = tokenizer(path), TaskContext.get().partitionId(), SharedFiles(folder)
        end = b"" if end_id is None else np.array([end_id], f"<u{encoder.width}").tobytes()
        writer, rows, seq = ShardWriter(encoder.width), [], 0

        def commit() -> None:
            nonlocal writer, seq
            raw = writer.bytes()
            rows.append((part, seq, files.put(f"part-{part:05d}-{seq:05d}.tokens", [raw]), len(writer.keys), writer.tokens, len(raw), id_of(writer.keys[0]), id_of(writer.keys[-1])))
            writer, seq = ShardWriter(encoder.width), seq + 1

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    writer.add(key_of(doc_id), ids + end)
                    if len(writer.out) >= shard_bytes:
                        commit()
        if writer.keys:
            commit()
        yield arrow_rows(rows, MANIFEST)

    ordered = texts(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(run, from_arrow_schema(MANIFEST)), "token-manifest")


def read_token_tables(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian u32) from the shards of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_shared(shard) as file:
                    rows = []
                    for doc_id, ids in ShardReader(file):
                        rows.append((doc_id, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        if len(rows) == 500:
                            yield arrow_rows(rows, READ)
                            rows = []
                    yield arrow_rows(rows, READ)

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))  # one small row a shard
    shards = manifest.count()
    return placed.repartition(max(1, shards), "path").mapInArrow(run, from_arrow_schema(READ))


def op9_token_tables(spark: SparkSession, sf_dir: str, path: str | None = None, folder: str | None = None) -> DataFrame:
    manifest = write_token_tables(table(spark, sf_dir, "documents"), path or default_path("word_bpe_49k.json"), folder or shared_folder(spark, "token-tables"), end_id=2)
    out = read_token_tables(manifest)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
