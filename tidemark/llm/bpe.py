"""Byte-pair encoding by a prefix-sharing trie, and decoding.

The distinct words of a task go into a trie of bytes. A depth-first walk gives each node its last-token state: the token that ends the
encoding of the path from the root. A path's encoding is that of a shorter prefix, computed once for all words that share it, and its
last token; the right last token is the one suffix token that stands stably after the state of the prefix before it (two tokens are
stable when merging their bytes from scratch gives them back). Words are then read off the states backwards.

Defined results: a null text counts as empty and has no ids; the strings of special tokens in a text become those tokens, as the
tokenizers library does by default; texts of any length are encoded whole; repeated rows come back as often as they came; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, texts

#: The byte-level pre-tokenizer's pattern, a fixed value of the format; letters come first, being the most frequent (no other part begins
#: with them, so the order among these does not matter).
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Trie nodes that a task keeps at most before it begins a new trie; words that each of its two generations holds at most (the older one goes
#: when the younger is full); and the bytes of a word from which it is walked without entering the trie. Results do not depend on them.
MAX_NODES, MAX_WORDS, LONG_WORD = 600_000, 150_000, 256
#: Characters that are split into words at once, but for a longer text.
AT_ONCE = 400_000
NEVER = 1 << 60
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()

        def as_bytes(token: str) -> bytes:
            return bytes(symbol[c] for c in token)

        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> its two parts and the rank of their merge
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[self.ids[a], self.ids[b]] = k
            self.made.setdefault(self.ids[a + b], (self.ids[a], self.ids[b], k))
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(PATTERN)
        self.splits = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        if not any(t in text for t in self.special):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.splits.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Encoder:
    """The trie and the words of one task; both go with the task."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.ids, self.rank, self.made, self.bytes_of, self.longest = bpe, bpe.ids, bpe.rank, bpe.made, bpe.bytes_of, bpe.longest
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.special: dict[str | int, bytes] = {i: np.array([i], "<u4").tobytes() for i in bpe.special.values()}
        self.words, self.older = dict(self.special), {}
        self.plant()

    def plant(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.last: list[int] = [-1]  # of each node, the token that ends its encoding

    def stands(self, a: int, b: int) -> bool:
        """Whether token b stays as it is after token a: no merge across their border comes before the merges inside them.

        While a and b are built, the border lies between a token on the right edge of a and one on the left edge of b. The pair there
        merges if its rank is below that of the next merge on either side; of equal ranks the one further left comes first.
        """
        if (ok := self.stable.get((a, b))) is None:
            if len(self.stable) > 300_000:
                self.stable.clear()
            left, right = self.edge(a, 1), self.edge(b, 0)
            i, j, ok = len(left) - 1, len(right) - 1, True
            while True:
                inner, other = left[i][1], right[j][1]
                cross = self.rank.get((left[i][0], right[j][0]), NEVER)
                if cross < inner and cross <= other and cross != NEVER:
                    ok = False
                    break
                if inner == other == NEVER:
                    break
                if inner <= other:
                    i -= 1
                else:
                    j -= 1
            self.stable[a, b] = ok
        return ok

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge (1: right) of a token's merges, from itself to a byte, each with the rank of the merge that uses it up."""
        if (found := self.edges.get((token, side))) is None:
            found, used = [], NEVER
            at = token
            while True:
                found.append((at, used))
                if (made := self.made.get(at)) is None:
                    break
                used, at = made[2], made[side]
            self.edges[token, side] = found
        return found

    def grow(self, raw: bytes, depth: int, before: list[int]) -> int:
        """The last token of raw[: depth + 1]; before: those of its shorter prefixes, by length."""
        ids, bytes_of, end = self.ids, self.bytes_of, depth + 1
        # Where the last token of the prefix begins comes first: most often that token grows.
        grown = depth - len(bytes_of[before[depth]]) if depth else 0
        token = ids.get(raw[grown:end])
        if token is not None and (not grown or self.stands(before[grown], token)):
            return token
        stable = self.stable
        for start in range(max(0, end - self.longest), end):
            token = ids.get(raw[start:end])
            if token is not None:
                if start == 0:
                    break
                pair = (before[start], token)
                if (ok := stable.get(pair)) is None:
                    ok = self.stands(*pair)
                if ok:
                    break
        return token

    def learn(self, words: set[str]) -> None:
        """Insert new words into the trie and read off their ids. In sorted order the walk is depth first: it keeps the path of the word
        before (nodes and their last tokens) and goes on from the prefix that both share. A very long word shares next to nothing: its
        states are kept for its own walk only."""
        bytes_of = self.bytes_of
        path, states, before = [0], [-1], b""
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            if len(self.last) > MAX_NODES:
                self.plant()
                path, states, before = [0], [-1], b""
            if len(raw) >= LONG_WORD:
                own = [-1]
                for depth in range(len(raw)):
                    own.append(self.grow(raw, depth, own))
            else:
                child, last = self.child, self.last
                shared, most = 0, min(len(before), len(raw))
                while shared < most and before[shared] == raw[shared]:
                    shared += 1
                del path[shared + 1 :], states[shared + 1 :]
                node = path[-1]
                for depth in range(shared, len(raw)):
                    step = node * 256 + raw[depth]
                    following = child.get(step)
                    if following is None:
                        following = child[step] = len(last)
                        last.append(self.grow(raw, depth, states))
                    node = following
                    path.append(node)
                    states.append(last[node])
                before, own = raw, states
            at, back = len(raw), []
            while at:
                token = own[at]
                back.append(token)
                at -= len(bytes_of[token])
            back.reverse()
            self.words[word] = struct.pack(f"<{len(back)}I", *back)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > MAX_WORDS:
            self.words, self.older = dict(self.special), self.words
        cut = [self.bpe.pieces(t) for t in texts]
        known, older = self.words, self.older
        new = set()
        for w in set().union(*cut):
            if w not in known:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                else:
                    new.add(w)
        self.learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in cut]


#: Vocabularies (tables of fixed size), by path; tries belong to tasks.
_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def few_at_once(batches: Iterator[pa.RecordBatch], rows: int, chars: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each of at most so many rows and bytes of text (column 1), or of one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (i - start == rows or held + size > chars):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def bpe_round_trip(docs: DataFrame, path: str, rows_at_once: int = 200, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded text for each row of docs(doc_id, text), and, if asked, text.

    A map over the scan, without a shuffle. Each task keeps the trie of the words it has met, within fixed bounds, and drops it at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        encoder = Encoder(bpe)
        for part in few_at_once(batches, rows_at_once):
            ids = encoder.encode(part.column(1).to_pylist())
            columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, part.column(1)] if keep_text else columns, names=["doc_id", "n_tokens", "ids", "decoded", "text"][: 4 + keep_text])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{SCHEMA}, text string" if keep_text else SCHEMA)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"), path or default_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
