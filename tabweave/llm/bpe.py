"""Byte-level BPE encoding and decoding with DuckDB inside Spark's tasks.

A task splits its texts by the tokenizer's pattern and encodes each distinct
piece once. Pieces that are one token need no merges. The others become rows
(word, position, token); a recursive query joins neighbours with the merge table
and contracts each word's leftmost pair of lowest rank until no pair merges.
Decoding joins the ids of whole documents with the vocabulary and concatenates
the bytes by an aggregation ordered by position.

Pieces of more than LONG_BYTES bytes need as many rounds as bytes, each over the
whole piece, so the same contraction runs on a heap for them. The query's state
holds every round, about half the square of a piece's bytes, so a query takes
pieces with at most QUERY_CELLS squared bytes in all. Decoding takes DECODE_IDS
ids at a time. Each worker keeps at most CACHE_PIECES encoded pieces and forgets
all of them when it is full.

Null and empty texts have no ids. Repeated rows get the same answer each. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG_BYTES = 512
CACHE_PIECES = 400_000
QUERY_WORDS = 50_000
QUERY_CELLS = 10_000_000
DECODE_IDS = 500_000
CHUNK_BYTES = 2 << 20

# A row is a token with the next one of its word. Contracting a pair drops its first row and turns its second into the
# merged token, so a round needs no join of neighbours.
MERGE_SQL = """
WITH RECURSIVE state AS (
  SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS u, 0 AS round FROM bytes
  UNION ALL
  SELECT
    w,
    p - (p > spot)::INT,
    CASE WHEN p = spot + 1 THEN merged ELSE t END,
    CASE WHEN p + 1 = spot THEN merged ELSE u END,
    round + 1
  FROM state JOIN (
    SELECT w, (best % 1048576)::INT AS spot, (best // 1048576)::INT AS merged
    FROM (
      SELECT x.w, min(m.r::BIGINT * 1048576 + x.p) AS best
      FROM state x JOIN merges m ON m.a = x.t AND m.b = x.u
      GROUP BY x.w
    )
  ) USING (w)
  WHERE p <> spot
)
SELECT w, p, t FROM state JOIN (SELECT w, max(round) AS round FROM state GROUP BY w) USING (w, round) ORDER BY w, p
"""

DECODE_SQL = """
SELECT d, unhex(string_agg(hex, '' ORDER BY p)) AS bytes FROM ids JOIN vocabulary USING (t) GROUP BY d
"""


def strays() -> dict[int, str]:
    """Letters and numbers of a newer Unicode than the tokenizer library knows, each with a stand-in of no class.

    The pattern's classes are those of the library, so it is asked about all
    characters that this Python doesn't know yet.
    """
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    newer = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    ranks = {bytes([i]): i for i in range(256)}
    known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return {ord(c): "\ue000" for c in newer if not known(c)}


class Tokenizer:
    """The ranks of a file, with the merge table and vocabulary in a DuckDB of this process."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = regex.compile(pattern).findall
        self.strays = strays()
        self.stray_chars = frozenset(map(chr, self.strays))
        self.byte_tokens = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.packed: dict[str, bytes] = {}
        ranks = self.ranks
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True))
        tables = {
            "merges": pa.table({"a": a, "b": b, "r": r}),
            "vocabulary": pa.table({"t": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])}),
        }
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        for name, table in tables.items():
            self.sql.register("given", table)
            self.sql.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.sql.unregister("given")

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.stray_chars.isdisjoint(text):
            return self.pieces(text)
        ends = np.cumsum([len(x) for x in self.pieces(text.translate(self.strays))]).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _rows(self, statement: str, name: str, table: pa.Table) -> pa.Table:
        self.sql.register(name, table)
        try:
            return self.sql.sql(statement).to_arrow_table()
        finally:
            self.sql.unregister(name)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by the recursive query, as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths) - lengths
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        p = (np.arange(lengths.sum()) - np.repeat(starts, lengths)).astype(np.int32)
        t = self.byte_tokens[np.frombuffer(b"".join(words), np.uint8)]
        found = self._rows(MERGE_SQL, "bytes", pa.table({"w": w, "p": p, "t": t}))
        w, t = (found.column(c).to_numpy() for c in "wt")
        ids = t.astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(w, np.arange(len(words) + 1))).tolist()
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: the same contraction on a heap of pairs."""
        n = len(word)
        piece = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                both = piece[i] + piece[after[i]]
                if (rank := self.ranks.get(both)) is not None:
                    heapq.heappush(heap, (rank, i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not piece[i] or j >= n or piece[i] + piece[j] != both:
                continue
            piece[i], piece[j] = both, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([self.ranks[x] for x in piece if x], "<u4")

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet."""
        if len(self.packed) + len(pieces) > CACHE_PIECES:
            self.packed.clear()
        todo = []
        for x in pieces - self.packed.keys():
            word = x.encode()
            whole = self.ranks.get(word)
            if whole is not None:
                self.packed[x] = whole.to_bytes(4, "little")
            elif len(word) > LONG_BYTES:
                self.packed[x] = self.merge_long(word).tobytes()
            else:
                todo.append((x, word))
        # Pieces of like length need as many rounds.
        todo.sort(key=lambda x: len(x[1]))
        cells = np.cumsum([len(word) ** 2 for _, word in todo])
        start = 0
        while start < len(todo):
            before = cells[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(cells, before + QUERY_CELLS, "right")))
            part = todo[start : min(stop, start + QUERY_WORDS)]
            start += len(part)
            self.packed.update(zip((x for x, _ in part), self.merge([w for _, w in part]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(x) for x in texts]
        self.learn(set().union(*split))
        known = self.packed.__getitem__
        return [b"".join(map(known, pieces)) for pieces in split]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids."""
        lengths = np.array([len(x) // 4 for x in packed], np.int64)
        t = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        p = np.arange(len(t), dtype=np.int32)
        d = np.repeat(np.arange(len(packed), dtype=np.int32), lengths)
        out = [b""] * len(packed)
        for start in range(0, len(t), DECODE_IDS):
            part = slice(start, start + DECODE_IDS)
            found = self._rows(DECODE_SQL, "ids", pa.table({"d": d[part], "p": p[part], "t": t[part]}))
            for i, x in zip(found.column("d").to_pylist(), found.column("bytes").to_pylist(), strict=True):
                out[i] += x
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each worker process."""
    return Tokenizer(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in tx.chunks(batches, limit=CHUNK_BYTES):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode([x or "" for x in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and text of every row of ids. Ids outside the vocabulary and null ids fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            packed = [np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()]
            texts = [x.decode("utf-8", "replace") for x in own.decode(packed)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document: number of ids, digest of the ids, and digest of the bytes that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in tx.chunks(batches, limit=CHUNK_BYTES):
            packed = own.encode([x or "" for x in batch.column("text").to_pylist()])
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(packed)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path(RANKS))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of what is left, as digests."""
    return round_trip(docs, public_tokenizers.path(RANKS))
