"""Language model scores: interpolated modified Kneser-Ney over word pairs.

Spark counts words and word pairs; the model is a folder of sorted hash arrays
that the scoring tasks map into memory. Words are split by ranges of their hash,
pairs by the range of their first word; first words with a large part of all
tokens have their pairs spread over all shards. Every shard is one task's work
and one set of files, and the number of shards grows with the text.

1. Words: each task counts its words and sends sorted arrays to the shards.
2. Pairs: the same; a shard keeps the pairs seen once and those seen oftener.
   It also counts each second word's distinct predecessors and each first word's
   pairs seen once, twice and oftener, and sends these to the words' shards.
3. The totals of all shards give the discounts.

p(w|v) = max(c(v,w) - D(c), 0) / c(v) + g(v) * q(w), where q is the same over
distinct predecessors, interpolated with 1 / (V + 1); V + 1 counts the unknown
word. Texts start after a start mark and end with an end token. Words are compared
by 64-bit hashes.

The model folder must be a path that all workers can open. It is below
``spark.checkpoint.dir`` unless given.

Null and empty texts are the end token alone. Repeated rows count each time.
Rows without id are scored and never learned from. Without training rows every
probability is 1 / (V + 1) = 1. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents
from tabweave.llm.langid import held_out
from tabweave.session import scratch_dir

START, END = np.uint64(0x5354415254000001), np.uint64(0x454E44000000002)
SHARD_BYTES = 8 << 20
FLUSH_TOKENS = 2_000_000
#: A first word with more than 1 / (HOT * shards) of all tokens is spread.
HOT = 4
BLOB = "bucket int, kind string, a binary, b binary"


def local_path(folder: str) -> str:
    """A shared folder as a path that workers can open and map."""
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"{folder} can't be mapped into memory; give a mounted folder that all workers share")
    return path


def save(path: str, array: np.ndarray) -> None:
    """Write an array in one step, so that a repeated task changes nothing."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts.astype(np.int64)


def range_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; shards are ranges in the order of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return tx.mix(first * np.uint64(0x9E3779B97F4A7C15) ^ second)


def shard_of_pairs(first: np.ndarray, second: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    spread = np.isin(first, hot)
    return np.where(spread, range_of(tx.mix(pair_keys(first, second)), shards), range_of(first, shards))


def sequences(column) -> tuple[np.ndarray, np.ndarray]:
    """Start mark, words and end token of every text, flat; and where each text starts."""
    h, firsts = tx.words(column, tx.SPACED, lower=True)
    n = len(firsts) - 1
    starts = firsts + 2 * np.arange(n + 1)
    out = np.empty(len(h) + 2 * n, np.uint64)
    inner = np.ones(len(out), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    out[starts[:-1]], out[starts[1:] - 1], out[inner] = START, END, h
    return out, starts


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    sums = [np.add.reduceat(v[order], head) if len(head) else v[:0] for v in values]
    return (keys[head], *sums, order[head])


def blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def batches_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int32(), pa.string(), pa.binary(), pa.binary()
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "a", "b"])


def flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The sequences of many texts at a time."""
    held, size = [], 0
    for batch in tx.chunks(batches):
        tokens, _ = sequences(batch.column("text"))
        held.append(tokens)
        size += len(tokens)
        if size >= FLUSH_TOKENS:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


class Counts:
    """Counting of one training corpus into a model folder."""

    def __init__(self, docs: DataFrame, folder: str | None = None) -> None:
        self.spark = docs.sparkSession
        self.docs = docs.select("text")
        self.folder = local_path(folder or scratch_dir(self.spark, "ngrams"))
        n_bytes = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.shards = int(-(-n_bytes // SHARD_BYTES)) or 1

    def words(self) -> list[tuple]:
        shards, folder = self.shards, self.folder

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tokens in flushed(batches):
                h, n = np.unique(tokens, return_counts=True)
                cuts = np.searchsorted(range_of(h, shards), np.arange(shards + 1))
                parts = zip(cuts[:-1], cuts[1:], strict=True)
                yield batches_of([(k, "words", blob(h[a:b]), blob(n[a:b])) for k, (a, b) in enumerate(parts) if b > a])

        def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            h, n, _ = summed(*(np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("a", np.uint64), ("b", np.int64))))
            os.makedirs(folder, exist_ok=True)
            shard = key[0].as_py()
            save(f"{folder}/words-{shard}.npy", h)
            save(f"{folder}/counts-{shard}.npy", narrow(n))
            real = h != START
            limit = n[real].sum() / HOT if real.any() else 0
            # A word that is hot in the whole corpus is hot in its own shard.
            often = real & (n > limit / shards)
            row = (shard, json.dumps([int(real.sum()), int(n[real].sum())]), blob(h[often]), blob(n[often]))
            return pa.Table.from_batches([batches_of([row])])

        dealt = self.docs.mapInArrow(count, BLOB).groupBy("bucket")
        return dealt.applyInArrow(merge, BLOB).collect()

    def pairs(self, hot: np.ndarray) -> list[tuple]:
        shards, folder = self.shards, self.folder

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tokens in flushed(batches):
                h, at = np.unique(tokens, return_inverse=True)
                at = at.astype(np.uint64)
                code = (at[:-1] << np.uint64(32)) | at[1:]
                code, n = np.unique(code[tokens[1:] != START], return_counts=True)
                first, second = h[(code >> np.uint64(32)).astype(np.int64)], h[(code & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                shard = shard_of_pairs(first, second, hot, shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = []
                for k in range(shards):
                    own = order[cuts[k] : cuts[k + 1]]
                    if len(own):
                        v = first[own]
                        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                        lengths = np.diff(np.append(head, len(v)))
                        size = np.array([len(head)], np.int64)
                        rows.append((k, "pairs", blob(size, v[head], lengths), blob(second[own], n[own])))
                yield batches_of(rows)

        def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            firsts, seconds, counts = [], [], []
            for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
                size = int(np.frombuffer(a, np.int64, 1)[0])
                v, lengths = np.frombuffer(a, np.uint64, size, 8), np.frombuffer(a, np.int64, size, 8 + 8 * size)
                firsts.append(np.repeat(v, lengths))
                half = len(b) // 2
                seconds.append(np.frombuffer(b[:half], np.uint64))
                counts.append(np.frombuffer(b[half:], np.int64))
            first, second = np.concatenate(firsts), np.concatenate(seconds)
            keys, n, one = summed(pair_keys(first, second), np.concatenate(counts))
            first, second = first[one], second[one]
            shard = key[0].as_py()
            save(f"{folder}/once-{shard}.npy", keys[n == 1])
            save(f"{folder}/often-{shard}.npy", keys[n > 1])
            save(f"{folder}/times-{shard}.npy", narrow(n[n > 1]))
            rows = [(-1, json.dumps([int((n == k).sum()) for k in (1, 2, 3, 4)]), b"", b"")]
            before = summed(second, np.ones(len(second), np.int64))[:2]
            after = summed(first, *((n == k).astype(np.int64) for k in (1, 2)), (n > 2).astype(np.int64))[:4]
            for kind, (h, *values) in (("before", before), ("after", after)):
                cuts = np.searchsorted(range_of(h, shards), np.arange(shards + 1))
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        rows.append((k, kind, blob(h[a:b]), blob(*(v[a:b].astype(np.int32) for v in values))))
            return pa.Table.from_batches([batches_of(rows)])

        def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            if shard < 0:
                total = np.sum([json.loads(x) for x in table.column("kind").to_pylist()], axis=0)
                return pa.Table.from_batches([batches_of([(shard, json.dumps(total.tolist()), b"", b"")])])
            words = np.load(f"{folder}/words-{shard}.npy", mmap_mode="r")
            sums = np.zeros((4, len(words)), np.int64)
            for kind, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True):
                at = np.searchsorted(words, np.frombuffer(a, np.uint64))
                values = np.frombuffer(b, np.int32).reshape(-1, len(at))
                for row, v in zip(sums[:1] if kind == "before" else sums[1:], values, strict=True):
                    row[at] += v
            for name, row in zip(("before", "after1", "after2", "after3"), sums, strict=True):
                save(f"{folder}/{name}-{shard}.npy", narrow(row))
            before = sums[0]
            stats = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum()), int(before.sum())]
            return pa.Table.from_batches([batches_of([(shard, json.dumps(stats), b"", b"")])])

        counted = self.docs.mapInArrow(count, BLOB).groupBy("bucket").applyInArrow(merge, BLOB)
        return counted.groupBy("bucket").applyInArrow(finish, BLOB).collect()


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2 and 3 or more from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))]


def fit(docs: DataFrame, folder: str | None = None) -> str:
    """Count ``docs`` (column text) into a model folder; returns the folder."""
    own = Counts(docs, folder)
    found = own.words()
    meta = {"shards": own.shards, "tokens": 0, "types": 0, "hot": [int(START)], "pair_d": [0.0, 0.5, 0.5, 0.5], "word_d": [0.0, 0.5, 0.5, 0.5]}
    stats = np.zeros(6, np.int64)
    if found:
        sizes = np.sum([json.loads(r.kind) for r in found], axis=0)
        meta["types"], meta["tokens"] = int(sizes[0]), int(sizes[1])
        h, n = (np.concatenate([np.frombuffer(r[c], t) for r in found]) for c, t in (("a", np.uint64), ("b", np.int64)))
        meta["hot"] += h[n > meta["tokens"] / (HOT * own.shards)].tolist()
        rows = own.pairs(np.array(sorted(meta["hot"]), np.uint64))
        meta["pair_d"] = discounts(next(json.loads(r.kind) for r in rows if r.bucket < 0))
        stats = np.sum([json.loads(r.kind) for r in rows if r.bucket >= 0], axis=0)
        meta["word_d"] = discounts(stats[:4].tolist())
    d = meta["word_d"]
    meta["predecessors"] = int(stats[5])
    meta["word_rest"] = float((d[1] * stats[0] + d[2] * stats[1] + d[3] * stats[4]) / stats[5]) if stats[5] else 1.0
    os.makedirs(own.folder, exist_ok=True)
    with open(f"{own.folder}/model.json", "w") as out:
        json.dump(meta, out)
    return own.folder


class Model:
    """A model folder whose arrays are mapped into memory as they are needed."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        with open(f"{folder}/model.json") as lines:
            self.meta = json.load(lines)
        self.shards = self.meta["shards"]
        self.hot = np.array(sorted(self.meta["hot"]), np.uint64)
        self.array = functools.lru_cache(maxsize=None)(self._array)

    def _array(self, name: str, shard: int) -> np.ndarray:
        path = f"{self.folder}/{name}-{shard}.npy"
        return np.load(path, mmap_mode="r") if os.path.exists(path) else np.empty(0, np.uint64)

    def _found(self, keys: str, shard: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted hashes in a sorted array, and which of them are there."""
        array = self.array(keys, shard)
        if not len(array):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.searchsorted(array, h)
        at[at == len(array)] = 0
        return at, array[at] == h

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        """Count, distinct predecessors, and pairs seen once, twice and oftener, for sorted distinct words."""
        out = np.zeros((5, len(h)), np.int64)
        cuts = np.searchsorted(range_of(h, self.shards), np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[k], cuts[k + 1])
            at, there = self._found("words", k, h[part])
            for row, name in zip(out, ("counts", "before", "after1", "after2", "after3"), strict=True):
                if there.any():
                    row[part][there] = self.array(name, k)[at[there]]
        return out

    def pair_counts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys, shard = pair_keys(first, second), shard_of_pairs(first, second, self.hot, self.shards)
        order = np.lexsort((keys, shard))
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        out = np.zeros(len(keys), np.int64)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[k] : cuts[k + 1]]
            out[own[self._found("once", k, keys[own])[1]]] = 1
            at, there = self._found("often", k, keys[own])
            if there.any():
                out[own[there]] = self.array("times", k)[at[there]]
        return out

    def scores(self, column) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, base score and model score."""
        meta = self.meta
        tokens, starts = sequences(column)
        h, at = np.unique(tokens, return_inverse=True)
        count, before, once, twice, often = self.word_counts(h)
        d = np.array(meta["pair_d"])
        rest = (d[1] * once + d[2] * twice + d[3] * often) / np.maximum(count, 1)
        rest[count == 0] = 1.0
        d = np.array(meta["word_d"])
        word = np.maximum(before - d[np.minimum(before, 3)], 0) / max(meta["predecessors"], 1) + meta["word_rest"] / (meta["types"] + 1)
        base = np.log10((count + 0.1) / (meta["tokens"] + 0.1 * (meta["types"] + 1)))
        here = np.ones(len(tokens), bool)
        here[starts[:-1]] = False
        here = np.flatnonzero(here)
        code, where = np.unique((at[here - 1].astype(np.uint64) << np.uint64(32)) | at[here].astype(np.uint64), return_inverse=True)
        v, w = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        n = self.pair_counts(h[v], h[w])
        d = np.array(meta["pair_d"])
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(count[v], 1) + rest[v] * word[w]
        cuts = starts[:-1] - np.arange(len(starts) - 1)
        each = {"n_tokens": np.ones(len(here), np.int64), "n_known": (count[at[here]] > 0).astype(np.int64), "base_score": base[at[here]], "score": np.log10(p)[where]}
        return {name: np.add.reduceat(x, cuts) if len(cuts) else x[:0] for name, x in each.items()}


@functools.lru_cache(maxsize=2)
def opened(folder: str) -> Model:
    return Model(folder)


def score(docs: DataFrame, folder: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, tokens, known tokens, training tokens, base score, model score and perplexity of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(folder)
        for batch in tx.chunks(batches):
            found = model.scores(batch.column("text"))
            columns = {c: batch.column(c) for c in keep}
            columns |= {k: pa.array(v) for k, v in found.items()}
            columns["train_tokens"] = pa.array(np.full(batch.num_rows, model.meta["tokens"], np.int64))
            columns["perplexity"] = pa.array(10 ** (-found["score"] / found["n_tokens"]))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    kinds += ", n_tokens long, n_known long, base_score double, score double, train_tokens long, perplexity double"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, kinds)


@query("op1_kneser_ney")
def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id"), 10, 0))
    folder = fit(docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return score(docs, folder, ["doc_id", "held_out"])
