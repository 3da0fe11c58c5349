"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items form one suffix automaton over
words. Training documents stream through it: each word moves the state and the
length of the longest match that ends there. Where the match reaches a window
(``window`` words, or a whole shorter item), its words are hit.

Words are runs of ASCII letters and digits and of bytes above 0x7F, with A-Z
lower-cased. Null and empty texts have no words and no hits; items without words
match nothing; repeated items all count. Items without id match like all others;
together they are one unnamed item: null in ``items``, one in ``n_items``, and no
part of ``items_sha256``. Repeated documents get the same answer each. Other
columns pass through ``remove_spans`` untouched.

The benchmark is given to the tasks in blocks of at most ``BLOCK_WORDS`` words,
so what is broadcast is bounded; several blocks are several passes whose hits
are combined.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents, stored

WINDOW = 10
BLOCK_WORDS = 200_000
PIECE_WORDS = 10_000

#: A document with this share of hit words is dropped; below it the hit spans are cut out.
MAX_COVERAGE = 0.5

HITS = "__hits"
HITS_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


class SuffixAutomaton:
    """Generalised suffix automaton over word codes, one sequence added after another."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owners: list[set[int | None]] = [set()]
        self.whole: list[list[tuple[int | None, int]]] = [[]]
        self.shortest = window

    def _state(self, length: int, following: dict[int, int], link: int, owners: set[int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(owners)
        self.whole.append([])
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, word, known)
        state = self._state(self.length[last] + 1, {}, 0, set())
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return state

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], set())
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    @classmethod
    def of(cls, items: list[tuple[int, list[int]]], window: int = WINDOW) -> SuffixAutomaton:
        """The automaton of all items. An item shorter than a window matches only as a whole."""
        self = cls(window)
        items = [(item, sequence) for item, sequence in items if sequence]
        for _, sequence in items:
            state = 0
            for word in sequence:
                state = self._extend(state, word)
            self.shortest = min(self.shortest, len(sequence))
        # Owners are noted once the automaton is final, at the state of each window's last word.
        for item, sequence in items:
            for end, state, length in self.matches(sequence):
                if length >= window:
                    self.owners[self.at_depth(state, window)].add(item)
            if len(sequence) < window:
                self.whole[self.at_depth(state, len(sequence))].append((item, len(sequence)))
        # A state also matches the whole items at the states its suffix links lead to.
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.whole[state] = self.whole[state] + self.whole[self.link[state]]
        return self

    def at_depth(self, state: int, depth: int) -> int:
        """The state of the last ``depth`` words of a match."""
        while self.length[self.link[state]] >= depth:
            state = self.link[state]
        return state

    def matches(self, sequence) -> Iterator[tuple[int, int, int]]:
        """End, state and length of the longest match at each word."""
        state = length = 0
        following, link, longest = self.next, self.link, self.length
        for i, word in enumerate(sequence):
            while state and word not in following[state]:
                state = link[state]
                length = longest[state]
            state = following[state].get(word, 0)
            length = length + 1 if state else 0
            yield i, state, length

    def hits(self, sequence) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of windows in ``sequence`` and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        window = self.window
        for i, state, length in self.matches(sequence):
            if length >= window:
                owners = self.owners[self.at_depth(state, window)]
                if owners:
                    spans.append((i + 1 - window, i + 1))
                    items |= owners
            for item, size in self.whole[state]:
                if size <= length:
                    spans.append((i + 1 - size, i + 1))
                    items.add(item)
        return spans, items


class Matcher:
    """An automaton with the vocabulary that maps word hashes to its codes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int) -> None:
        self.vocabulary = np.unique(np.concatenate([h for _, h in items] or [np.empty(0, np.uint64)]))
        self.automaton = SuffixAutomaton.of([(i, self.codes(h).tolist()) for i, h in items], window)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Code of each word, -1 outside the vocabulary."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at, -1)

    def batch(self, h: np.ndarray, firsts: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """Merged hit spans and items of each text that has any.

        A match never spans a word outside the vocabulary, so only stretches of known
        words at least as long as the shortest window go through the automaton.
        """
        codes = self.codes(h)
        row = tx.row_of(firsts)
        known = codes >= 0
        cut = np.ones(len(codes) + 1, bool)
        if len(codes):
            cut[1:-1] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        edges = np.flatnonzero(cut)
        found: dict[int, tuple[list, set]] = {}
        lengths = np.diff(edges)
        wanted = np.flatnonzero((lengths >= self.automaton.shortest) & known[edges[:-1]]) if len(codes) else []
        for k in wanted:
            a, b = int(edges[k]), int(edges[k + 1])
            spans, items = self.automaton.hits(codes[a:b].tolist())
            if spans:
                r = int(row[a])
                at = a - int(firsts[r])
                old = found.setdefault(r, ([], set()))
                old[0].extend((s + at, e + at) for s, e in spans)
                old[1].update(items)
        return {r: (merged(s), i) for r, (s, i) in found.items()}


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def in_order(items) -> list[int | None]:
    """Item ids in ascending order, the unnamed item last."""
    return sorted(items, key=lambda x: (x is None, x or 0))


def _item_pieces(window: int):
    """Items as pieces of at most PIECE_WORDS words that overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            h, firsts = tx.words(batch.column("text"), tx.ALNUM, lower=True)
            ids, pieces = [], []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                own = h[firsts[i] : firsts[i + 1]]
                for at in range(0, max(len(own) - window + 1, min(len(own), 1)), PIECE_WORDS):
                    ids.append(item)
                    pieces.append(own[at : at + PIECE_WORDS + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.binary())], ["item_id", "words"])

    return run


def matcher_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Matcher]:
    """Automata over parts of the benchmark, each of at most about ``block_words`` words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    pieces = stored(items.mapInArrow(_item_pieces(window), "item_id long, words binary"), "benchmark")
    total = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    n = max(1, math.ceil(total / 8 / (block_words * 0.8)))
    for block in range(n):
        rows = pieces.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == block).collect()
        yield Matcher([(r.item_id, np.frombuffer(r.words, np.uint64)) for r in rows], window)


def _hits_column(found: dict, n_words: np.ndarray) -> pa.Array:
    rows = []
    for i, n in enumerate(n_words.tolist()):
        spans, items = found.get(i, ((), ()))
        n_hit = sum(b - a for a, b in spans)
        rows.append({"n_words": n, "n_hit": n_hit, "spans": [list(x) for x in spans], "items": in_order(items)})
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.int64()))]
    )
    return pa.array(rows, kind)


def _mark(matcher, keep: list[str], text: str):
    """Adds the hits of each row; passes the columns in ``keep`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, text):
            h, firsts = tx.words(batch.column(text), tx.ALNUM, lower=True)
            hits = _hits_column(matcher.value.batch(h, firsts), np.diff(firsts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), hits], [*keep, HITS])

    return run


def _only_found(matcher):
    """The hits of one block for the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, "__text"):
            h, firsts = tx.words(batch.column("__text"), tx.ALNUM, lower=True)
            found = matcher.value.batch(h, firsts)
            at = sorted(found)
            spans = pa.array([[list(s) for s in found[i][0]] for i in at], pa.list_(pa.list_(pa.int32())))
            items = pa.array([in_order(found[i][1]) for i in at], pa.list_(pa.int64()))
            key = batch.column("__key").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, spans, items], ["__key", "__spans", "__items"])

    return run


def _combine(keep: list[str], text: str):
    """The hits that several blocks found, as one value for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, text):
            data, offsets = tx.buffers(batch.column(text))
            n_words = np.diff(tx.spans(tx.LOWER[data], offsets, tx.ALNUM)[2])
            pairs = zip(batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)
            found = {i: (merged(map(tuple, s)), set(x)) for i, (s, x) in enumerate(pairs) if s}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), _hits_column(found, n_words)], [*keep, HITS]
            )

    return run


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], T.StructType] | None = None,
) -> DataFrame:
    """Columns ``keep`` of every document, and in HITS its words, hit words, spans of hit words and items found.

    ``then``, a function on such batches and its result's schema, runs in the same Python worker: a second
    function of its own would take a second worker for every task.
    """
    spark = docs.sparkSession
    columns = list(dict.fromkeys([*keep, text]))
    follow, schema = then or (iter, T.StructType([*(docs.schema[c] for c in keep), T.StructField(HITS, HITS_TYPE)]))
    matchers = matcher_blocks(benchmark, window, block_words)
    first, second = next(matchers), next(matchers, None)
    if second is None:
        mark = _mark(spark.sparkContext.broadcast(first), keep, text)
        return docs.select(*columns).mapInArrow(lambda batches: follow(mark(batches)), schema)

    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = docs.select(key.alias("__key"), F.col(text).alias("__text"))
    parts = []
    for matcher in itertools.chain((first, second), matchers):
        block = spark.sparkContext.broadcast(matcher)
        part = texts.mapInArrow(_only_found(block), "__key string, __spans array<array<int>>, __items array<long>")
        parts.append(stored(part.distinct(), "hits"))
        block.unpersist()
    found = functools.reduce(DataFrame.unionByName, parts).groupBy("__key")
    found = stored(
        found.agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.flatten(F.collect_list("__items")).alias("__items")),
        "hits-of-texts",
    )
    joined = docs.select(*columns).withColumn("__key", key).join(found, "__key", "left").drop("__key")
    combine = _combine(keep, text)
    return joined.mapInArrow(lambda batches: follow(combine(batches)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: words, hit words, and the digest of the sorted ids of the items found in it."""
    hits = F.col(HITS)
    names = F.array_join(F.array_sort(F.transform(hits["items"], lambda x: x.cast("string"))), ",")
    return marked(docs, benchmark, ["doc_id"], **options).select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"),
        hits["spans"].alias("spans"),
        hits["items"].alias("items"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, text: str = "text", **options) -> DataFrame:
    """Documents without the hit spans; those with ``max_coverage`` of their words hit, or more, go.

    A span is cut from the first byte of its first word to the last byte of its
    last word. Documents without hits stay as they are, byte by byte.
    """
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, hits = batch.columns
            at = names.index(text)
            texts, kept = columns[at].to_pylist(), []
            for i, x in enumerate(hits.to_pylist()):
                if x["n_hit"]:
                    texts[i] = without(texts[i], x["spans"])
                if not x["n_hit"] or x["n_hit"] < max_coverage * x["n_words"]:
                    kept.append(i)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).take(pa.array(kept, pa.int64()))

    return marked(docs, benchmark, names, text, then=(cut, docs.schema), **options)


def without(text: str, spans) -> str:
    """``text`` less the given spans of words."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = tx.spans(tx.LOWER[data], np.array([0, len(data)]), tx.ALNUM)
    keep = np.ones(len(data), bool)
    for a, b in spans:
        keep[starts[a] : ends[b - 1]] = False
    return data[keep].tobytes().decode()


SQL = rf"""
WITH b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM benchmark)
), w AS (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM documents)
), g AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT n FROM w)
  WHERE i + n - 1 <= len(ws)
), h AS (
  SELECT DISTINCT doc_id, item_id, i, g.n FROM g JOIN w ON g.k = w.k AND g.n = w.n
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of documents; drop documents that are mostly such passages."""
    return remove_spans(docs, documents(spark, sf_dir, "benchmark"))
