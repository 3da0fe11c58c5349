"""Removal of long passages that repeat across documents, with prefix-partitioned suffix trees.

A window is ``window`` consecutive words. A window that also starts in a document
with a smaller id makes its words go. Windows are judged on the input.

Only some suffixes are needed to find all repeats. Among the ``window - k + 1``
runs of k words in a window, the one with the smallest hash is its anchor, so
equal windows hold the same anchor at the same place. The suffixes that start at
anchors are the leaves. Each carries its words up to a window's length and the
words before it that a window can reach back to.

* Leaves with the same words around them form a class. A class is one row with
  its smallest id, whatever the number of its leaves, so a passage that a third
  of all documents share makes no large group. Leaves of larger ids lose all
  windows that the class holds.
* An anchor's k words are the prefix by which classes are split into groups.
  Only prefixes that occur in different texts go on.
* A group of up to ``group_rows`` classes is sorted by the words that follow. With
  the common prefixes of neighbours this is the group's suffix tree: a node of
  depth d is a stretch of classes whose common prefixes reach d. Under each node
  deep enough for a window, classes that also agree in the words before them hold
  the same window, and the node's smallest id owns it.
* The prefix of a larger group is lengthened by ``step`` words at a time, until
  its parts are small enough or hold whole windows. Windows that end within the
  added words are settled by an aggregate over classes before the group is split.

Documents that equal a smaller one word by word are removed whole when they hold
a window; they take no part in the search.

Null texts have no words. Texts shorter than a window lose nothing. Rows without
id lose nothing and own nothing. Repeated rows with one id are one document.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents, join_groups, shuffle_tasks, stored

WINDOW = 50
PREFIX = 25
GROUP_ROWS = 20_000
STEP = 5
LEAF_ROWS = 5_000


def _sliding(x: np.ndarray, n: int, ufunc) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over each stretch of ``n`` values."""
    width = 1
    out = x
    while width * 2 <= n:
        out = ufunc(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return ufunc(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(h: np.ndarray, firsts: np.ndarray, window: int = WINDOW, k: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows of all texts, and the hashes of their k words."""
    w = window - k + 1
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = tx.runs(h, k)
    low = _sliding(g, w, np.minimum)
    row = tx.row_of(firsts)
    whole = row[: len(h) - window + 1] == row[window - 1 :]
    # Windows across texts get the smallest value; the search below then passes over them.
    low = np.where(whole, low, np.uint64(0))
    reach = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    highest = _sliding(reach, w, np.maximum)
    at = np.flatnonzero((highest == g) & (g > 0))
    return at, g[at]


def _sha(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """SHA-256 of the words joined by one space."""
    if not len(starts):
        return hashlib.sha256(b"").hexdigest()
    raw = data.tobytes()
    return hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])).hexdigest()


def _digest(before: bytes, after: bytes) -> bytes:
    """128-bit digest of word hashes and of the place where ``after`` begins."""
    return hashlib.blake2b(before + after, digest_size=16, salt=len(before).to_bytes(8, "little")).digest()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


class Repeats:
    def __init__(self, docs: DataFrame, window: int = WINDOW, k: int = PREFIX, group_rows: int = GROUP_ROWS) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.window, self.k, self.group_rows = window, k, group_rows
        # Windows reach up to this many words before an anchor; a class's late windows are a bit each.
        self.back = window - k
        assert 0 < self.back < 63, "a window has 1 to 62 words more than a prefix"

    def survey(self) -> DataFrame:
        """Per document: number of words, digests of its words and the hashes of its anchors."""
        window, k = self.window, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tx.chunks(batches):
                data, offsets = tx.buffers(batch.column("text"))
                starts, ends, firsts = tx.spans(data, offsets, tx.SPACED)
                h = tx.hashes(data, starts, ends)
                at, found = anchors(h, firsts, window, k)
                cuts = np.searchsorted(at, firsts)
                shas, digests, lists = [], [], []
                for i in range(batch.num_rows):
                    a, b = firsts[i], firsts[i + 1]
                    low = offsets[i]
                    shas.append(_sha(data[low : offsets[i + 1]], starts[a:b] - low, ends[a:b] - low))
                    digests.append(int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little", signed=True))
                    lists.append(np.unique(found[cuts[i] : cuts[i + 1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(firsts).astype(np.int64)),
                        pa.array(shas),
                        pa.array(digests, pa.int64()),
                        pa.array(lists, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_words", "sha", "digest", "anchors"],
                )

        return self.docs.mapInArrow(run, "doc_id long, n_words long, sha string, digest long, anchors array<long>")

    def _leaves(self, wanted: DataFrame) -> DataFrame:
        """The suffixes of ``wanted`` (doc_id, text, groups): class, anchor, place, and the words around it."""
        window, k, back = self.window, self.k, self.back
        names = ["class", "prefix", "doc_id", "place", "before", "after"]
        types = pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tx.chunks(batches, limit=1 << 20):
                h, firsts = tx.words(batch.column("text"))
                at, found = anchors(h, firsts, window, k)
                cuts = np.searchsorted(at, firsts)
                rows: list[tuple] = []
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    first, end = int(firsts[i]), int(firsts[i + 1])
                    own_at, own = at[cuts[i] : cuts[i + 1]], found[cuts[i] : cuts[i + 1]].view(np.int64)
                    shared = np.isin(own, np.array(batch.column("groups")[i].as_py(), np.int64))
                    for p, key in zip(own_at[shared].tolist(), own[shared].tolist(), strict=True):
                        before, after = h[max(first, p - back) : p].tobytes(), h[p : min(end, p + window)].tobytes()
                        rows.append((_digest(before, after), key, doc_id, p - first, before, after))
                        if len(rows) >= LEAF_ROWS:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

        return wanted.mapInArrow(run, "class binary, prefix long, doc_id long, place int, before binary, after binary")

    def _subtrees(self, classes: DataFrame) -> DataFrame:
        """(class, late) of the classes in groups (class, key, owner, before, after, reach).

        Bit r of ``late`` is set if a smaller id than the class's own holds the window
        that starts r words before it. Only windows of up to ``reach`` words before
        the anchor are looked at.
        """
        window, back = self.window, self.back

        def matrix(column, width: int, right: bool) -> np.ndarray:
            out = np.zeros((len(column), width), np.uint64)
            for i, x in enumerate(column.to_pylist()):
                words = np.frombuffer(x, np.uint64)
                out[i, width - len(words) if right else 0 : width if right else len(words)] = words
            return out

        def tree(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, doc, most = (batch.column(c).to_numpy() for c in ("key", "owner", "reach"))
            n_before, n_after = (np.array([len(x) // 8 for x in batch.column(c).to_pylist()]) for c in ("before", "after"))
            after, before = matrix(batch.column("after"), window, False), matrix(batch.column("before"), back, True)
            # Classes come sorted by key and following words: common prefix of each with the one above it.
            same = after[1:] == after[:-1]
            common = np.where(same.all(1), window, np.argmin(same, axis=1))
            common = np.concatenate([[0], np.where(key[1:] == key[:-1], common, 0)])
            backward, late = np.zeros(len(key), np.uint64), np.zeros(len(key), np.int64)
            for reach in range(back + 1):
                if reach:
                    backward = tx.mix(backward ^ before[:, back - reach])
                fits = np.flatnonzero((n_before >= reach) & (n_after >= window - reach) & (most >= reach))
                node = np.cumsum(common < window - reach)[fits]
                order = np.lexsort((doc[fits], backward[fits], node))
                rows, node = fits[order], node[order]
                head = np.ones(len(rows), bool)
                head[1:] = (node[1:] != node[:-1]) | (backward[rows][1:] != backward[rows][:-1])
                smallest = doc[rows][head][np.cumsum(head) - 1]
                late[rows[doc[rows] > smallest]] |= 1 << reach
            some = np.flatnonzero(late)
            return pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(some)), pa.array(late[some])], ["class", "late"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column("key").to_numpy()
                if held and held[-1].column("key")[-1].as_py() != keys[0]:
                    yield tree(_joined(held))
                    held = []
                cut = int(np.flatnonzero(keys == keys[-1])[0])
                if cut:
                    yield tree(_joined([*held, batch.slice(0, cut)]))
                    held = []
                held.append(batch.slice(cut))
            if held:
                yield tree(_joined(held))

        tasks = shuffle_tasks(classes.sparkSession)
        rows = classes.select("class", "key", "owner", "reach", "before", "after")
        return rows.repartition(tasks, "key").sortWithinPartitions("key", "after").mapInArrow(run, "class binary, late long")

    def _windows(self, classes: DataFrame, low: int, high: int) -> DataFrame:
        """(class, late) for the windows that start ``low`` to ``high`` words before the anchor, by an aggregate over classes."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wholes, places, bits = [], [], []
                for i, (before, after) in enumerate(zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True)):
                    for reach in range(low, high + 1):
                        if len(before) >= 8 * reach and len(after) >= 8 * (window - reach):
                            wholes.append(_digest(before[len(before) - 8 * reach :], after[: 8 * (window - reach)]))
                            places.append(i)
                            bits.append(1 << reach)
                columns = [batch.column(c).take(pa.array(places, pa.int64())) for c in ("class", "owner")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(bits, pa.int64()), pa.array(wholes, pa.binary())], ["class", "owner", "bit", "whole"]
                )

        rows = classes.select("class", "owner", "before", "after").mapInArrow(run, "class binary, owner long, bit long, whole binary")
        rows = stored(rows, "windows")
        smallest = rows.groupBy("whole").agg(F.min("owner").alias("smallest"), F.count(F.lit(1)).alias("n_rows"))
        joined = join_groups(rows, stored(smallest, "window-owners"), "whole", "n_rows", rows.count())
        return joined.filter("owner > smallest").groupBy("class").agg(F.bit_or("bit").alias("late"))

    def _late(self, classes: DataFrame) -> DataFrame:
        """(class, late) of all classes; a class may come several times."""
        window, reach = self.window, self.back
        found = None
        while True:
            sizes = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
            # At most one key per group_rows classes, so the keys can be broadcast. No other key is large,
            # and the rest needs no join: it is shuffled once, into its trees.
            large = stored(sizes.filter(F.col("n_rows") > self.group_rows).select("key"), "large-keys")
            trees = self._subtrees(classes.join(F.broadcast(large), "key", "left_anti").withColumn("reach", F.lit(reach)))
            found = trees if found is None else found.unionByName(trees)
            if not large.head(1):
                return found
            rest = stored(classes.join(F.broadcast(large), "key"), "large-groups")
            low = max(reach - STEP + 1, 0)
            found = found.unionByName(self._windows(rest, low, reach))
            reach = low - 1
            if reach < 0:
                return found
            n_bytes = 8 * (window - reach)
            # Classes too short for the windows that are left have none to lose.
            classes = stored(
                rest.filter(F.length("after") >= n_bytes).withColumn("key", F.xxhash64(F.substring("after", 1, n_bytes))), "longer-prefixes"
            )

    def spans(self, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Stored texts that share an anchor, and (doc_id, place, n_before, n_after, late) of their leaves that lose windows."""
        usable = seen.filter("doc_id IS NOT NULL")
        each = usable.select("doc_id", "digest", F.explode("anchors").alias("anchor"))
        groups = each.groupBy("anchor").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.count(F.lit(1)).alias("n_rows"))
        groups = stored(groups.filter("d0 <> d1").select("anchor", "n_rows"), "prefixes")
        total = seen.agg(F.sum(F.size("anchors"))).first()[0] or 0
        by_doc = join_groups(each, groups, "anchor", "n_rows", total).groupBy("doc_id").agg(F.collect_list("anchor").alias("groups"))
        wanted = stored(self.docs.dropDuplicates(["doc_id"]).join(by_doc, "doc_id"), "sharing-texts")
        leaves = stored(self._leaves(wanted), "leaves")
        classes = leaves.groupBy("class", F.col("prefix").alias("key"), "before", "after").agg(
            F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n_rows")
        )
        classes = stored(classes, "classes")
        late = self._late(classes.drop("n_rows")).groupBy("class").agg(F.bit_or("late").alias("late"))
        known = classes.select("class", "owner", "n_rows").join(late, "class", "left")
        known = stored(known.filter("n_rows > 1 OR late IS NOT NULL"), "late-classes")
        here = leaves.select(
            "class",
            "doc_id",
            "place",
            (F.length("before") / 8).cast("int").alias("n_before"),
            (F.length("after") / 8).cast("int").alias("n_after"),
        )
        found = join_groups(here, known, "class", "n_rows", leaves.count())
        every = F.lit((1 << (self.back + 1)) - 1)
        found = found.withColumn("late", F.when(F.col("doc_id") > F.col("owner"), every).otherwise(F.col("late")))
        return wanted.select("doc_id", "text"), found.filter("late IS NOT NULL").select("doc_id", "place", "n_before", "n_after", "late")

    def remaining(self) -> DataFrame:
        """Per document: n_words, n_removed, digest of the kept words, and the kept words' spans to remove."""
        seen = stored(self.survey(), "survey")
        usable = seen.filter("doc_id IS NOT NULL")
        first = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")), "equal-texts")
        known = join_groups(usable.drop("anchors"), first.select("digest", "first", "n_rows"), "digest", "n_rows", usable.count())
        is_copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= self.window)
        known = stored(known.select("doc_id", "n_words", "sha", is_copy.alias("is_copy")), "known")
        heads = seen.join(known.filter("is_copy").select("doc_id"), "doc_id", "left_anti")
        texts, spans = self.spans(heads)
        by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n_before", "n_after", "late")).alias("leaves"))
        cut = texts.join(by_doc, "doc_id").mapInArrow(_cutter(self.window, self.back), "doc_id long, n_removed long, cut_sha string")
        nothing = F.sha2(F.lit(""), 256)
        out = known.join(stored(cut, "cut"), "doc_id", "left").select(
            "doc_id",
            "n_words",
            F.when(F.col("is_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("is_copy"), nothing).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        )
        rest = seen.filter("doc_id IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
        return out.unionByName(rest)


def _cutter(window: int, back: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            removed, shas = [], []
            for i in range(batch.num_rows):
                data, offsets = tx.buffers(batch.column("text").slice(i, 1))
                starts, ends, _ = tx.spans(data, offsets, tx.SPACED)
                leaves = batch.column("leaves").slice(i, 1).flatten()
                place, n_before, n_after, late = (leaves.field(c).to_numpy() for c in ("place", "n_before", "n_after", "late"))
                opened = np.zeros(len(starts) + 1, np.int64)
                for reach in range(back + 1):
                    # Places of one document differ, so no index comes twice.
                    low = place[(late >> reach & 1 == 1) & (n_before >= reach) & (n_after >= window - reach)] - reach
                    opened[low] += 1
                    opened[low + window] -= 1
                keep = np.cumsum(opened)[:-1] == 0
                removed.append(int((~keep).sum()))
                shas.append(_sha(data, starts[keep], ends[keep]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(shas)], ["doc_id", "n_removed", "cut_sha"])

    return run


SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW})
), o AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS owner FROM w) WHERE doc_id > owner
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM o
), p AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d
), k AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.p) AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p WHERE c.p IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op6_substrings", SQL)
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repeats(documents(spark, sf_dir)).remaining()
