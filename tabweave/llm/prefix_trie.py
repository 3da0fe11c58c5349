"""Trie of shared conversation prefixes over minimal-perfect-hash node tables.

A node is a distinct sequence of first turns. Conversations stream in order and
every prefix gets a digest chained from its parent's. Tasks work on shards of
prefix rows: a shard's distinct digests get the slots of a minimal perfect hash,
each slot verified against the whole digest, and counts are scattered into flat
arrays by slot. Summed over shards these give one row per node; a digest that
stands for two different nodes is an error.

For subtree sums a node's own values are placed once, in the shard of its smallest
member, whose other prefixes are the node's ancestors. There they accumulate
through the parent-slot array, deepest nodes first, and the shards' sums are added
per node. So a first turn or conversation that a third of all rows share is one
row per shard, and no step takes a round per depth. A conversation's turns stream
deepest first, and what a cut shard has summed up is handed to the next one, so
long conversations need no memory. One conversation stays in one task, as do the
chunks of members' ids that are hashed for one node.

Null roles and texts count as empty. Turns of one number are in the order of role
and text, and repeated rows are turns of their own. Rows without conversation id
belong to no conversation. Other columns are ignored. No conversation, no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.base import query
from tabweave.llm.frames import documents, join_groups, shuffle_tasks, stored
from tabweave.llm.text import mix

SHARD_ROWS = 1 << 17
CHUNK_IDS = 1 << 15
DIGEST = 16
#: Table positions a key at each level of the perfect hash; more make it larger and shallower.
GAMMA = 1.5
LEVELS = 64
ROOT = hashlib.blake2b(b"root", digest_size=DIGEST).digest()


class NodeTable:
    """Slots 0 to n - 1 for n distinct digests (rows of two 64-bit words), without gaps.

    Each level places the digests still left by another hash; those alone at
    their position take it, and a slot is the rank of a taken position.
    """

    def __init__(self, digests: np.ndarray) -> None:
        self.ranks: list[np.ndarray] = []
        rest, taken = np.arange(len(digests)), 0
        while len(rest):
            if len(self.ranks) == LEVELS:
                raise ValueError("digests are not distinct")
            size = int(len(rest) * GAMMA) + 1
            at = self._place(digests[rest], len(self.ranks), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            ranks = np.full(size, -1)
            here = np.zeros(size, bool)
            here[at[alone]] = True
            ranks[here] = taken + np.arange(alone.sum())
            self.ranks.append(ranks)
            rest, taken = rest[~alone], taken + int(alone.sum())
        self.digests = np.zeros((len(digests), 2), np.uint64)
        self.digests[self._slots(digests)] = digests

    def _place(self, digests: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(digests[:, 0] + np.uint64(level)) ^ digests[:, 1]) % np.uint64(size)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(digests), -1), np.arange(len(digests))
        for level, ranks in enumerate(self.ranks):
            slots = ranks[self._place(digests[open_], level, len(ranks)).astype(np.int64)]
            out[open_] = slots
            open_ = open_[slots < 0]
        return out

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for digests that the table does not hold."""
        slots = self._slots(digests)
        known = slots >= 0
        known[known] = (self.digests[slots[known]] == digests[known]).all(1)
        return np.where(known, slots, -1)


def _words(column) -> np.ndarray:
    """Digests of an Arrow column as rows of two words; null is zero."""
    return np.frombuffer(b"".join(x or bytes(DIGEST) for x in column.to_pylist()), np.uint64).reshape(-1, 2)


def _bytes(digests: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(digests).tobytes()
    return pa.array([flat[i : i + DIGEST] for i in range(0, len(flat), DIGEST)], pa.binary())


def _distinct(digests: np.ndarray) -> np.ndarray:
    """The first row of each distinct digest."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ordered = digests[order]
    first = np.ones(len(order), bool)
    first[1:] = (ordered[1:] != ordered[:-1]).any(1)
    return order[first]


def shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of at least ``rows`` but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)]
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of sorted turns, root included; a row without key only starts its conversation."""
    names = ["conv_id", "depth", "digest", "parent", "key", "words", "is_end"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    held: list[tuple] = []
    conv, depth, digest = None, 0, ROOT

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for owner, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words")), strict=True):
            if owner != conv:
                if held:
                    held[-1] = (*held[-1][:-1], True)
                conv, depth, digest = owner, 0, ROOT
                held.append((conv, 0, ROOT, None, None, 0, False))
            if key is not None:
                parent, depth = digest, depth + 1
                digest = hashlib.blake2b(parent + key, digest_size=DIGEST).digest()
                held.append((conv, depth, digest, parent, key, words, False))
        if len(held) > 1:
            yield batch_of(held[:-1])
            held = held[-1:]
    if held:
        yield batch_of([(*held[-1][:-1], True)])


def counted(batches: Iterator[pa.RecordBatch], rows: int = SHARD_ROWS) -> Iterator[pa.RecordBatch]:
    """Each shard's nodes with members, smallest member and members that end there."""
    for shard in shards(batches, rows):
        digests, conv = _words(shard.column("digest")), shard.column("conv_id").to_numpy()
        first = _distinct(digests)
        table = NodeTable(digests[first])
        slots = table.find(digests)
        origin = np.empty(len(first), np.int64)
        origin[slots[first]] = first
        for name in ("parent", "key", "depth"):
            column = shard.column(name)
            if not column.equals(column.take(pa.array(origin[slots]))):
                raise ValueError("two nodes share a digest")
        n = len(first)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, slots, conv)
        ends = np.bincount(slots[shard.column("is_end").to_numpy(zero_copy_only=False)], minlength=n)
        out = shard.select(["digest", "parent", "depth", "key", "words"]).take(pa.array(origin))
        columns = [pa.array(x) for x in (least, np.bincount(slots, minlength=n), ends)]
        yield pa.RecordBatch.from_arrays([*out.columns, *columns], [*out.schema.names, "conv_id", "n_convs", "n_ends"])


def accumulated(batches: Iterator[pa.RecordBatch], rows: int = SHARD_ROWS) -> Iterator[pa.RecordBatch]:
    """Sums over subtrees within each shard of rows sorted by conversation, deepest first."""
    names = ["saved", "leaves", "children"]
    carried: tuple[np.ndarray, list[np.ndarray]] | None = None
    for shard in shards(batches, rows):
        digests, parents = _words(shard.column("digest")), _words(shard.column("parent"))
        first = _distinct(digests)
        table = NodeTable(digests[first])
        slots = table.find(digests)
        n = len(first)
        depth, above = np.empty(n, np.int64), np.empty((n, 2), np.uint64)
        depth[slots], above[slots] = shard.column("depth").to_numpy(), parents
        parent = table.find(above)
        sums = [np.zeros(n, np.int64) for _ in names]
        placed = [shard.column(c).to_numpy() for c in ("saved", "leaves", "own")]
        for into, values in zip(sums, placed[:2], strict=False):
            np.add.at(into, slots, values)
        own = np.zeros(n, np.int64)
        np.add.at(own, slots, placed[2])
        np.add.at(sums[2], parent[parent >= 0], own[parent >= 0])
        if carried is not None:
            at = table.find(carried[0])
            for into, values in zip(sums, carried[1], strict=True):
                np.add.at(into, at, values)
        order = np.argsort(-depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        for level in np.split(order, cuts):
            level = level[parent[level] >= 0]
            for into in sums[:2]:
                np.add.at(into, parent[level], into[level])
        # Only the conversation that the shard's end cuts has a prefix whose parent is not here.
        cut = np.flatnonzero((depth > 0) & (parent < 0))
        carried = (above[cut], [sums[0][cut], sums[1][cut], own[cut]]) if len(cut) else None
        yield pa.RecordBatch.from_arrays([_bytes(table.digests), *map(pa.array, sums)], ["digest", *names])


def listed(batches: Iterator[pa.RecordBatch], ids: int = CHUNK_IDS) -> Iterator[pa.RecordBatch]:
    """Ids of sorted (digest, conv_id) rows as comma-joined chunks with their first id."""
    for shard in shards(batches, ids):
        digests, conv = _words(shard.column("digest")), shard.column("conv_id").to_numpy()
        cuts = [0, *(np.flatnonzero((digests[1:] != digests[:-1]).any(1)) + 1).tolist(), len(conv)]
        chunks = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        firsts = np.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays([_bytes(digests[firsts]), pa.array(conv[firsts]), pa.array(chunks)], ["digest", "first", "chunk"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each digest's chunks in order, joined by commas."""
    last, state = None, hashlib.sha256()
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for digest, chunk in zip(batch.column("digest").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if digest != last:
                if last is not None:
                    out.append((last, state.hexdigest()))
                last, state = digest, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["digest", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Every turn with its place ``pos`` from 1, a digest ``key`` of role and text, and its number of words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    tagged = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "conv_id",
        place.alias("pos"),
        F.unhex(F.sha2(tagged, 256)).alias("key"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


class PrefixTrie:
    """The trie of ``turns``: conv_id, sort columns ``part`` and ``pos``, key and words of each turn.

    A row without key is no turn; it makes sure that its conversation takes part.
    """

    def __init__(self, turns: DataFrame) -> None:
        self.tasks = shuffle_tasks(turns.sparkSession)
        ordered = turns.repartition(self.tasks, "conv_id").sortWithinPartitions("conv_id", "part", "pos")
        schema = "conv_id long, depth long, digest binary, parent binary, key binary, words long, is_end boolean"
        self.prefixes = stored(ordered.select("conv_id", "key", "words").mapInArrow(chained, schema), "prefixes")

    def counts(self) -> DataFrame:
        """One row per node with its members, smallest member and members that end there."""
        schema = "digest binary, parent binary, depth long, key binary, words long, conv_id long, n_convs long, n_ends long"
        parts = self.prefixes.mapInArrow(counted, schema)
        sums = F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends")
        nodes = stored(parts.groupBy("digest", "parent", "depth", "key", "words").agg(*sums), "nodes")
        total, distinct = nodes.agg(F.count(F.lit(1)), F.count_distinct("digest")).first()
        if total != distinct:
            raise ValueError("two nodes share a digest")
        return nodes

    def subtrees(self, nodes: DataFrame) -> DataFrame:
        """Saved tokens, leaves and children per digest."""
        zero = F.lit(0).cast("long")
        leaf = (F.col("n_convs") == F.col("n_ends")).cast("long")
        own = nodes.select(
            "conv_id", "depth", "digest", "parent", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), leaf.alias("leaves"), (zero + 1).alias("own")
        )
        paths = self.prefixes.select("conv_id", "depth", "digest", "parent", zero.alias("saved"), zero.alias("leaves"), zero.alias("own"))
        paths = paths.join(nodes.select("conv_id").distinct().hint("merge"), "conv_id", "left_semi")
        dealt = own.unionByName(paths).repartition(self.tasks, "conv_id").sortWithinPartitions("conv_id", F.desc("depth"))
        sums = dealt.mapInArrow(accumulated, "digest binary, saved long, leaves long, children long")
        return sums.groupBy("digest").agg(*(F.sum(c).alias(c) for c in ("saved", "leaves", "children")))

    def ends(self) -> DataFrame:
        """SHA-256 of the ids of the conversations that end at a node, ascending and comma-joined."""
        rows = self.prefixes.filter("is_end").select("digest", "conv_id")
        dealt = rows.repartitionByRange(self.tasks, "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
        chunks = dealt.mapInArrow(listed, "digest binary, first long, chunk string")
        together = chunks.repartition(self.tasks, "digest").sortWithinPartitions("digest", "first")
        return together.select("digest", "chunk").mapInArrow(hashed, "digest binary, ends_sha256 string")

    def nodes(self) -> DataFrame:
        """One row per node of the trie."""
        nodes = self.counts()
        sums = nodes.join(self.subtrees(nodes).hint("merge"), "digest").join(self.ends().hint("merge"), "digest", "left")
        full = stored(sums.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "trie")
        parents = full.filter("children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("children").alias("n"))
        below = join_groups(full.filter("depth > 0"), parents, "parent", "n", full.count()).drop("n")
        return below.unionByName(full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def spliced(turns: DataFrame, every: int, head: Column) -> DataFrame:
    """Turns of conversations rebuilt from the first turns of every ``every``-th one.

    Conversation c gets the first ``head`` (a column over conv_id) turns of
    c - c % every, then its own turns after as many.
    """
    convs = turns.select("conv_id").distinct().withColumn("h", head)
    marks = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    bases = turns.filter(F.col("conv_id") % every == 0).withColumnRenamed("conv_id", "base")
    own_base = F.col("conv_id") - F.col("conv_id") % every
    first = convs.withColumn("base", own_base).join(bases, "base").filter("pos <= h")
    rest = turns.filter(F.col("pos") > head)
    columns = "conv_id", "part", "pos", "key", "words"
    return marks.unionByName(first.withColumn("part", F.lit(1)).select(*columns)).unionByName(rest.withColumn("part", F.lit(2)).select(*columns))


#: CRC-32 in SQL: a table made by eight shifts, then one step a byte of the decimal text.
CRC_SQL = """crc_steps(n, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY n) AS cs FROM crc_steps WHERE k = 8
)"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text; the query joins ``crc_table``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    step = "lambda a, b: xor(a >> 8, cs[1 + (xor(a, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), {step}), 4294967295)"


SQL = rf"""
WITH RECURSIVE {CRC_SQL}, convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("conv_id::VARCHAR")} % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table
), own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts[1:h], []), o.ts[h + 1:]) AS ts
  FROM convs c JOIN own o ON o.conv_id = c.conv_id LEFT JOIN own b ON b.conv_id = c.base
), prefix AS (
  SELECT conv_id, d AS depth, ts[1:d] AS path, len(ts) = d AS is_end
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)
), node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(is_end) AS is_leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM prefix GROUP BY path, depth
), valued AS (
  SELECT *, CASE WHEN depth = 0 THEN 0
            ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')) END AS saved FROM node
), above AS (
  SELECT path[1:d] AS path, d AS depth, sum(saved) AS saved_tokens, count(*) FILTER (WHERE is_leaf) AS n_leaves,
         count(*) FILTER (WHERE below = d + 1) AS n_children
  FROM (SELECT path, depth AS below, saved, is_leaf, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY 1, 2
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, a.n_children, a.n_leaves,
       a.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN above a ON a.depth = v.depth AND a.path = v.path
LEFT JOIN node p ON p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(turn_rows(documents(spark, sf_dir, "conversations")), "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    found = PrefixTrie(spliced(turns, 20, head)).nodes()
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
