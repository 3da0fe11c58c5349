"""SimHash near-deduplication by covering locality-sensitive hashing.

A document's fingerprint has a bit set where more than half of its shingle hashes
have it. Equal fingerprints form a class; only distinct fingerprints are searched.

Every bit position gets a non-zero vector of ``radius + 1`` bits. Each non-zero
vector v of that width gives a mask: the positions whose vector has an odd
product with v. The vectors of any ``radius`` positions leave some v orthogonal
to all of them, so two fingerprints that differ there agree under v's mask:
every pair within the radius shares a bucket in one of the 2 ** (radius + 1) - 1
tables, with certainty. Buckets are verified by the number of differing bits.

A bucket does not list its pairs: a task walks its fingerprints and emits a
spanning forest of the links, one row fewer than the bucket has. A bucket of more
than ``BUCKET_ROWS`` fingerprints is split by the same construction over the bits
that its mask leaves open. About a quarter of the bits stay open then, so at most
2 ** 16 distinct fingerprints of 64 bits can meet, whatever the data.

Null and empty texts and texts without words have fingerprint zero and are linked
like any other. Texts with fewer words than a shingle are one shingle. Repeated
rows share a class. Rows without id take part in links; they count for no
component id, which is null where no row of the component has an id. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents, join_groups, shuffle_tasks, stored
from tabweave.llm.near_dedup import connected

BITS = 64
SEED = 42
BUCKET_ROWS = 1 << 14
SHINGLE_BLOCK = 1 << 16

#: Each bit of a byte in a byte of its own, to add up to 255 of them at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words joined by one space, with their new starts and ends."""
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1
    new_starts = new_ends - sizes
    out = np.full(int(new_ends[-1]) if len(new_ends) else 0, 0x20, np.uint8)
    flat = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(new_starts, sizes) + flat] = data[np.repeat(starts, sizes) + flat]
    return out.tobytes(), new_starts, new_ends


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    spread = _SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)


def fingerprints(column, size: int) -> np.ndarray:
    """The fingerprint of each text's word shingles."""
    data, offsets = tx.buffers(column)
    starts, ends, firsts = tx.spans(data := tx.LOWER[data], offsets, tx.SPACED)
    out = np.zeros(len(firsts) - 1, np.uint64)
    for i, (first, last) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
        total = max(last - first - size + 1, min(last - first, 1))
        counts = np.zeros(BITS, np.int64)
        for a in range(first, first + total, SHINGLE_BLOCK):
            b = min(a + SHINGLE_BLOCK, first + total)
            upto = min(b + size - 1, last)
            line, s, e = joined(data, starts[a:upto], ends[a:upto])
            e = e[size - 1 :] if upto - a >= size else e[-1:]
            pieces = (xxhash.xxh64_intdigest(line[x:y], SEED) for x, y in zip(s.tolist(), e.tolist()))
            counts += bit_counts(np.fromiter(pieces, np.uint64, b - a))
        out[i] = np.packbits(2 * counts > total).view(">u8")[0]
    return out


def cover(positions: list[int], radius: int) -> list[int]:
    """Masks over the bit positions, so that any ``radius`` of these are outside one of the masks."""
    vectors = range(1, 1 << (radius + 1))
    given = {p: i % len(vectors) + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in given.items() if (m & v).bit_count() % 2) for v in vectors]


def refined(mask: int, radius: int) -> list[int]:
    """Wider masks that cover the bits which ``mask`` leaves open."""
    return [mask | m for m in cover([p for p in range(BITS) if not mask >> p & 1], radius)]


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect what links within the radius connect, as indexes."""
    left, out_a, out_b, reached = np.arange(len(x)), [], [], []
    while len(left):
        if not reached:
            reached, left = [left[0]], left[1:]
        i = reached.pop()
        near = np.bitwise_count(x[left] ^ x[i]) <= radius
        hit, left = left[near], left[~near]
        out_a.append(np.full(len(hit), i))
        out_b.append(hit)
        reached.extend(hit)
    none = [np.empty(0, np.int64)]
    return np.concatenate(out_a or none), np.concatenate(out_b or none)


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted batches of (mask, key, fp). Pairs and singles are handled all at once, larger buckets one by one."""

    def links(x: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        two = two[np.bitwise_count(x[two] ^ x[two + 1]) <= radius]
        out_a, out_b = [x[two]], [x[two + 1]]
        for k in np.flatnonzero(sizes > 2):
            part = x[edges[k] : edges[k + 1]]
            a, b = forest(part, radius)
            out_a.append(part[a])
            out_b.append(part[b])
        columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (out_a, out_b)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("mask", "key", "fp"), strict=True)]
        mask, key, fp = held
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        if len(cuts):
            yield links(fp.view(np.uint64), np.concatenate([[0], cuts]))
            held = [h[cuts[-1] :] for h in held]
    if len(held[2]):
        yield links(held[2].view(np.uint64), np.array([0, len(held[2])]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _placed(fp: str, masks: Column) -> Column:
    return F.explode(F.transform(masks, lambda m: F.struct(m.alias("mask"), F.col(fp).bitwiseAND(m).alias("key"))))


class SimHash:
    """Fingerprints and components of ``docs`` (columns doc_id, text)."""

    def __init__(self, docs: DataFrame, shingle: int, radius: int) -> None:
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.shingle, self.radius = shingle, radius

    def fingerprints(self) -> DataFrame:
        """doc_id and fingerprint ``fp`` (64 bits as a long) of every row."""
        size = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tx.chunks(batches):
                fp = fingerprints(batch.column("text"), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

        return self.docs.mapInArrow(run, "doc_id long, fp long")

    def _searched(self, placed: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
        """Links of the buckets (mask, key, n), which hold more than one fingerprint each."""
        radius = self.radius
        placed = placed.withColumn("bucket", F.struct("mask", "key"))
        buckets = buckets.select(F.struct("mask", "key").alias("bucket"), "n")
        rows = join_groups(placed, buckets, "bucket", "n", total).select("mask", "key", "fp")
        dealt = rows.repartition(shuffle_tasks(self.spark), "mask", "key").sortWithinPartitions("mask", "key", "fp")
        return dealt.mapInArrow(lambda batches: bucket_links(batches, radius), "a long, b long")

    def links(self, classes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
        """Pairs (a, b) of fingerprints within the radius, which connect all that such pairs connect."""
        masks = [_signed(m) for m in cover(list(range(BITS)), self.radius)]
        placed = classes.select("fp", _placed("fp", F.array(*map(F.lit, masks))).alias("at")).select("at.*", "fp")
        buckets = placed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        buckets = stored(buckets, "simhash-buckets")
        total = classes.count() * len(masks)
        found = self._searched(placed, buckets.filter(F.col("n") <= bucket_rows), total)
        large = buckets.filter(F.col("n") > bucket_rows)
        n_large = large.agg(F.sum("n")).first()[0]
        if n_large:
            wider = F.array(*[F.array(*[F.lit(_signed(w)) for w in refined(m % (1 << BITS), self.radius)]) for m in masks])
            own = F.element_at(wider, F.array_position(F.array(*map(F.lit, masks)), F.col("mask")).cast("int"))
            rows = placed.withColumn("bucket", F.struct("mask", "key"))
            rows = join_groups(rows, large.select(F.struct("mask", "key").alias("bucket"), "n"), "bucket", "n", total)
            again = rows.select("fp", _placed("fp", own).alias("at")).select("at.*", "fp").distinct()
            again = stored(again, "simhash-split")
            smaller = again.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            smaller = stored(smaller, "simhash-split-buckets")
            found = found.unionByName(self._searched(again, smaller, n_large * len(masks)))
        return stored(found.distinct(), "simhash-links")

    def components(self) -> DataFrame:
        """Every row with its fingerprint and the smallest id that links reach."""
        rows = stored(self.fingerprints(), "simhash")
        classes = rows.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n_rows"))
        classes = stored(classes, "simhash-classes")
        roots = connected(self.links(classes.select("fp")))
        rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        rooted = stored(rooted.withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
        least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("n_classes"))
        least = stored(least, "simhash-components")
        known = join_groups(rooted, least, "root", "n_classes", rooted.count()).select("fp", "n_rows", "component_id")
        known = stored(known, "simhash-known")
        return join_groups(rows, known, "fp", "n_rows", rows.count()).select("doc_id", "fp", "component_id")


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SimHash(documents(spark, sf_dir), shingle=4, radius=4).components()
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
