"""MinHash near-deduplication with sequential Bayesian verification.

Documents become sets of word shingles. Documents with the same set form a class
and only the class's smallest id takes part in the search. Classes that agree in
a band of their signatures are candidates. A candidate pair's signatures are
compared batch by batch; the pair is dropped as soon as the posterior chance
that its similarity reaches the threshold falls below ``MISS``. What is left is
verified on the full sets.

Pairs of a band are not all listed. First every class is compared with the
smallest class of its band, so a large group of copies costs one pair for each
member. Where a band still holds several components after that, signatures are
compared across components where the band's rows are, in blocks. What stays
within the bounds forms groups; a group's full sets are compared in blocks too,
and only links leave a task.

Null texts and texts without words have an empty set and are linked with nothing.
Texts with fewer words than a shingle have their whole sequence as one shingle.
Repeated rows have equal sets. Rows without id are left as they are and linked
with nothing. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents, join_groups, shuffle_tasks, stored

#: Chance that a similar pair never shares a band, and that a comparison drops it.
MISS = 1e-7
BAND_ROWS = 6
BATCH = 32
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1_000_000


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, firsts = tx.words(column, tx.SPACED, lower=True)
    all_runs = tx.runs(h, size)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= size:
            yield np.unique(all_runs[a : b - size + 1])
        elif b > a:
            yield tx.runs(h[a:b], int(b - a)) + np.uint64(b - a)
        else:
            yield np.empty(0, np.uint64)


@functools.lru_cache(maxsize=4)
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of the set under as many hash functions, 32 bits each."""
    out = np.full(n, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(values), 4096):
        mixed = multipliers(n)[:, None] * values[None, start : start + 4096]
        np.minimum(out, (mixed >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def bands_for(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares none with chance ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


@functools.lru_cache(maxsize=16)
def least_matches(threshold: float, total: int, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(compared, matches needed) after each batch.

    Signatures are compared by their lowest byte, so two entries agree with chance
    s + (1 - s) / 256. With a uniform prior over that chance, the posterior of
    reaching the threshold after m of n matches is P(Binomial(n + 1, t) <= m).
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in [*range(BATCH, total, BATCH), total]:
        tail, m = 0.0, 0
        while m <= n:
            tail += math.exp(
                math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t)
            )
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def signatures(column, total: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, total)


def within_bounds(x: np.ndarray, y: np.ndarray, steps) -> np.ndarray:
    """The rows of two signature tables that pass the posterior bound after every batch."""
    alive, matched, start = np.arange(len(x)), np.zeros(len(x), int), 0
    for n, least in steps:
        matched = matched + (x[alive, start:n] == y[alive, start:n]).sum(1)
        alive, matched = alive[matched >= least], matched[matched >= least]
        start = n
    return alive


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Groups of rows with equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[0] != batch.column(c)[0] for c in keys):
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held)


def partners(group: pa.RecordBatch, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers (i, all j > i) of two blocks, of other components and fitting size; rows are sorted by n."""
    n, root, block = (group.column(c).to_numpy() for c in ("n", "root", "own"))
    across = group.column("low")[0].as_py() != group.column("high")[0].as_py()
    ends = np.searchsorted(n, 100 * n // percent, "right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, ends[i])
        j = j[root[j] != root[i]]
        if across:
            j = j[block[j] != block[i]]
        if len(j):
            yield i, j


class NearDuplicates:
    """Near-duplicate classes and components of ``docs`` (columns doc_id, text)."""

    def __init__(self, docs: DataFrame, percent: int, shingle: int, band_rows: int = BAND_ROWS) -> None:
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.percent, self.shingle, self.band_rows = percent, shingle, band_rows
        self.bands = bands_for(percent / 100, band_rows)

    def features(self) -> DataFrame:
        """Set size, set digest, band keys and one byte of each signature entry."""
        shingle, bands, rows = self.shingle, self.bands, self.band_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            salt = tx.mix(np.arange(bands, dtype=np.uint64))
            for batch in tx.chunks(batches):
                sizes, digests, keys, bytes_ = [], [], [], []
                for values in shingle_sets(batch.column("text"), shingle):
                    sizes.append(len(values))
                    digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    s = signature(values, bands * rows)
                    parts = s.reshape(bands, rows).astype(np.uint64)
                    key = salt.copy()
                    for j in range(rows):
                        key = tx.mix(key ^ parts[:, j])
                    keys.append(key.view(np.int64).tobytes())
                    bytes_.append(s.astype(np.uint8).tobytes())
                flat = pa.array(np.frombuffer(b"".join(keys), np.int64))
                keys = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * bands, flat)
                columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests), keys, pa.array(bytes_)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "keys", "bytes"])

        return self.docs.mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>, bytes binary")

    def _near(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose signatures stay within the posterior bounds."""
        total = self.bands * self.band_rows
        steps = least_matches(self.percent / 100, total)

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (signatures(batch.column(c), total) for c in ("bytes_a", "bytes_b"))
                yield batch.select(["a", "b"]).take(pa.array(within_bounds(x, y, steps)))

        sides = [classes.select(F.col("doc_id").alias(c), F.col("bytes").alias(f"bytes_{c}")) for c in ("a", "b")]
        return stored(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(prune, "a long, b long"), "near")

    def _blocks(self, rows: DataFrame, group: str, weight) -> DataFrame:
        """``rows`` dealt to pairs of blocks of their group, sorted by set size in each.

        A group is cut into so many blocks by a hash of the id that each has about
        BLOCK_ROWS rows; every pair of blocks is a unit of its own.
        """
        blocks = F.greatest(F.lit(1), F.ceil(weight)).cast("int")
        own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        dealt = rows.withColumn("own", own).withColumn("other", other)
        dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")
        return dealt.repartition(shuffle_tasks(self.spark), group, "low", "high").sortWithinPartitions(group, "low", "high", "n", "doc_id")

    def _candidates(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) that connect all rows of a band whose signatures stay within the bounds across components.

        ``rows`` has band, n_band, doc_id, n, root and bytes. A band's rows give at
        most one pair each, however many of them are alike.
        """
        percent, total = self.percent, self.bands * self.band_rows
        steps = least_matches(percent / 100, total)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups_of(batches, ["band", "low", "high"]):
                doc, bytes_ = group.column("doc_id").to_numpy(), signatures(group.column("bytes"), total)
                head = np.arange(len(doc))
                for i, j in partners(group, percent):
                    j = j[within_bounds(np.broadcast_to(bytes_[i], (len(j), total)), bytes_[j], steps)]
                    if len(j):
                        joined = np.unique(np.append(head[j], head[i]))
                        head[np.isin(head, joined)] = joined[0]
                on = np.flatnonzero(head != np.arange(len(doc)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[head[on]]), pa.array(doc[on])], ["a", "b"])

        dealt = self._blocks(rows, "band", F.col("n_band") / BLOCK_ROWS)
        return dealt.mapInArrow(compare, "a long, b long").distinct()

    def _across(self, candidates: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between different components: full sets of all that candidates connect, compared in blocks."""
        percent, shingle, total = self.percent, self.shingle, self.bands * self.band_rows
        steps = least_matches(percent / 100, total)
        groups = connected(candidates)
        groups = stored(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "candidate-groups")
        members = groups.select(F.col("node").alias("doc_id"), F.col("root").alias("group"))
        members = members.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        members = members.join(classes.select("doc_id", "n", "bytes"), "doc_id")
        members = stored(members, "candidate-members")
        sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n_group"), F.sum("n").alias("n_all"))
        sizes = stored(sizes, "candidate-sizes")
        texts = self.docs.join(members.select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        rows = join_groups(members, sizes, "group", "n_group", members.count()).join(texts, "doc_id")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in groups_of(batches, ["group", "low", "high"]):
                doc, n, bytes_ = part.column("doc_id").to_numpy(), part.column("n").to_numpy(), signatures(part.column("bytes"), total)
                sets = list(shingle_sets(part.column("text"), shingle))
                flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
                firsts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                mark = np.zeros(len(flat), bool)
                out_a, out_b = [], []
                for i, j in partners(part, percent):
                    j = j[within_bounds(np.broadcast_to(bytes_[i], (len(j), total)), bytes_[j], steps)]
                    if not len(j):
                        continue
                    mark[flat[firsts[i] : firsts[i + 1]]] = True
                    low = firsts[i + 1]
                    both = np.add.reduceat(mark[flat[low:]], firsts[i + 1 : -1] - low, dtype=np.int64)[j - i - 1]
                    mark[flat[firsts[i] : firsts[i + 1]]] = False
                    j = j[100 * both >= percent * (n[i] + n[j] - both)]
                    out_a.append(np.minimum(doc[i], doc[j]))
                    out_b.append(np.maximum(doc[i], doc[j]))
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_b)], ["a", "b"])

        weight = F.greatest(F.col("n_group") / BLOCK_ROWS, F.col("n_all") / BLOCK_SHINGLES)
        return stored(self._blocks(rows, "group", weight).mapInArrow(compare, "a long, b long"), "links-across")

    def _verified(self, near: DataFrame) -> DataFrame:
        """The pairs that are linked by their full sets."""
        percent, shingle = self.percent, self.shingle

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_text, last = None, None
            for batch in batches:
                keep = []
                texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
                for i in range(batch.num_rows):
                    text = texts_a[i].as_py()
                    if last is None or text != last_text:
                        last_text, last = text, next(shingle_sets(pa.array([text], pa.string()), shingle))
                    other = next(shingle_sets(texts_b.slice(i, 1), shingle))
                    both = len(np.intersect1d(last, other, assume_unique=True))
                    if 100 * both >= percent * (len(last) + len(other) - both):
                        keep.append(i)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        # One plan at every size: texts are shuffled once by id. A class's smallest id may stand
        # in several rows; all of them have its set.
        texts = stored(self.docs.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near-texts")
        sides = [texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b")]
        full = near.join(sides[1], "b").join(sides[0], "a")
        return stored(full.mapInArrow(verify, "a long, b long"), "links")

    def _size_fits(self, x: str, y: str):
        return (100 * F.least(x, y) >= self.percent * F.greatest(x, y))

    def components(self) -> DataFrame:
        """All rows with their set size, class (the smallest id with that set) and component."""
        rows = stored(self.features(), "features")
        usable = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
        members = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n_rows")), "classes")
        heads = members.select(F.col("class").alias("doc_id"))
        classes = stored(usable.join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"]).drop("digest"), "class-features")
        n_classes = classes.count()

        placed = classes.select("doc_id", "n", F.explode("keys").alias("band"))
        bands = placed.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count(F.lit(1)).alias("n_band"))
        bands = stored(bands.filter("n_band > 1"), "bands")
        in_band = join_groups(placed, bands, "band", "n_band", n_classes)
        star = in_band.filter((F.col("doc_id") != F.col("head.doc_id")) & self._size_fits("n", "head.n"))
        tried = stored(star.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), "star-pairs")
        links = self._verified(self._near(tried, classes))
        roots = connected(links)

        # Bands that still hold several components: pairs across components only.
        named = placed.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
        named = named.select("band", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
        named = stored(join_groups(named, bands.select("band", "n_band"), "band", "n_band", n_classes), "named")
        mixed = named.groupBy("band").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count(F.lit(1)).alias("n_band"))
        mixed = stored(mixed.filter("first < last").select("band", "n_band"), "mixed-bands")
        rest = join_groups(named.drop("n_band"), mixed, "band", "n_band", n_classes)
        rest = rest.join(classes.select("doc_id", "bytes"), "doc_id")
        more = self._across(self._candidates(rest), classes, roots)
        roots = connected(links.unionByName(more))

        heads = members.join(roots.withColumnRenamed("node", "class"), "class", "left")
        heads = stored(heads.select("digest", "n_rows", "class", F.coalesce("root", "class").alias("root")), "roots")
        linked = join_groups(usable.select("doc_id", "n", "digest"), heads, "digest", "n_rows", usable.count())
        alone = rows.filter((F.col("n") == 0) | F.col("doc_id").isNull())
        out = linked.select("doc_id", "n", F.col("root").alias("component_id"), "class")
        return out.unionByName(alone.select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class")))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes that links join to a smaller one; root is the smallest node of the component.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours, then its smaller ones, to the smallest node it knows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(both, larger=True)
        edges = _star(edges, larger=False)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count(F.lit(1)).alias("n_u")), "least")
    joined = join_groups(edges, least, "u", "n_u", edges.count())
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
    return stored(out.filter("u <> v").distinct(), "star")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id, doc_id AS root FROM d UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id WHERE r.root < u.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


@query("op5_near_dedup", SQL)
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NearDuplicates(documents(spark, sf_dir), percent=85, shingle=3).components()
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: five-word shingles, similarity 0.8 or more."""
    found = NearDuplicates(docs, percent=80, shingle=5, band_rows=5).components()
    dropped = found.filter("doc_id <> component_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti")
