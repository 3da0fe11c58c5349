"""SimHash components against plain fingerprints and all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tabweave.llm import QUERIES, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(5)


def some(n):
    return [f"w{RNG.randrange(400)}" for _ in range(n)]


def plain(text, size=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    pieces = [words[i : i + size] for i in range(len(words) - size + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Smallest id per row of (id, fingerprint), by all pairs."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}
    links = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= radius]
    before = None
    while before != root:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return [least.get(root[f]) for _, f in prints]


def texts():
    base = some(300)
    out = [None, "", " \t\r\n\x0b", "One", "one  TWO", "ONE two\nthree", "x" * 9000, "the the " * 300, " ".join(some(3000))]
    for _ in range(25):
        base = list(base)
        base[RNG.randrange(300)] = "changed"
        out.append("\t ".join(base))
    return out + [" ".join(base).upper(), " ".join(base)] + [" ".join(some(40)) for _ in range(10)]


def test_rows_match_brute_force(spark, tmp_path):
    rows = [*enumerate(texts()), (3, "one"), (None, "one two three"), (None, "quite alone here"), (1, "")]
    data = [(i, t, "clash", "clash", 1) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, fp string, root string, mask int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_simhash"](spark, str(tmp_path)).collect()
    prints = [(i, plain(t)) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(prints, components(prints), strict=True)]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_long_texts_in_blocks(monkeypatch):
    import pyarrow as pa

    column = pa.array([None, " ".join(some(900)), "a b", " ".join(some(64)), "c " * 500])
    whole = simhash.fingerprints(column, 4)
    monkeypatch.setattr(simhash, "SHINGLE_BLOCK", 16)
    assert (simhash.fingerprints(column, 4) == whole).all()
    assert whole.tolist() == [plain(t) for t in column.to_pylist()]


@pytest.mark.parametrize("radius", [1, 4])
def test_masks_cover_every_pair(radius):
    masks = simhash.cover(list(range(64)), radius)
    for _ in range(3000):
        differs = sum(1 << p for p in RNG.sample(range(64), radius))
        free = [m for m in masks if not m & differs]
        assert free and any(not w & differs for m in free for w in simhash.refined(m, radius))
    if radius == 4:
        assert max(64 - w.bit_count() for m in masks for w in simhash.refined(m, radius)) <= 16


def test_split_buckets(spark):
    """A dense group of fingerprints, with and without splitting its buckets."""
    prints = {0} | {RNG.getrandbits(64) for _ in range(40)}
    for _ in range(400):
        f = RNG.choice(sorted(prints))
        for p in RNG.sample(range(64), RNG.randint(1, 6)):
            f ^= 1 << p
        prints.add(f)
    values = sorted(prints)
    signed = [int(np.uint64(f).view(np.int64)) for f in values]
    want = components(list(zip(signed, values, strict=True)))
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.SimHash(spark.createDataFrame([], "doc_id long, text string"), 4, 4)
    for rows in (1 << 14, 3):
        links = found.links(classes, bucket_rows=rows)
        assert not links.filter("bit_count(a ^ b) > 4 or a = b").count()
        root = {r.node: r.root for r in simhash.connected(links).collect()}
        assert [root.get(f, f) for f in signed] == want
