"""Prefix tries and structure repair against plain versions."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabweave.llm import QUERIES, prefix_trie, repair

RNG = random.Random(3)


def batches(columns, schema, size):
    table = pa.table([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], list(schema))
    return table.to_batches(max_chunksize=size)


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5000])
def test_slots_are_minimal_and_verified(n):
    digests = np.frombuffer(RNG.randbytes(16 * n), np.uint64).reshape(-1, 2)
    table = prefix_trie.NodeTable(digests)
    assert sorted(table.find(digests)) == list(range(n))
    other = np.frombuffer(RNG.randbytes(16 * 400), np.uint64).reshape(-1, 2)
    assert (table.find(other) == -1).all()


def test_equal_digests_are_an_error():
    digests = np.ones((2, 2), np.uint64)
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(digests)
    schema = {"conv_id": pa.int64(), "depth": pa.int64(), "digest": pa.binary(), "parent": pa.binary(), "key": pa.binary(), "words": pa.int64(), "is_end": pa.bool_()}
    rows = [[1, 2], [1, 1], [b"d" * 16] * 2, [prefix_trie.ROOT] * 2, [b"one", b"two"], [1, 1], [True, True]]
    with pytest.raises(ValueError):
        list(prefix_trie.counted(iter(batches(rows, schema, 10))))


def test_sums_over_cut_shards():
    """Long and short conversations in shards of any size have the sums of one shard."""
    rows = []
    for conv, n in enumerate([40, 3, 25, 0, 7, 25]):
        digest, chain = prefix_trie.ROOT, []
        for depth in range(n + 1):
            parent = None if depth == 0 else digest
            if depth:
                digest = hashlib.blake2b(digest + bytes([0 if depth < 4 else conv]), digest_size=16).digest()
            chain.append((conv, depth, digest, parent, RNG.randrange(9), depth % 2, 1))
        rows += chain[::-1]
    schema = {"conv_id": pa.int64(), "depth": pa.int64(), "digest": pa.binary(), "parent": pa.binary(), "saved": pa.int64(), "leaves": pa.int64(), "own": pa.int64()}

    def sums(shard_rows, batch_rows):
        out = defaultdict(lambda: np.zeros(3, int))
        for b in prefix_trie.accumulated(iter(batches(list(zip(*rows, strict=True)), schema, batch_rows)), shard_rows):
            for digest, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out[digest] += values
        return {k: v.tolist() for k, v in out.items()}

    whole = sums(10**6, 1000)
    saved = sum(r[4] for r in rows)
    assert whole[prefix_trie.ROOT][:2] == [saved, sum(r[5] for r in rows)]
    for shard_rows, batch_rows in ((1, 1), (5, 3), (16, 50), (60, 7)):
        assert sums(shard_rows, batch_rows) == whole


def test_ids_hashed_in_chunks():
    ids = {b"a" * 16: list(range(9)), b"b" * 16: [-4, 7], b"c" * 16: [1]}
    flat = [(d, i) for d, x in ids.items() for i in x]
    chunks = list(prefix_trie.listed(iter(batches(list(zip(*flat, strict=True)), {"digest": pa.binary(), "conv_id": pa.int64()}, 4)), 4))
    assert sum(b.num_rows for b in chunks) > 3
    got = {d: h for b in prefix_trie.hashed(iter(chunks)) for d, h in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {d: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for d, x in ids.items()}


def test_trie_without_rebuilding(spark):
    """The operator itself, over conversations as they are, against nested dictionaries."""
    data = [(c, t, RNG.choice(["user", "bot"]), RNG.choice(["Yes.", "no no", ""])) for c in range(60) for t in range(RNG.randint(1, 6))]
    turns = prefix_trie.turn_rows(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    from pyspark.sql import functions as F

    got = prefix_trie.PrefixTrie(turns.withColumn("part", F.lit(0))).nodes().collect()
    paths = defaultdict(list)
    for c, _, role, text in data:
        paths[c].append((role, text))
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    leaf = lambda p: not any(len(q) == len(p) + 1 for q in below(p))
    cost = lambda p: (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0
    want = sorted(
        (min(m), len(p), len(m), sum(len(q) == len(p) + 1 for q in below(p)), sum(map(leaf, below(p))), sum(map(cost, below(p)))) for p, m in members.items()
    )
    assert sorted((r.conv_id, r.depth, r.n_convs, r.children, r.leaves, r.saved) for r in got) == want


def dijkstra(kinds):
    """Least (cost, audit) by searching edits one after another."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(kinds) and state in (0, 3):
            return cost, audit
        steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
        for letter, to in steps.items():
            if letter != "s":
                heapq.heappush(heap, (cost + 5, audit + "I", i, to))
            if i < len(kinds) and kinds[i] != "d":
                extra = 5 * kinds[i].isupper()
                if letter == kinds[i].lower():
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to))
                if letter != "s":
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, to))
        if i < len(kinds):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))


def test_cheapest_edits():
    assert repair.cheapest("") == (0, "")
    for n in [*range(1, 9)] * 150 + [90, 203]:
        kinds = "".join(RNG.choice("suaxSUAXd") for _ in range(n))
        assert repair.cheapest(kinds) == dijkstra(kinds), kinds
        cost, audit = repair.cheapest(kinds)
        assert sum(a != "I" for a in audit) == n
        assert "".join(repair.roles(audit)).replace("ua", "") in ("", "s")


def test_repaired_rows(spark):
    rows = [(1, 1, "user", "Hi.", 1), (1, 2, "user", "Hi.", 2), (1, 3, "bot", "Well.", 1), (2, 0, "system", "Be good.", 1), (2, None, "assistant", "Yes.", 1), (3, 1, "user", " ", 3), (4, 4, "user", "x.", 0)]
    found = repair.Repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, times long"))
    audits = found.audits()
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    assert got[4] == (0, 0, 0, 0, 0, 0, "") and got[3] == (0, 3, 0, 0, 2, 6, "DDD")
    assert got[1] == (0, 0, 2, 0, 3, *dijkstra("uddx")) and got[2] == (0, 0, 0, 0, 1, *dijkstra("as"))
    out = sorted(map(tuple, found.repaired(audits).collect()))
    assert out == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Well."), (2, 0, "user", "Yes."), (2, 1, "assistant", "Be good.")]


def test_common_conversations(spark, tmp_path):
    """A third of all conversations are equal, one has most of the rows, and rows repeat."""
    data = [(c, t, ("user", "assistant")[t % 2], f"Line {t}.") for c in range(300) for t in range(4)]
    data += [(901, t, ("user", "assistant")[t % 2], f"Long {t % 50}") for t in range(3000)] + [(902, 1, "user", "Again.")] * 500
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    trie = QUERIES["op12_prefix_trie"](spark, str(tmp_path)).toPandas()
    assert trie.n_convs.max() == 302 and trie[trie.depth == 0].n_children.tolist() == [3]
    top = trie[(trie.depth == 4) & (trie.n_convs == 300)].iloc[0]
    assert top.ends_sha256 == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    fixed = QUERIES["op13_repair"](spark, str(tmp_path)).toPandas().set_index("conv_id")
    times = {0: 0, 3: 1000}.get(zlib.crc32(b"902:1") % 20, 500)
    want = dijkstra("d" * times if zlib.crc32(b"902:1") % 20 == 1 else ("u" + "d" * (times - 1)) * (times > 0))
    assert len(fixed) == 302 and tuple(fixed.loc[902, ["cost", "audit"]]) == want
