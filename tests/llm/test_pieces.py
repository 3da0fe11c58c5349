"""The parts of the corpus operators that need no Spark, against plain Python."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tabweave.llm import bpe, decontaminate, langid, near_dedup, shards, substrings, toxicity, urls
from tabweave.llm import text as tx

TEXTS = ["", "one", " two  Words\t", "ÀÉ the\x0bcat\x1cx", "a" * 5000, None, "x y z " * 300]


def plain_words(text, pattern=r"[^\x20\x09-\x0D]+", lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(pattern, text)


@pytest.mark.parametrize(
    ("table", "pattern"), [(tx.SPACED, r"[^\x20\x09-\x0D]+"), (tx.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]
)
def test_words(table, pattern, monkeypatch):
    monkeypatch.setattr(tx, "HASH_BYTES", 16)
    h, firsts = tx.words(pa.array(TEXTS), table, lower=True)
    want = [plain_words(t, pattern, lower=True) for t in TEXTS]
    assert np.diff(firsts).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) and len({*zip(h.tolist(), flat)}) == len(set(flat))


def test_complementary_words_differ():
    """Words for which a polynomial modulo 2**64 is equal, whatever its base."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    for n in (1024, 2048, 4096):
        pair = ["".join("ab"[b ^ flip] for b in bits[:n]) for flip in (0, 1)]
        h, _ = tx.words(pa.array(pair))
        assert h[0] != h[1]
        a, b = near_dedup.shingle_sets(pa.array(pair), 3)
        assert a[0] != b[0]


def test_runs_and_chunks():
    h, _ = tx.words(pa.array(["a b a b a b c"]))
    two = tx.runs(h, 2)
    assert two[0] == two[2] == two[4] and two[1] == two[3] and len(set(two.tolist())) == 3
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])
    assert [x for b in tx.chunks(iter([batch]), limit=10) for x in b.column("text").to_pylist()] == TEXTS


def test_suffix_automaton():
    rng = random.Random(5)
    for _ in range(150):
        window = rng.randint(1, 4)
        items = [(i, [rng.randint(0, 2) for _ in range(rng.randint(1, 8))]) for i in range(rng.randint(1, 4))]
        doc = [rng.randint(0, 3) for _ in range(25)]
        spans, found = set(), set()
        for item, words in items:
            size = min(window, len(words))
            for a, b in itertools.product(range(len(words) - size + 1), range(len(doc) - size + 1)):
                if words[a : a + size] == doc[b : b + size]:
                    spans |= set(range(b, b + size))
                    found.add(item)
        got, names = decontaminate.SuffixAutomaton.of(items, window).hits(doc)
        assert {p for a, b in got for p in range(a, b)} == spans and names == found


def test_posterior_bounds_and_bands():
    steps = near_dedup.least_matches(0.85, 180)
    assert [n for n, _ in steps][-1] == 180 and all(0 < m < n for n, m in steps[1:])
    b = near_dedup.bands_for(0.85)
    assert (1 - 0.85**near_dedup.BAND_ROWS) ** b <= near_dedup.MISS
    same = np.random.default_rng(1).integers(0, 256, (3, 180), np.uint8)
    other = np.roll(same, 1, axis=0)
    assert near_dedup.within_bounds(same, same, steps).tolist() == [0, 1, 2]
    assert not len(near_dedup.within_bounds(same, other, steps))


def test_shingle_sets():
    sets = list(near_dedup.shingle_sets(pa.array(["a b c d", "A b", None, " ", "a b c a b c", "a"]), 3))
    assert [len(s) for s in sets] == [2, 1, 0, 0, 3, 1]


def test_anchors_cover_every_window():
    rng = random.Random(3)
    words = [rng.choice("abc") * rng.randint(1, 2) for _ in range(300)]
    h, firsts = tx.words(pa.array([" ".join(words), " ".join(words[40:200])]))
    at, found = substrings.anchors(h, firsts, 10, 4)
    assert len(set(zip(at.tolist(), found.tolist()))) == len(at)
    chosen = set(at.tolist())
    for a, b in zip(firsts[:-1], firsts[1:]):
        for start in range(a, b - 9):
            assert any(p in chosen for p in range(start, start + 7))
    second = {p - firsts[1] + 40 for p in chosen if p >= firsts[1] + 10 and p < firsts[2] - 20}
    assert second <= chosen


def test_place_balances():
    rng = np.random.default_rng(2)
    v = np.column_stack([rng.pareto(2, 4000) * 100 + 20, rng.pareto(2, 4000) * 20 + 1, np.ones(4000)])
    at = shards.place(v, np.tile(v.sum(0) / 8, (8, 1)))
    for j in range(3):
        load = np.bincount(at, v[:, j], 8)
        assert load.max() / load.mean() < 1.1


def test_viterbi_split():
    counts = {"the": 50, "cat": 10, "sat": 5, "at": 30, "thec": 1}

    def cost(parts):
        return sum(np.log(counts[p] / 96) if p in counts else -np.log(96) - np.log(10) * len(p) for p in parts)

    for label in ("thecatsat", "xthe", "zzz", "atat", ""):
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(label)), k) for k in range(len(label) or 1))
        options = [[label[a:b] for a, b in zip([0, *c], [*c, len(label)])] for c in cuts] if label else [[]]
        assert np.isclose(cost(urls.best_split(label, counts, 96.0)), max(map(cost, options)))


def test_forward_backward(monkeypatch):
    monkeypatch.setattr(langid, "SEGMENT", 3)
    rng = np.random.default_rng(4)
    scores, t = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    numbers, firsts = rng.integers(0, 6, 13), np.array([0, 7, 7, 8, 13])
    p = langid.marginals(scores, t, numbers, firsts)[0]
    for a, b in zip(firsts[:-1], firsts[1:]):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=int(b - a)):
            if path:
                s = sum(scores[numbers[a + i], y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:]))
                for i, y in enumerate(path):
                    want[i, y] += np.exp(s)
        if b > a:
            assert np.allclose(p[a:b], want / want.sum(1, keepdims=True))


def test_language_memory_and_blocks(monkeypatch):
    """Blocks change no features and no distributions; what is held beside the words' features follows the block, not the batch."""
    rng = np.random.default_rng(8)
    letters = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    letters[rng.random(len(letters)) < 0.15] = 32
    text = letters.tobytes().decode()
    texts = pa.array(["", *(text[i : i + 4000] for i in range(0, len(text), 4000)), None, "1 2", "ab " * 40_000])
    model = langid.Model(["x", "y"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.eye(2))
    tracemalloc.start()
    words = langid.words_of(texts)
    n, means = np.diff(words.firsts), np.zeros((len(texts), 2))
    for a, firsts, mean, _ in langid.distributions(model, words):
        assert np.diff(firsts).tolist() == n[a : a + len(mean)].tolist()
        means[a : a + len(mean)] = mean
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * words.features.nbytes / 4
    p = langid.marginals(model.scores(words), model.transitions, words.numbers, words.firsts)[0]
    assert np.allclose(means, [p[a:b].sum(0) / max(b - a, 1) for a, b in itertools.pairwise(words.firsts)])

    monkeypatch.setattr(langid, "FEATURE_BYTES", 1 << 30)
    whole = langid.words_of(texts)
    for name in ("features", "feature_starts", "numbers", "firsts"):
        assert np.array_equal(getattr(words, name), getattr(whole, name))
    monkeypatch.setattr(langid, "FEATURE_BYTES", 5)
    monkeypatch.setattr(langid, "BLOCK_WORDS", 2)
    for column in (pa.array(["", None, "12"]), pa.array([], pa.string()), pa.array(["a", "", "bc de f", None, "g" * 9])):
        words = langid.words_of(column)
        assert len(words.feature_starts) == len(set(words.numbers.tolist())) + 1
        found = [(a + i, int(b - c)) for a, firsts, _, _ in langid.distributions(model, words) for i, (c, b) in enumerate(itertools.pairwise(firsts))]
        assert {i: k for i, k in found if k} == {i: k for i, k in enumerate(np.diff(words.firsts).tolist()) if k}


def test_tokenizer_matches_the_library():
    import public_tokenizers as public
    import tiktoken

    own = bpe.Tokenizer(public.path(bpe.RANKS), public.PATTERN)
    library = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", "it's  <|endoftext|>\n\n 12", "ab" * 900, "éèß" * 300, "\x1c\x85  x"]
    texts += ["".join(chr(rng.choice([32, 10, 39, rng.randint(33, 126), rng.randint(160, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(200)) for _ in range(60)]
    packed = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == [library.encode_ordinary(t) for t in texts]
    assert [x.decode() for x in own.decode(packed)] == texts
    word = "".join(rng.choice("etaoin") for _ in range(400)).encode()
    assert own.merge_long(word).tolist() == np.frombuffer(own.merge([word])[0], "<u4").tolist() == library.encode_ordinary(word.decode())


def test_excerpts_are_bounded_and_from_all_over():
    text = " ".join(f"word{i}x" for i in range(9000))
    got = langid.excerpt(text, 5000)
    words = got.split(" ")
    assert 4000 < len(got) <= 5000 and set(words) <= set(text.split(" ")) and got == langid.excerpt(text, 5000)
    at = [int(w[4:-1]) for w in words]
    assert at == sorted(at) and len({i // 1500 for i in at}) == 6
    assert langid.excerpt("a b", 5000) == "a b" and langid.excerpt("1 " * 9000 + "é", 5000).endswith("é")
    assert len(langid.excerpt("字" * 20_000, 5000)) > 4000


def test_long_pieces_within_the_memory_limit():
    """Many distinct pieces just below LONG_BYTES, and more ids than one decoding query can hold."""
    import public_tokenizers as public
    import tiktoken

    own = bpe.Tokenizer(public.path(bpe.RANKS), public.PATTERN)
    library = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(9)
    text = " ".join("".join(chr(rng.randint(0x0E01, 0x0E30)) for _ in range(170)) for _ in range(400))
    packed = own.encode([text, "between", text[:5000]])
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == [library.encode_ordinary(t) for t in (text, "between", text[:5000])]
    times = 4_000_000 // (len(packed[0]) // 4) + 1
    assert own.decode([packed[1], packed[0] * times, packed[2], b""]) == [b"between", text.encode() * times, text[:5000].encode(), b""]


def test_non_negative_risk_slope():
    rng = np.random.default_rng(8)
    for shift in (-4.0, 4.0):
        f = rng.normal(size=12) + np.r_[np.full(5, -shift), np.full(7, shift)]

        def risk(f, p=5, prior=0.3):
            late = np.logaddexp(0, f[p:]).mean() - prior * np.logaddexp(0, f[:p]).mean()
            return prior * np.logaddexp(0, -f[:p]).mean() + max(0.0, late)

        for i in range(12):
            step = np.eye(12)[i] * 1e-6
            assert np.isclose((risk(f + step) - risk(f - step)) / 2e-6, toxicity.risk_slope(f, 5, 0.3)[i], atol=1e-5)
