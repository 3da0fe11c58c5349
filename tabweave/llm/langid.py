"""Language identification of words by a linear-chain conditional random field.

Every word gets a language. A word's score for each language sums weights of its
prefixes and suffixes, its byte n-grams and the word itself (the lexicon), all
hashed into BUCKETS. Learned transitions tie neighbours together. Forward-backward
gives each word's marginals, over whole texts; their mean over a text's words is
the text's distribution.

Only document languages are known, so every word of a training document carries
its document's language. To show switches to the model, stretches of documents in
different languages are also interleaved. The model learns from about
SAMPLE_DOCS documents a language, chosen by a hash of the id. Of a document of
more than SAMPLE_CHARS characters it takes stretches from all over the text,
chosen by a hash, that come to at most SAMPLE_CHARS; that bounds what reaches the
driver without leaving long documents out.

Words are stretches of ASCII letters and of bytes above 0x7F, lower-cased within
Latin-1. Null texts and texts without a letter are ``und`` with score 0. With no
training rows every text is ``und``. Rows without id are predicted, but never
learned from. Repeated rows get the same answer each. Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm import text as tx
from tabweave.llm.base import query
from tabweave.llm.frames import documents

BUCKETS = 1 << 18
SAMPLE_DOCS = 250
SAMPLE_CHARS = 8_000
EXCERPT_CHARS = 250
SEGMENT = 32
STEPS = 20
BLOCK_WORDS = 1 << 15
FEATURE_BYTES = 1 << 16
RATE = 0.25
RIDGE = 1e-6
STRETCH = 25
#: Code-switched texts are fine; one in which no language holds this share of the words is rejected by the pipeline.
MIN_SCORE = 0.3
UNKNOWN = "und"

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters of Latin-1 lower-cased."""
    out = tx.LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


@dataclasses.dataclass
class Words:
    """Distinct words of some texts as hashed features, and the texts as sequences of word numbers."""

    features: np.ndarray
    feature_starts: np.ndarray
    numbers: np.ndarray
    firsts: np.ndarray


def features_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each word, flat, and each word's first feature (one more at the end)."""
    n = ends - starts
    width = n + 2  # with a mark at both ends
    first = np.cumsum(width) - width
    flat = np.full(int(width.sum()), 1, np.uint64)
    flat[_counted(first + 1, n)] = data[_counted(starts, n)]
    at = np.arange(len(flat))
    word = np.repeat(np.arange(len(n)), width)
    end = np.repeat(first + width, width)
    kinds, owners = [], []
    for size in (2, 3, 4):
        usable = np.flatnonzero(at + size <= end)
        h = np.zeros(len(usable), np.uint64)
        for j in range(size):
            h = h * np.uint64(257) + flat[usable + j]
        kinds.append(tx.mix(h + np.uint64(size << 56)))
        owners.append(word[usable])
    for size in (1, 3, 5):
        for kind, (a, b) in enumerate(((starts, np.minimum(starts + size, ends)), (np.maximum(ends - size, starts), ends))):
            kinds.append(tx.mix(tx.hashes_any(data, a, b) + np.uint64(100 + 2 * size + kind)))
            owners.append(np.arange(len(n)))
    kinds.append(tx.mix(whole + np.uint64(99)))
    owners.append(np.arange(len(n)))
    owner, h = np.concatenate(owners), np.concatenate(kinds)
    order = np.argsort(owner, kind="stable")
    return (h[order] & np.uint64(BUCKETS - 1)).astype(np.int32), np.searchsorted(owner[order], np.arange(len(n) + 1))


def _counted(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[i] numbers counted up from starts[i], for all i one after another."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def words_of(column) -> Words:
    data, offsets = tx.buffers(column)
    data = folded(data)
    starts, ends, firsts = tx.spans(data, offsets, LETTERS)
    h = tx.hashes(data, starts, ends)
    whole, one, numbers = np.unique(h, return_index=True, return_inverse=True)
    starts, ends = starts[one], ends[one]
    # The arrays behind the features are some hundred times as large as the words, so these are taken in blocks.
    size = np.cumsum(ends - starts)
    cuts = np.searchsorted(size, np.arange(FEATURE_BYTES, size[-1] if len(size) else 0, FEATURE_BYTES))
    cuts = np.unique(np.concatenate([[0], cuts, [len(size)]]))
    parts = [features_of(data, starts[a:b], ends[a:b], whole[a:b]) for a, b in itertools.pairwise(cuts)]
    features = np.concatenate([np.empty(0, np.int32), *(x for x, _ in parts)])
    n = np.concatenate([np.zeros(1, np.int64), *(np.diff(x) for _, x in parts)])
    return Words(features, np.cumsum(n), numbers, firsts)


@dataclasses.dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Log potential of each distinct word for each language."""
        return word_sums(self.weights, words)


def word_sums(weights: np.ndarray, words: Words) -> np.ndarray:
    if not len(words.features):
        return np.zeros((0, weights.shape[1]))
    columns = [np.add.reduceat(weights[words.features, k], words.feature_starts[:-1]) for k in range(weights.shape[1])]
    return np.stack(columns, 1).astype(np.float64)


def forward_backward(e: np.ndarray, t: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward and backward vectors of each position; ``e`` and ``t`` are potentials.

    Sequences are cut into segments that advance together: first each segment's
    transfer matrix, then the vectors that enter the segments of a sequence, then
    all positions. Returns alpha, beta and whether a position starts a sequence.
    """
    size = e.shape[1]
    lengths = np.diff(firsts)
    parts = -(-lengths // SEGMENT)
    seq = np.repeat(np.arange(len(lengths)), parts)
    rank = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = firsts[:-1][seq] + rank * SEGMENT
    length = np.minimum(firsts[1:][seq] - low, SEGMENT)
    starts = rank == 0
    m = np.tile(np.eye(size), (len(seq), 1, 1))
    # The start of a sequence has no transition before it.
    first_t = np.where(starts[:, None, None], np.eye(size), t)
    for k in range(SEGMENT):
        on = np.flatnonzero(length > k)
        if not len(on):
            break
        step = m[on] @ (first_t[on] if k == 0 else t) * e[low[on] + k][:, None, :]
        m[on] = step / step.sum((1, 2), keepdims=True)
    enter, leave = np.full((len(seq), size), 1.0 / size), np.full((len(seq), size), 1.0 / size)
    last = np.cumsum(parts) - 1
    for k in range(1, int(parts.max(initial=0))):
        on = np.flatnonzero(parts > k)
        at = last[on] - parts[on] + 1 + k
        v = np.einsum("ni,nij->nj", enter[at - 1], m[at - 1])
        enter[at] = v / v.sum(1, keepdims=True)
        at = last[on] - k
        v = np.einsum("nij,nj->ni", m[at + 1], leave[at + 1])
        leave[at] = v / v.sum(1, keepdims=True)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    v = enter
    for k in range(SEGMENT):
        on = np.flatnonzero(length > k)
        if not len(on):
            break
        moved = v[on] @ t if k else np.where(starts[on, None], v[on], v[on] @ t)
        moved = moved * e[low[on] + k]
        v = v.copy()
        v[on] = alpha[low[on] + k] = moved / moved.sum(1, keepdims=True)
    v = leave
    for k in range(SEGMENT - 1, -1, -1):
        on = np.flatnonzero(length > k)
        if not len(on):
            continue
        v = v.copy()
        beta[low[on] + k] = v[on]
        moved = (v[on] * e[low[on] + k]) @ t.T
        v[on] = moved / moved.sum(1, keepdims=True)
    begins = np.zeros(len(e), bool)
    begins[firsts[:-1][lengths > 0]] = True
    return alpha, beta, begins


def marginals(scores: np.ndarray, transitions: np.ndarray, numbers: np.ndarray, firsts: np.ndarray):
    """Language distribution of each position, and alpha, beta, potentials and sequence starts."""
    e = np.exp(scores - scores.max(1, keepdims=True)).clip(1e-30)[numbers]
    t = np.exp(transitions - transitions.max())
    alpha, beta, begins = forward_backward(e, t, firsts)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), alpha, beta, e, t, begins


def text_blocks(firsts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that come to about BLOCK_WORDS words, or one text that is longer."""
    cuts = np.searchsorted(firsts, np.arange(0, firsts[-1], BLOCK_WORDS))
    return itertools.pairwise(np.unique(np.append(cuts, len(firsts) - 1)).tolist())


def distributions(model: Model, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks of texts: number of the first, first word of each (one more at the end), languages of each and of its words."""
    scores = model.scores(words)
    for a, b in text_blocks(words.firsts):
        firsts = words.firsts[a : b + 1] - words.firsts[a]
        numbers = words.numbers[words.firsts[a] : words.firsts[b]]
        p = marginals(scores[numbers], model.transitions, np.arange(len(numbers)), firsts)[0]
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
        yield a, firsts, (total[firsts[1:]] - total[firsts[:-1]]) / np.maximum(np.diff(firsts), 1)[:, None], p


def train(texts: list[str], langs: list[str]) -> Model:
    """Maximum likelihood by Adam on whole batches."""
    names = sorted(set(langs))
    words = words_of(pa.array(texts, pa.string()))
    label = np.array([names.index(x) for x in langs], np.int64)
    y = np.repeat(label, np.diff(words.firsts))
    numbers, firsts = words.numbers, words.firsts
    if len(names) > 1:
        # The same words once more, stretches of all languages in turn.
        row = tx.row_of(firsts)
        place = np.arange(len(row)) - firsts[row]
        stretch = tx.mix((row * (1 << 32) + place // STRETCH).astype(np.uint64))
        turn = np.lexsort((place, stretch))
        numbers, y = np.concatenate([numbers, numbers[turn]]), np.concatenate([y, y[turn]])
        cuts = np.arange(0, len(turn), 20 * STRETCH)
        firsts = np.concatenate([firsts[:-1], len(row) + cuts, [len(numbers)]])
    size, n = len(names), max(len(numbers), 1)
    w, t = np.zeros((BUCKETS, size), np.float32), np.zeros((size, size))
    state = [np.zeros_like(x) for x in (w, w, t, t)]
    types = len(words.feature_starts) - 1
    repeats = np.diff(words.feature_starts)
    # Sequences are worked on in blocks, so memory follows BLOCK_WORDS and not the sample.
    blocks = list(text_blocks(firsts))
    for step in range(1, STEPS + 1 if len(numbers) else 1):
        scores, per_word, grad_t = word_sums(w, words), np.zeros((types, size)), np.zeros((size, size))
        for a, b in blocks:
            low, high = firsts[a], firsts[b]
            own, labels = numbers[low:high], y[low:high]
            p, alpha, beta, e, potentials, begins = marginals(scores, t, own, firsts[a : b + 1] - low)
            miss = -p
            miss[np.arange(len(labels)), labels] += 1
            for k in range(size):
                per_word[:, k] += np.bincount(own, miss[:, k], types)
            inner = np.flatnonzero(~begins)
            eb = e[inner] * beta[inner]
            before = alpha[inner - 1]
            z = ((before @ potentials) * eb).sum(1, keepdims=True)
            seen = np.bincount(labels[inner - 1] * size + labels[inner], minlength=size * size).reshape(size, size)
            grad_t += seen - potentials * (before.T @ (eb / z))
        grad_w = np.stack([np.bincount(words.features, np.repeat(per_word[:, k], repeats), BUCKETS) for k in range(size)], 1) / n - RIDGE * w
        grad_t = grad_t / n - RIDGE * t
        for x, g, a, b in ((w, grad_w, state[0], state[1]), (t, grad_t, state[2], state[3])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(x.dtype)
    return Model(names, w, t)


def excerpt(text: str, max_chars: int = SAMPLE_CHARS, size: int = EXCERPT_CHARS) -> str:
    """``text``, or if it is longer than ``max_chars``, stretches with letters from all over it that are not.

    Stretches begin and end between words, unless that leaves no letter.
    """
    if len(text) <= max_chars:
        return text
    places = np.arange(-(-len(text) // size), dtype=np.uint64)
    seed = tx.mix(np.array([zlib.crc32(text.encode())], np.uint64))
    chosen: list[tuple[int, str]] = []
    for i in np.argsort(tx.mix(places + seed), kind="stable").tolist():
        part = text[i * size : (i + 1) * size]
        inner = re.search(r"\s(.*)\s", part, re.DOTALL)
        if inner and has_letter(inner[1]):
            part = inner[1]
        if has_letter(part):
            chosen.append((i, part))
            if len(chosen) >= max_chars // (size + 1):
                break
    return " ".join(part for _, part in sorted(chosen))


def fit(docs: DataFrame, usable: Column, per_lang: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of the languages in ``docs`` rows that are ``usable``."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None
    share = F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, per_lang / r.n)))))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(chance < share[F.col("lang")]).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            texts = pa.array([excerpt(x, max_chars) for x in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column("lang")], ["text", "lang"])

    sample = chosen.mapInArrow(cut, chosen.schema).orderBy("lang", "text").toPandas()
    return train(sample.text.tolist(), sample.lang.tolist()) if len(sample) else None


def predict(docs: DataFrame, model: Model | None, keep: list[str], runs: bool = False, prefix: str = "") -> DataFrame:
    """Columns ``keep``, the language of the whole text and its score; with ``runs`` also the words' languages.

    The languages of words come as stretches (lang, n_words). ``prefix`` goes before the added names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = max(len(model.langs), 1) if model else 1
    limit = max(1 << 16, (4 << 20) * 16 // max(16, size * size))
    added = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())]
    if runs:
        stretch = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.IntegerType())])
        added.append(T.StructField(f"{prefix}word_langs", T.ArrayType(stretch)))
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])
    run_type = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in tx.chunks(batches, limit=limit):
            texts = batch.column("text")
            preds, scores, stretches = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), [[]] * batch.num_rows
            words = words_of(texts)
            if own and len(words.numbers):
                for a, firsts, mean, p in distributions(own, words):
                    best, labels = mean.argmax(1), p.argmax(1)
                    for i in np.flatnonzero(np.diff(firsts)).tolist():
                        if has_letter(texts[a + i].as_py()):
                            preds[a + i], scores[a + i] = own.langs[best[i]], min(1.0, float(mean[i, best[i]]))
                            if runs:
                                stretches[a + i] = run_lengths(labels[firsts[i] : firsts[i + 1]], own.langs)
            columns = [*(batch.column(c) for c in keep), pa.array(preds), pa.array(scores)]
            if runs:
                columns.append(pa.array(stretches, run_type))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def run_lengths(labels: np.ndarray, names: list[str]) -> list[dict]:
    """Stretches of words in one language."""
    cuts = np.flatnonzero(np.diff(labels, prepend=-1))
    return [{"lang": names[labels[a]], "n_words": int(b - a)} for a, b in zip(cuts, [*cuts[1:], len(labels)], strict=True)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    model = fit(docs, F.col("doc_id").isNotNull() & ~F.col("held_out"))
    return predict(docs, model, ["doc_id", "held_out"])


def lettered(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            yield batch.filter(pa.array([has_letter(x or "") for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or no language that holds MIN_SCORE of the words.

    Without any known language only those without a letter are dropped.
    """
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    if model is None:
        return lettered(docs)
    prefix = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so that none clashes
    named = predict(docs, model, docs.columns, prefix=prefix)
    return named.filter((F.col(f"{prefix}lang_pred") != UNKNOWN) & (F.col(f"{prefix}score") >= MIN_SCORE)).select(*docs.columns)
