"""Scores of texts under a hidden Markov language model.

Tokens are lower-cased words and one end per text. The ``frequent`` words are emitted as they are;
every other word is emitted as one of ``buckets`` classes made from its ending, and drawn within its
class by its count. The second factor does not depend on the state, so

    P(text) = forward probability of the classes * product over rare words of P(word | class)

is exact. Parameters are trained by Baum-Welch: every partition adds up the expected counts of its
texts, Spark sums them over partitions, and the driver, which holds nothing but the parameters,
normalises the sums. Scoring is the scaled forward recursion. In each task many texts take a step at
a time, texts of like length together, so memory is bounded by tokens and not by the longest text.

Word counts cover all training texts and live in a table. The ``head`` most frequent words, a fixed
number, are also sent to every task; the other words of a text meet their counts in a join, where
no key is frequent any more.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.sources.scratch import materialize


@dataclass(frozen=True)
class ModelSize:
    states: int = 6
    frequent: int = 4096
    buckets: int = 1024
    head: int = 131_072
    rounds: int = 4
    seed: int = 7

    @property
    def classes(self) -> int:
        """Frequent words, classes of other words, and the end."""
        return self.frequent + self.buckets + 1


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """True for ids whose crc32 as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def bucket(word: bytes, n: int) -> int:
    """Class of a word that is not frequent, from its last three bytes."""
    return zlib.crc32(word[-3:]) % n


# -------------------------------------------------------------------------------- word counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a one-column table of texts; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in batch.column(0).cast(pa.binary()):
                found.update(tokens(text.as_py()))
                if len(found) > 500_000:
                    yield rows(found)
                    found = Counter()
            yield rows(found)

    def rows(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
            names=["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(
        F.sum("c").alias("c"))


def _bucket_totals(counts: DataFrame, least: list, size: ModelSize) -> np.ndarray:
    """[bucket, (count, distinct)] over the words that are not frequent."""
    frequent = set(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((size.buckets, 2), np.int64)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                               strict=True):
                if word not in frequent:
                    totals[bucket(word, size.buckets)] += (c, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size.buckets, dtype=np.int32)), pa.array(totals[:, 0]),
             pa.array(totals[:, 1])], names=["b", "c", "v"])

    found = counts.mapInArrow(run, "b int, c long, v long").groupBy("b").agg(
        F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    totals = np.zeros((size.buckets, 2))
    for r in found:
        totals[r["b"]] = r["c"], r["v"]
    return totals


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the head words and totals: all that tasks need; its size is fixed by ModelSize."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    totals: np.ndarray  # per bucket: count, distinct words
    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int

    def base(self, c):
        """log10 of the smoothed unigram probability of a token with count ``c``."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def within(self) -> np.ndarray:
        """log10 of the denominator of P(word | class) for each bucket."""
        return np.log10(self.totals[:, 0] + 0.5 * (self.totals[:, 1] + 1))


def learn_vocabulary(counts: DataFrame, ends: int, size: ModelSize) -> Vocabulary:
    """``counts`` (word, c) must be stored; ``ends`` is the number of training texts.

    The head is all words from a count on, found from a histogram of counts in steps of a sixteenth
    of a power of two, so that no more than ``head`` words ever travel to the driver.
    """
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    step = F.floor(F.log2("c") * 16)
    room, least = size.head, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = counts.where(step >= least).collect() if least is not None else []
    top.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    words = tuple(bytes(r["word"]) for r in top)
    return Vocabulary(words, np.array([r["c"] for r in top], np.int64),
                      _bucket_totals(counts, words[:size.frequent], size),
                      (sums["n"] or 0) + ends, sums["v"] + (ends > 0), ends)


# -------------------------------------------------------------------------------- encoding


def encode(docs: DataFrame, vocabulary: Vocabulary, size: ModelSize) -> DataFrame:
    """(id, held_out, n_tokens, codes, base, within, known, rare, times, kinds) per row.

    ``codes`` are the classes of the tokens as 16-bit numbers. The sums ``base``, ``within`` and
    ``known`` cover the end and the head words; ``rare`` lists the other distinct words of the
    text, ``times`` how often each occurs and ``kinds`` its bucket.
    """
    if size.classes > 1 << 16:
        raise ValueError("classes are stored as 16-bit numbers")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        index = {w: i for i, w in enumerate(v.words)}
        kind = np.array([i if i < size.frequent else size.frequent + bucket(w, size.buckets)
                         for i, w in enumerate(v.words)] + [0], np.uint16)
        base = np.append(v.base(v.counts), 0.0)
        within = np.append(np.log10(v.counts + 0.5), 0.0)
        tail = kind[:-1] >= size.frequent
        within[:-1] = np.where(tail, within[:-1] - v.within()[
            np.where(tail, kind[:-1] - size.frequent, 0)], 0.0)
        end_base = float(v.base(v.ends))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield encoded(batch.slice(start, 1000), index, kind, base, within, end_base,
                              v.ends > 0)

    def encoded(batch, index, kind, base, within, end_base, end_known) -> pa.RecordBatch:
        out = {k: [] for k in ("n_tokens", "codes", "base", "within", "known", "rare", "times",
                               "kinds")}
        get = index.get
        for text in batch.column(2).cast(pa.binary()):
            words = tokens(text.as_py())
            found = np.array([get(w, -1) for w in words], np.int64)
            codes = np.append(kind[found], np.uint16(size.classes - 1))
            missing = np.flatnonzero(found < 0).tolist()
            rare: Counter[bytes] = Counter()
            for i in missing:
                word = words[i]
                rare[word] += 1
                codes[i] = size.frequent + bucket(word, size.buckets)
            out["n_tokens"].append(len(codes))
            out["codes"].append(codes.tobytes())
            out["base"].append(float(base[found].sum()) + end_base)
            out["within"].append(float(within[found].sum()))
            out["known"].append(len(words) - len(missing) + end_known)
            out["rare"].append(list(rare))
            out["times"].append(list(rare.values()))
            out["kinds"].append([bucket(w, size.buckets) for w in rare])
        types = (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64(),
                 pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             *[pa.array(c, t) for c, t in zip(out.values(), types, strict=True)]],
            names=["id", "held_out", *out])

    rows = docs.select(F.col("id"), F.col("held_out"), F.col("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, codes binary, "
                           "base double, within double, known long, rare array<binary>, "
                           "times array<int>, kinds array<int>")


# -------------------------------------------------------------------------------- the model


@dataclass(frozen=True)
class Parameters:
    start: np.ndarray  # [state]
    move: np.ndarray  # [state, next state]
    emit: np.ndarray  # [class, state]


def initial(vocabulary: Vocabulary, size: ModelSize) -> Parameters:
    """Class frequencies, disturbed differently for each state."""
    rng = np.random.default_rng(size.seed)
    freq = np.full(size.classes, 0.5)
    n = min(size.frequent, len(vocabulary.words))
    freq[:n] += vocabulary.counts[:n]
    freq[size.frequent:-1] += vocabulary.totals[:, 0]
    freq[-1] += vocabulary.ends
    emit = freq[:, None] * rng.uniform(0.2, 1.8, (size.classes, size.states))
    move = rng.uniform(0.5, 1.5, (size.states, size.states)) + 4 * np.eye(size.states)
    return Parameters(np.full(size.states, 1 / size.states),
                      move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _steps(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of texts of falling length, step by step: (codes, where each step begins, lengths)."""
    lengths = np.array([len(t) for t in texts])
    active = np.cumsum(np.bincount(lengths, minlength=lengths[0] + 1)[::-1])[::-1][1:]
    begins = np.concatenate(([0], np.cumsum(active)))
    codes = np.empty(begins[-1], np.int64)
    for i, t in enumerate(texts):
        codes[begins[:len(t)] + i] = t
    return codes, begins, lengths


def forward(texts: list[np.ndarray], p: Parameters, keep: bool = False):
    """log10 likelihood of each text (texts of falling length), by the scaled recursion.

    With ``keep``, also the codes, step bounds, scaled forward values and scales.
    """
    codes, begins, lengths = _steps(texts)
    log = np.zeros(len(texts))
    kept = np.empty((len(codes), len(p.start))) if keep else None
    scales = np.empty(len(codes)) if keep else None
    now = np.broadcast_to(p.start, (len(texts), len(p.start)))
    for t in range(lengths[0]):
        a, b = begins[t], begins[t + 1]
        now = (now if t == 0 else now[:b - a] @ p.move) * p.emit[codes[a:b]]
        scale = now.sum(1)
        now = now / scale[:, None]
        log[:b - a] += np.log10(scale)
        if keep:
            kept[a:b], scales[a:b] = now, scale
    return (log, codes, begins, kept, scales) if keep else log


def expected_counts(texts: list[np.ndarray], p: Parameters) -> np.ndarray:
    """[log10 likelihood, start counts, move counts, emit counts], flattened, of some texts."""
    log, codes, begins, alpha, scales = forward(texts, p, keep=True)
    states = len(p.start)
    last = len(begins) - 2
    gamma = np.empty_like(alpha)
    moves = np.zeros((states, states))
    back = np.ones((0, states))
    for t in range(last, -1, -1):
        a, b = begins[t], begins[t + 1]
        beta = np.ones((b - a, states))
        n = len(back)
        if n:
            c, d = begins[t + 1], begins[t + 2]
            ahead = p.emit[codes[c:d]] * back / scales[c:d, None]
            moves += alpha[a:a + n].T @ ahead
            beta[:n] = ahead @ p.move.T
        gamma[a:b] = alpha[a:b] * beta
        back = beta
    emit = np.stack([np.bincount(codes, gamma[:, k], len(p.emit)) for k in range(states)], 1)
    return np.concatenate(([log.sum()], gamma[:begins[1]].sum(0), (moves * p.move).ravel(),
                           emit.ravel()))


def _batches(codes: pa.Array, limit: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Texts of like length together, falling, at most about ``limit`` tokens at a time."""
    texts = [np.frombuffer(c, np.uint16) for c in codes.to_pylist()]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    part: list[int] = []
    total = 0
    for i in order:
        if part and total + len(texts[i]) > limit:
            yield part, [texts[j] for j in part]
            part, total = [], 0
        part.append(i)
        total += len(texts[i])
    if part:
        yield part, [texts[j] for j in part]


def train(codes: DataFrame, start: Parameters, size: ModelSize) -> tuple[Parameters, list[float]]:
    """Baum-Welch over a stored one-column table of codes; also the log10 likelihoods before each
    round. A round is one pass; what leaves it is one number per parameter and partition, summed
    by Spark."""
    p, seen = start, []
    for _ in range(size.rounds):
        sent = codes.sparkSession.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for _, texts in _batches(batch.column(0), 400_000):
                    found = expected_counts(texts, sent.value)
                    total = found if total is None else total + found
            if total is not None:
                index = np.flatnonzero(total).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total[index])],
                                                 names=["i", "x"])

        rows = codes.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
        total = np.zeros(1 + size.states * (1 + size.states + size.classes))
        for r in rows.collect():
            total[r["i"]] = r["x"]
        sent.unpersist()
        if not total.any():
            break
        seen.append(float(total[0]))
        cut = 1 + size.states
        begin = total[1:cut] + 0.01
        move = total[cut:cut + size.states ** 2].reshape(size.states, size.states) + 0.01
        emit = total[cut + size.states ** 2:].reshape(size.classes, size.states) + 0.01
        p = Parameters(begin / begin.sum(), move / move.sum(1, keepdims=True),
                       emit / emit.sum(0))
    return p, seen


def _forward_scores(rows: DataFrame, p: Parameters) -> DataFrame:
    """(key, path): log10 forward probability of the codes of each row (key, codes)."""
    sent = rows.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log = np.zeros(batch.num_rows)
            for part, texts in _batches(batch.column(1), 2_000_000):
                log[part] = forward(texts, sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log)],
                                             names=["key", "path"])

    return rows.select("key", "codes").mapInArrow(run, "key long, path double")


def score(docs: DataFrame, size: ModelSize = ModelSize(), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are one end. Without any training text all words are unknown and the
    model is the untrained one. Scores are log10 probabilities.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    training = rows.where("not held_out")
    counts = materialize(word_counts(training.select("text")), "word-counts")
    vocabulary = learn_vocabulary(counts, training.select("id").count(), size)
    coded = encode(rows, vocabulary, size).withColumn("key", F.monotonically_increasing_id())
    coded = materialize(coded, "coded-texts")
    model, _ = train(coded.where("not held_out").select("codes"), initial(vocabulary, size), size)
    path = _forward_scores(coded, model)

    # Words outside the head: every text's distinct ones meet their counts.
    rare = coded.where(F.size("rare") > 0).select("key", F.explode(F.arrays_zip(
        F.col("rare").alias("word"), F.col("times").alias("times"),
        F.col("kinds").alias("kind"))).alias("r")).select("key", "r.*")
    c = F.coalesce("c", F.lit(0))
    space = vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)
    within = F.lit([float(x) for x in vocabulary.within()])
    joined = rare.join(counts, "word", "left")
    sums = joined.groupBy("key").agg(
        F.sum(F.col("times") * F.log10((c + 0.5) / space)).alias("rare_base"),
        F.sum(F.col("times") * (F.log10(c + 0.5) - F.get(within, F.col("kind"))))
        .alias("rare_within"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = coded.select("key", "id", "held_out", "n_tokens", "base", "within", "known")
    out = out.join(path, "key").join(sums, "key", "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("path") + F.col("within") + F.coalesce("rare_within", zero)).alias("score"))
