import itertools
import math
import zlib
from collections import Counter

import numpy as np

from tenura.llm import hmm, queries

TINY = hmm.ModelSize(states=2, frequent=3, buckets=2, head=5, rounds=3)


def random_model(size, seed=1):
    rng = np.random.default_rng(seed)
    emit = rng.uniform(0.1, 1, (size.classes, size.states))
    move = rng.uniform(0.1, 1, (size.states, size.states))
    return hmm.Parameters(np.array([0.3, 0.7]), move / move.sum(1, keepdims=True),
                          emit / emit.sum(0))


def paths(text, p):
    """(states, probability) of every state path of one text."""
    for states in itertools.product(range(len(p.start)), repeat=len(text)):
        prob = p.start[states[0]] * p.emit[text[0], states[0]]
        for (a, b), c in zip(itertools.pairwise(states), text[1:], strict=True):
            prob *= p.move[a, b] * p.emit[c, b]
        yield states, prob


TEXTS = [np.array(t, np.uint16) for t in ([0, 1, 4, 2, 3, 0, 5], [1, 1, 3, 5], [2, 5], [2, 5], [5])]


def test_forward_equals_the_sum_over_all_paths():
    p = random_model(TINY)
    want = [math.log10(sum(prob for _, prob in paths(t, p))) for t in TEXTS]
    assert np.allclose(hmm.forward(TEXTS, p), want)


def test_expected_counts_equal_the_sum_over_all_paths():
    p = random_model(TINY)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((TINY.classes, 2))
    for t in TEXTS:
        total = sum(prob for _, prob in paths(t, p))
        for states, prob in paths(t, p):
            share = prob / total
            start[states[0]] += share
            for a, b in itertools.pairwise(states):
                move[a, b] += share
            for c, s in zip(t, states, strict=True):
                emit[c, s] += share
    got = hmm.expected_counts(TEXTS, p)
    assert np.allclose(got[1:], np.concatenate((start, move.ravel(), emit.ravel())))


def test_long_text_does_not_underflow():
    text = np.tile(np.array([0, 3, 1, 2], np.uint16), 50_000)
    p = random_model(TINY)
    one = hmm.forward([text[:4000]], p)[0]
    whole = hmm.forward([text], p)[0]
    assert math.isfinite(whole) and abs(whole / one - 50) < 0.01


def test_documents(spark, small):
    docs = {r.doc_id: r.text for r in
            spark.read.parquet(f"{small}/documents.parquet").collect()}
    words = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t in docs.items()}
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = Counter(w for i in docs if i not in out for w in [*words[i], None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op5_hmm(spark, small).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        own = [*words[i], None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            i in out, len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9
    better = [r.score > r.base_score for r in got.values() if r.held_out and r.n_tokens > 50]
    assert sum(better) > 0.8 * len(better) > 10


def test_scores_at_any_head_size_and_training(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    sizes = [hmm.ModelSize(states=3, frequent=50, buckets=16, head=h, rounds=2) for h in (50, 4000)]
    a, b = ({r.doc_id: r.score for r in hmm.score(docs, s).collect()} for s in sizes)
    assert all(abs(a[i] - b[i]) < 1e-6 * abs(a[i]) for i in a)
    rows = docs.selectExpr("doc_id id", "false held_out", "text")
    counts = hmm.word_counts(rows.select("text"))
    vocabulary = hmm.learn_vocabulary(counts, rows.count(), sizes[1])
    codes = hmm.encode(rows, vocabulary, sizes[1]).select("codes")
    _, seen = hmm.train(codes, hmm.initial(vocabulary, sizes[1]),
                        hmm.ModelSize(3, 50, 16, 4000, 5))
    assert len(seen) == 5 and all(x < y + 1 for x, y in itertools.pairwise(seen))


def test_edge_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(0, None, "x"), (2, "", "x"), (3, "A a\tb", "x"), (4, long, "x"), (4, long, "x"),
            (None, "a", "x"), (21, "never seen a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in hmm.score(docs).collect()]
    train = sum(n for i, n in ((0, 1), (2, 1), (3, 4), (4, 60_001), (4, 60_001), (None, 2), (21, 4))
                if i is None or zlib.crc32(str(i).encode()) % 5 != 1)
    assert {t for *_, t in got} == {train}
    assert sorted((i or -1, n) for i, n, *_ in got) == [
        (-1, 1), (-1, 2), (2, 1), (3, 4), (4, 60_001), (4, 60_001), (21, 4)]
    assert hmm.score(docs.limit(0)).count() == 0
    alone = hmm.score(docs.where("doc_id = 21")).first()
    assert math.isfinite(alone.score) and math.isfinite(alone.base_score)
