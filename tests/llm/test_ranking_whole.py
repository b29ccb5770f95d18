"""The whole ranking against plain Python: features by characters, a plain descent, a sorted cut."""

import re
import zlib

import numpy as np
import pytest

from tenura.llm import ranking


def features(text):
    data = (text or "").encode()
    # One character per byte, so that classes and lengths are those of the bytes.
    chars = data.decode("latin-1")
    words = re.split(r"[ \t\n\r\x0b\x0c]+", chars)
    words = [w for w in words if w]
    if not words:
        return [0.0] * 20
    lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    lines = [x for x in chars.split("\n") if re.search(r"[^ \t\n\r\x0b\x0c]", x)]
    n, size = len(words), len(chars)

    def share(keep):
        return sum(map(keep, chars)) / size

    def ends(line, marks):
        return re.sub(r"[ \t\n\r\x0b\x0c]+$", "", line)[-1] in marks

    bare = [w for w in words if set(w) <= set("#*$%&|<>")]
    tails = [w for w in words if re.search(r"[^#*$%&|<>!][#*$%&|<>!]{2,}$", w)]
    caps = re.findall(r"(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])", chars)
    known = {w.decode("latin-1") for w in ranking.FUNCTION_WORDS}
    return [
        np.log(1 + n), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n,
        sum(len(w) <= 2 for w in words) / n, share(lambda c: "A" <= c <= "Z"),
        share(lambda c: "0" <= c <= "9"), share(lambda c: c in "#*$%&|<>"),
        share(lambda c: c in ".,;:!?"), share(lambda c: "a" <= c <= "z"),
        share(lambda c: c >= "\x80"), sum(w in known for w in lower) / n,
        len(set(lower)) / n ** 0.8, sum(lower[i] == lower[i - 1] for i in range(1, n)) / n,
        len(set(lines)) / len(lines), np.log(1 + size / len(lines)), len(bare) / n, len(caps) / n,
        sum(ends(x, ".!?") for x in lines) / len(lines), len(tails) / n,
        max(lower.count(w) for w in set(lower)) / n]


def descend(z, ridge):
    """Weights of least logistic loss on differences ``z`` by steps that halve until they help."""
    w = np.zeros(z.shape[1])

    def loss(w):
        return np.logaddexp(0, -(z @ w)).sum() + ridge * (w @ w) / 2

    scale = 1 / ((z ** 2).sum(0) / 4 + ridge)
    moment, last, t = w.copy(), w.copy(), 1.0
    step = 1.0
    for _ in range(20_000):
        slope = ridge * moment - z.T @ (1 / (1 + np.exp(z @ moment)))
        if np.abs(slope).max() < 1e-7:
            break
        here = loss(moment)
        while loss(moment - step * scale * slope) > here - step * (slope * scale) @ slope / 2 + 1e-12:
            step /= 2
        w = moment - step * scale * slope
        if slope @ (w - last) > 0:
            t = 1.0
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moment = w + (t - 1) / following * (w - last)
        last, t = w, following
    return moment


def test_scores_and_decisions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    training = ranking.Training()
    got = {r.doc_id: r for r in ranking.score(docs, labels, training).collect()}

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    x = {i: np.array(features(t)) for i, t in texts.items()}
    good = {r.doc_id: r.quality for r in labels.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    learned = [i for i in texts if not held[i] and good.get(i) is not None]
    sides = [np.array(sorted(tuple(x[i]) for i in learned if good[i] == k)) for k in (1, 0)]
    both = np.concatenate(sides)
    center, scale = both.mean(0), both.std(0)
    scale[scale == 0] = 1

    def scaled(rows):
        return np.clip((rows - center) / scale, -6, 6)

    pairs = training.partners * max(map(len, sides))
    partner = np.random.default_rng(training.seed).integers(0, len(sides[1]), pairs)
    z = scaled(sides[0][np.arange(pairs) % len(sides[0])]) - scaled(sides[1][partner])
    weights = descend(z, training.ridge)
    worth = {i: float(scaled(x[i]) @ weights) for i in texts}
    ordered = sorted(worth[i] for i in learned)
    cut = ordered[sum(good[i] == 0 for i in learned) - 1]
    for i in texts:
        assert got[i].held_out == held[i]
        odds = worth[i] - cut + np.log(training.threshold / (1 - training.threshold))
        assert got[i].worth == pytest.approx(worth[i], abs=1e-4), i
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-4), i
        if abs(worth[i] - cut) > 1e-3:
            assert got[i].predicted == (worth[i] > cut), i
