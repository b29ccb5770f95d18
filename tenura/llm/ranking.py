"""Quality scores learned from preferences between documents (Bradley-Terry).

A document has features x of its text and a worth w.x; document a is preferred to b with probability
1 / (1 + exp(-w.(x_a - x_b))). The weights are fitted by logistic loss on the feature differences of
pairs of a good and a bad labelled document, so nothing but the order of scores is learned. The
threshold is a quantile of the worths of all training documents, computed exactly by Spark: the one
that as many of them exceed as are labelled good. Worths are then shifted so that this quantile
scores ``threshold``.

Features are computed where the texts are, for all documents. Only the weights come from a sample:
labelled documents that differ in id or features, ``Training.sample`` per class, whatever the size of
the corpus and however many rows share an id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.operators.ordering import ordered_prefix
from tenura.sources.scratch import materialize

# Frequent short words of several languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as with der die und den von zu das mit sich ist nicht de la "
    "que el en y los se las por un con le et les des du une est".encode().split())

FEATURES = ("log_words", "word_length", "long_words", "short_words", "upper", "digit", "symbol",
            "stop", "letter", "high_byte", "function_words", "distinct_words", "repeated_neighbours",
            "distinct_lines", "line_length", "bare_symbols", "all_caps", "ends_with_stop",
            "symbol_ends", "top_word")
_SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:!?"
_CAPS = re.compile(rb"\b[A-Z]{3,}\b")
_SYMBOL_ENDS = re.compile(rb"[^\s#*$%&|<>!][#*$%&|<>!]{2,}(?=\s|$)")
_BARE = re.compile(rb"(?:^|\s)[#*$%&|<>]+(?=\s|$)")


@dataclass(frozen=True)
class Training:
    """``sample``: labelled documents per class at most; ``partners``: pairs of each."""

    sample: int = 10_000
    partners: int = 8
    ridge: float = 1.0
    threshold: float = 0.7
    seed: int = 11


def features(text: bytes | None) -> list[float]:
    """FEATURES of one UTF-8 text; an empty text has zeros."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lower = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    function = sum(w in FUNCTION_WORDS for w in lower)
    neighbours = sum(a == b for a, b in zip(lower, lower[1:], strict=False))
    # Means over the text's first and last words would depend on its length, shares don't.
    counts: dict[bytes, int] = {}
    for w in lower:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n), float(lengths.mean()), float((lengths > 12).mean()),
        float((lengths <= 2).mean()), found[65:91].sum() / size, found[48:58].sum() / size,
        sum(int(found[c]) for c in _SYMBOLS) / size, sum(int(found[c]) for c in _STOPS) / size,
        found[97:123].sum() / size, found[128:].sum() / size, function / n,
        len(counts) / n ** 0.8, neighbours / n, len(set(lines)) / len(lines),
        np.log1p(size / len(lines)), len(_BARE.findall(text)) / n, len(_CAPS.findall(text)) / n,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        len(_SYMBOL_ENDS.findall(text)) / n, max(counts.values()) / n]


def _featured(rows: DataFrame) -> DataFrame:
    """(id, held_out, x array<double>) of rows (id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))],
                names=["id", "held_out", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(
        run, f"id {kind}, held_out boolean, x array<double>")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for ids whose crc32 as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass(frozen=True)
class Ranker:
    """Worth of features x: weights . clip((x - center) / scale); ``cut`` scores ``threshold``."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    threshold: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-(self.worth(x) - self.cut + shift)))


def fit(good: np.ndarray, bad: np.ndarray, share: float, training: Training) -> Ranker:
    """Ranker from the features of good and bad documents; ``share`` of all labelled are good."""
    both = np.concatenate((good, bad))
    center, scale = both.mean(0), both.std(0)
    scale[scale == 0] = 1.0
    plain = Ranker(center, scale, np.zeros(both.shape[1]), 0.0, training.threshold)
    if not len(good) or not len(bad):
        return plain
    rng = np.random.default_rng(training.seed)
    pairs = training.partners * max(len(good), len(bad))
    a = good[np.arange(pairs) % len(good)]
    b = bad[rng.integers(0, len(bad), pairs)]
    z = np.clip((a - center) / scale, -6, 6) - np.clip((b - center) / scale, -6, 6)
    weights = np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps on the mean logistic loss of the differences
        p = 1 / (1 + np.exp(-(z @ weights)))
        gradient = z.T @ (p - 1) + training.ridge * weights
        curve = (z * (p * (1 - p))[:, None]).T @ z + training.ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    ranker = Ranker(center, scale, weights, 0.0, training.threshold)
    # The sample holds either class at its own rate; weights bring back the labelled shares.
    worth = np.concatenate((ranker.worth(good), ranker.worth(bad)))
    mass = np.concatenate((np.full(len(good), share / len(good)),
                           np.full(len(bad), (1 - share) / len(bad))))
    order = np.argsort(worth, kind="stable")
    at = np.searchsorted(np.cumsum(mass[order]), 1 - share)
    cut = float(worth[order][min(at, len(worth) - 1)])
    return Ranker(center, scale, weights, cut, training.threshold)


def _worth(ranker: Ranker) -> Column:
    """Worth of the column ``x``."""
    center, scale = ranker.center.tolist(), ranker.scale.tolist()
    worth = F.lit(0.0)
    for i, w in enumerate(ranker.weights.tolist()):
        z = (F.col("x")[i] - F.lit(center[i])) / F.lit(scale[i])
        worth = worth + F.greatest(F.least(z, F.lit(6.0)), F.lit(-6.0)) * F.lit(w)
    return worth


def _exact_cut(labelled: DataFrame, ranker: Ranker, below: int) -> float:
    """The worth that ``below`` of the rows of ``labelled`` (x, n rows each) do not exceed."""
    worths = labelled.select(F.lit(0).alias("all"), _worth(ranker).alias("worth"), "n")
    order = ordered_prefix(worths, ["all"], "worth", {"rows": "n"})
    spot = order.where((F.col("before_rows") < below)
                       & (F.col("before_rows") + F.col("rows") >= below))
    return spot.first()["worth"]


def score(docs: DataFrame, labels: DataFrame, training: Training = Training(),
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, worth, predicted) per row of ``docs``.

    ``labels`` (id, good) marks good (1) and bad (0) documents; held-out ids and null labels are
    not learned from, and an id labelled both ways counts as bad. Without labels of both classes
    all scores are equal. Null texts count as empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    known = labels.toDF("id", "good").where("id is not null and good is not null")
    known = known.groupBy("id").agg(F.min("good").alias("good"))
    known = known.where(~held_out(F.col("id")))
    featured = materialize(_featured(rows), "document-features")
    labelled = featured.select("id", "x").join(known, "id").groupBy("id", "good", "x").agg(
        F.count("*").alias("n"))
    labelled = materialize(labelled, "labelled-features")
    sizes = {r["good"]: r for r in labelled.groupBy("good").agg(
        F.count("*").alias("n"), F.sum("n").alias("rows")).collect()}
    # A hash decides who is in the sample, so that its size is bounded for any number of labels.
    kept = F.lit(False)
    for good, r in sizes.items():
        rate = min(1.0, training.sample / r["n"])
        kept = kept | ((F.col("good") == good)
                       & (F.pmod(F.xxhash64("id", "x"), F.lit(1_000_000)) < int(rate * 1_000_000)))
    sample = labelled.where(kept).select("good", "x").orderBy("good", "x").collect()
    x = {k: np.array([r["x"] for r in sample if r["good"] == k], float).reshape(-1, len(FEATURES))
         for k in (0, 1)}
    good, bad = (sizes[k]["rows"] if k in sizes else 0 for k in (1, 0))
    ranker = fit(x[1], x[0], good / (good + bad) if good + bad else 0.5, training)
    if len(x[1]) and len(x[0]):
        ranker = replace(ranker, cut=_exact_cut(labelled, ranker, bad))

    shift = float(np.log(training.threshold / (1 - training.threshold)))
    out = featured.withColumn("worth", _worth(ranker))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("worth") - ranker.cut + shift))))
    return out.select(F.col("id").alias(id_col), "held_out", "score", "worth",
                      F.when(F.col("worth") >= ranker.cut, 1).otherwise(0)
                      .alias("predicted"))
