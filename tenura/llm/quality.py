"""Quality rules: base counts, and divergence from what a language looks like.

Each document has a histogram of character classes and one of common words. The references are
the mean histograms of each language over all documents that pass the base rules. A document is
rejected when its Jensen-Shannon distance from its language's reference exceeds a limit; texts too
short for a histogram are not judged by it. All work is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm import text as tx
from tenura.llm.joins import checked_side
from tenura.sources.scratch import materialize

# Frequent function words of each language with a reference.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "por", "un", "con"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
VOCABULARY = tuple(sorted({w for words in COMMON_WORDS.values() for w in words}))
# Character classes as regular-expression sets; lower-case a-z is the rest.
CHAR_CLASSES = {
    "upper": "A-Z",
    "letter": r"\p{L}&&[^A-Za-z]",
    "digit": "0-9",
    "space": r"\x20\x09-\x0D",
    "stop": r".,;:!?'\"()\-",
    "symbol": r"#*$%&|<>",
    "other": r"^A-Za-z\p{L}0-9\x20\x09-\x0D.,;:!?'\"()\-#*$%&|<>",
}


@dataclass(frozen=True)
class Limits:
    """``min_words`` and ``max_repeat_pct`` are the base rules, the rest the divergence rules.

    The distance of a sample from its own distribution falls with the root of its size, so a limit
    is ``max_*_distance + *_noise / sqrt(size)``.
    """

    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    min_chars: int = 200
    min_tokens: int = 50
    max_char_distance: float = 0.10
    char_noise: float = 3.2
    max_word_distance: float = 0.08
    word_noise: float = 1.9


# --------------------------------------------------------------------------------- base counts


def _repeat_words(docs: DataFrame, window: int) -> DataFrame:
    """Adds n_repeat_words: words that lie in a window found twice or more in the text.

    Window hashes are built by doubling (2, 4, 8 words). Only texts that have two equal windows
    are sorted to find where they stand.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    out = docs.withColumn("w", F.transform("words", lambda w: F.xxhash64(w)))
    span = 1
    while span < window:
        out = out.withColumn("w", F.zip_with(tx.head(F.col("w"), span), tx.tail(F.col("w"), span),
                                             lambda a, b: F.xxhash64(a, b)))
        span *= 2
    placed = F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("s", F.when(F.size(F.array_distinct("w")) < F.size("w"), placed))
    out = out.withColumn("same", F.zip_with(tx.head(F.col("s"), 1), tx.tail(F.col("s"), 1),
                                            lambda a, b: a["h"] == b["h"]))
    none = F.array(F.lit(False))
    out = out.withColumn("z", F.zip_with(
        F.col("s"), F.zip_with(F.concat(none, "same"), F.concat("same", none),
                               lambda a, b: a | b),
        lambda s, twice: F.when(twice, s["i"])))
    out = out.withColumn("p", F.sort_array(F.filter("z", lambda i: i.isNotNull())))
    steps = F.zip_with(tx.head(F.col("p"), 1), tx.tail(F.col("p"), 1),
                       lambda a, b: F.least(b - a, F.lit(window)))
    covered = F.aggregate(steps, F.lit(window), lambda s, x: s + x)
    return (out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .drop("w", "s", "same", "z", "p"))


def measures(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, base counts, chars array<double>, common array<double>) per row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                       F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("words", tx.words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(tx.NOT_SPACE))
    rows = rows.withColumn("lines", lines)
    rows = _repeat_words(rows, limits.window)
    classes = {name: tx.chars_in(F.col("text"), chars) if not chars.startswith("^")
               else F.length(F.regexp_replace("text", f"[{chars[1:]}]+", "")).cast("long")
               for name, chars in CHAR_CLASSES.items()}
    classes["letter"] = F.length(F.regexp_replace("text", r"[\x00-\x7F]+|\P{L}+", "")).cast("long")
    rows = rows.withColumns({f"c_{n}": c for n, c in classes.items()})
    found = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*VOCABULARY))
    rows = rows.withColumn("found", F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")))
    counts = [((F.octet_length("found") - F.octet_length(F.replace(
        "found", F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)) for w in VOCABULARY]
    n_chars = F.length("text").cast("long")
    rest = n_chars - reduce(lambda a, b: a + b, [F.col(f"c_{n}") for n in CHAR_CLASSES])
    rows = rows.select(
        "id", "lang", F.size("words").cast("long").alias("n_words"),
        (n_chars - F.col("c_space")).alias("word_chars"), F.col("c_symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", n_chars.alias("n_chars"),
        F.array(*[F.col(f"c_{n}").cast("double") for n in CHAR_CLASSES],
                rest.cast("double")).alias("chars"),
        F.array(*counts).alias("common"))
    other = F.col("n_words") - F.aggregate("common", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("common", F.concat("common", F.array(other)))
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


# ---------------------------------------------------------------------------------- divergence


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))


def references(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(lang, chars, common): mean histograms of each language, one row per language at most.

    Every document that passes the base rules and is long enough has the same weight.
    """
    sizes = {"chars": len(CHAR_CLASSES) + 1, "common": len(VOCABULARY) + 1}
    fit = measured.where(~F.col("base_failed") & F.col("lang").isin(*COMMON_WORDS) &
                         (F.col("n_words") >= limits.min_tokens) &
                         (F.col("n_chars") >= limits.min_chars))
    fit = fit.select("lang", *[_share(F.col(c)).alias(c) for c in sizes])
    means = fit.groupBy("lang").agg(*[F.avg(F.col(c)[i]).alias(f"{c}_{i}")
                                      for c, n in sizes.items() for i in range(n)])
    return means.select("lang", *[F.array(*[F.col(f"{c}_{i}") for i in range(n)]).alias(f"ref_{c}")
                                  for c, n in sizes.items()])


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays that each sum to 1."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: base counts, base_failed, char_distance, word_distance, kept.

    A null text has no words and fails. A language without a reference is judged by the base rules
    alone, a null language by the nearest reference. Histograms of texts under ``min_chars`` or
    ``min_tokens`` are not judged; their distances are null.
    """
    measured = materialize(measures(docs, limits, id_col, text_col, lang_col), "measures")
    # The references are learned twice: what the first ones reject doesn't shape the second.
    first = _judged(measured, references(measured, limits), limits)
    return _judged(measured, references(first.where("kept"), limits), limits).select(
        F.col("id").alias(id_col), "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def _judged(measured: DataFrame, refs: DataFrame, limits: Limits) -> DataFrame:
    # One row per language of COMMON_WORDS at most, so the references are small constants.
    refs = refs.orderBy("lang").collect()
    rows = measured.withColumns({"p_chars": _share(F.col("chars")),
                                 "p_common": _share(F.col("common"))})

    def nearest(column: str, guard: Column) -> Column:
        distance = F.lit(None).cast("double")
        for r in refs:
            own = js_distance(F.col(f"p_{column}"), F.lit(r[f"ref_{column}"]))
            distance = F.when(guard & (F.col("lang").isNull() | (F.col("lang") == r["lang"])),
                              F.least(distance, own)).otherwise(distance)
        return distance

    rows = rows.withColumns({
        "char_distance": nearest("chars", F.col("n_chars") >= limits.min_chars),
        "word_distance": nearest("common", F.col("n_words") >= limits.min_tokens)})
    kept = (~F.col("base_failed")
            & (F.coalesce("char_distance", F.lit(0.0))
               <= limits.max_char_distance + limits.char_noise / F.sqrt("n_chars"))
            & (F.coalesce("word_distance", F.lit(0.0))
               <= limits.max_word_distance + limits.word_noise / F.sqrt("n_words")))
    return rows.withColumn("kept", kept)


def keep_good(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id",
              text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged.

    Every row is decided by itself: a verdict follows from text and language, so these are the key,
    the text as a 64-bit hash, and rows that share an id or have none don't matter to each other.
    """
    keyed = docs.withColumn("__row", F.xxhash64(text_col))
    gone = judge(keyed, limits, "__row", text_col, lang_col).where("not kept")
    gone = gone.select(F.col("__row").alias("__gone"), F.col("lang").alias("__lang")).distinct()
    gone = checked_side(gone, "rejected")
    same = (F.col("__row") == F.col("__gone")) & keyed[lang_col].eqNullSafe(F.col("__lang"))
    return keyed.join(gone, same, "left_anti").select(*docs.columns)
