"""Groups spelling variants: frequent forms and the rarer words one edit away from them.

Near words (one code point inserted, deleted or replaced) are found by dense prefix-suffix tiling.
With the longer of two words m code points long, they are near if and only if their common prefix
and common suffix together reach m - 1. Words are laid out as padded code-point matrices, and tiles
(pairs of blocks of words) are compared at once with numpy.

Which blocks meet: the edited place of the longer word lies in one of PIECES even pieces of it, so
near words agree in everything before and everything after that piece. Each word is dealt once per
piece, as the longer and as the shorter word; only words with equal surroundings share blocks. A
pair that agrees around several pieces counts for the first of them. Surroundings that more words
share than a tile holds are cut into blocks, and every pair of blocks is a tile of its own, so no
task gets a whole group. Tiles return sums per word, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.joins import checked_side
from tenura.llm.text import lower_ascii
from tenura.sources.scratch import materialize

PIECES = 3
# Words of a block at most, and code points of a block at most.
TILE, TILE_CELLS = 512, 1 << 19
# Code points laid out or compared at once.
CELLS = 1 << 22
LETTERS = r"a-zÀ-ÿ"


def word_counts(docs: DataFrame, min_chars: int = 7, min_count: int = 2, typo_every: int = 31,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all texts: runs of letters, A-Z in lower case, some with a planted typo.

    Where ``typo_every`` divides the CRC32 h of ``<id>:<run>``, the run's code point h % length is
    left out (0: nowhere). Words have at least ``min_chars`` code points and ``min_count``
    occurrences. Null texts have no words; a null id is written as nothing.
    """
    # Deleting never makes a word longer, so shorter runs are out at once.
    runs = F.regexp_extract_all(lower_ascii(F.col(text_col)),
                                F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    word = F.col("run")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(runs).alias("run"))
    if typo_every:
        rows = rows.withColumn("h", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8")))
        k = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), k),
                           F.substring("run", k + 2, F.length("run")))
        word = F.when(F.col("h") % typo_every == 0, shorter).otherwise(word)
    return (rows.select(word.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _dealt(words: DataFrame, pieces: int) -> DataFrame:
    """Each word for each piece, as a word of m code points and as one of m - 1."""
    around = "xxhash64(left(word, s), right(word, m - e))"
    return (words.select("word", "n", F.length("word").alias("len"))
            .where("len > 0")
            .select("*", F.explode(F.array(F.col("len"), F.col("len") + 1)).alias("m"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
            .withColumns({"s": F.expr(f"CAST(piece * m DIV {pieces} AS INT)"),
                          "e": F.expr(f"CAST((piece + 1) * m DIV {pieces} AS INT)")})
            .select("m", "piece", F.expr(around).alias("around"), "word", "n"))


def _tiled(dealt: DataFrame, tile: int) -> DataFrame:
    """Rows with the tiles (x, y) that they are compared in and the block they belong to."""
    group = ["m", "piece", "around"]
    most = F.expr(f"greatest(1, least({tile}, {TILE_CELLS} DIV m))")
    large = (dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
             .where(F.col("size") > most)
             .select(*group, F.ceil(F.col("size") / most).cast("int").alias("blocks")))
    large = checked_side(large, "large")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    return (dealt.join(large, group, "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*group, F.least("own", "other").alias("x"),
                    F.greatest("own", "other").alias("y"), "own", "word", "n"))


def _padded(words: list[str]) -> np.ndarray:
    """Code points of words, one row each, zeros behind the end, in the smallest fitting type."""
    flat = np.array(words)
    cells = flat.view(np.uint32).reshape(len(words), -1)
    return cells.astype(np.uint8) if cells.max(initial=0) < 256 else cells


def _near_in(m: int, pieces: int, piece: np.ndarray, tile: np.ndarray, own: np.ndarray,
             same_block: np.ndarray, words: list[str], n: np.ndarray) -> tuple:
    """(rows with near words, how many, the most frequent one's n, that one's row)."""
    lengths = np.array([len(w) for w in words])
    left, right = _padded(words), _padded([w[::-1] for w in words])
    rank = np.argsort(np.argsort(np.array(words), kind="stable"), kind="stable")
    long = lengths == m
    ends = np.searchsorted(tile, tile, side="right")
    counts = np.where(long, ends - np.arange(len(tile)) - 1, 0)
    before = np.concatenate(([0], np.cumsum(counts)))
    limit = max(1, CELLS // max(m, 1))
    found_i, found_j = [], []
    for start in range(0, int(before[-1]), limit):
        pair = np.arange(start, min(start + limit, int(before[-1])))
        i = np.searchsorted(before, pair, side="right") - 1
        j = pair - before[i] + i + 1
        apart = same_block[i] | (own[i] != own[j])
        i, j = i[apart], j[apart]
        prefix = (left[i] != left[j]).argmax(1)
        suffix = (right[i] != right[j]).argmax(1)
        near = prefix + suffix >= m - 1
        i, j, prefix, suffix = i[near], j[near], prefix[near], suffix[near]
        first = np.full(len(i), pieces)
        for k in reversed(range(pieces)):
            around = (prefix >= k * m // pieces) & (suffix >= m - (k + 1) * m // pieces)
            first[around] = k
        counted = first == piece[i]
        found_i.append(i[counted])
        found_j.append(j[counted])
    i = np.concatenate(found_i) if found_i else np.zeros(0, np.int64)
    j = np.concatenate(found_j) if found_j else np.zeros(0, np.int64)
    at, to = np.concatenate((i, j)), np.concatenate((j, i))
    order = np.lexsort((rank[to], -n[to], at))
    at, to = at[order], to[order]
    rows, starts, near_words = np.unique(at, return_index=True, return_counts=True)
    return rows, near_words, n[to[starts]], to[starts]


def _compare(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    """Near words within the tiles of a partition that is sorted by tile."""
    kept: pa.Table | None = None

    def runs(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        """Whole tiles in runs of one word length and a bounded size, and what is left."""
        keys = np.stack([table.column(c).to_numpy() for c in ("m", "piece", "around", "x", "y")])
        starts = np.concatenate(([0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))))
        whole = len(table) if last else starts[-1]
        m = keys[0]
        out, begin = [], 0
        for s, e in zip(starts, np.append(starts[1:], len(table))):
            if s >= whole:
                break
            if s > begin and (m[s] != m[begin] or (e - begin) * int(m[begin]) > CELLS):
                out.append(table.slice(begin, s - begin))
                begin = s
        if whole > begin:
            out.append(table.slice(begin, whole - begin))
        return out, table.slice(whole)

    def result(table: pa.Table) -> pa.RecordBatch | None:
        columns = {c: table.column(c).to_numpy() for c in
                   ("m", "piece", "around", "x", "y", "own", "n")}
        words = table.column("word").to_pylist()
        keys = np.stack([columns[c] for c in ("piece", "around", "x", "y")])
        tile = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))))
        m = int(columns["m"][0])
        # Long words first within their tile.
        short = np.array([len(w) < m for w in words])
        order = np.lexsort((short, tile))
        words = [words[i] for i in order]
        at, near, best_n, best = _near_in(
            m, pieces, columns["piece"][order], tile, columns["own"][order],
            (columns["x"] == columns["y"])[order], words, columns["n"][order])
        if not len(at):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in at], pa.string()), pa.array(near, pa.int64()),
             pa.array(best_n, pa.int64()), pa.array([words[i] for i in best], pa.string())],
            names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        kept = table if kept is None else pa.concat_tables([kept, table])
        done, kept = runs(kept.combine_chunks(), last=False)
        for out in map(result, done):
            if out is not None:
                yield out
    if kept is not None and len(kept):
        for out in map(result, runs(kept.combine_chunks(), last=True)[0]):
            if out is not None:
                yield out


def near_words(words: DataFrame, pieces: int = PIECES, tile: int = TILE) -> DataFrame:
    """word, n_near, best_n, best: words that have near words, and the most frequent of these.

    ``words`` holds (word, n), each word once; ties go to the smallest in code-point order.
    """
    tiled = _tiled(_dealt(words, pieces), tile)
    key = ["m", "piece", "around", "x", "y"]
    together = tiled.repartition(*key).sortWithinPartitions(*key)
    found = together.mapInArrow(lambda batches: _compare(batches, pieces),
                                "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"),
                    F.col("b.word").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling the steps.

    A form's n is a multiple of its word's, so chains are short and have no loops.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(state.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "roots")
        state = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return state


def variants(words: DataFrame, ratio: int = 10, pieces: int = PIECES,
             tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; each word once).

    The form is the most frequent near word (ties: the smallest in code-point order) if its n is
    at least ``ratio`` times the word's, else null; the root is the last form reached from a word,
    or the word itself. An empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"), "words")
    found = near_words(words, pieces, tile)
    is_form = F.col("best_n") >= ratio * F.col("n")
    linked = materialize(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "linked")
    followed = roots(linked.where("form is not null"))
    return (linked.join(followed, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                    "form_n"))
