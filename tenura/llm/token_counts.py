"""Token counts of documents by their distinct pre-tokens, without token ids.

A byte-level BPE tokenizer splits a text into pre-tokens and merges bytes within each of them only,
so a pre-token has the same number of pieces wherever it stands. Three steps use that:

1. Every document becomes one stored row with its pre-tokens and how often each occurs in it.
   Pre-tokens that the vocabulary holds as one piece are only summed; they are at most as many as
   the vocabulary and need no lookup.
2. The distinct pre-tokens of all documents are counted, and each is encoded once.
3. The frequencies join the piece counts and are summed per document. The pre-tokens that stand in
   most documents, at most HEAD of them, are sent to every task; all others meet their documents by
   a join that adaptive execution can split. Both parts are there at every size.

No ids are built: a pre-token's encoding is reduced to its length at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tenura.sources.scratch import materialize

# Fixed value: how byte-level BPE cuts a text into pre-tokens.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Pre-tokens that are sent to every task, at most: some tens of MB.
HEAD = 1 << 18
# Pre-tokens encoded by one call.
CALL = 4096


class PreTokens:
    """Pre-tokens of texts as a byte-level BPE tokenizer cuts them.

    ``regex`` does the cutting. It may know characters that the tokenizer's own tables don't, so
    every new character is tried once in both; a text with one that they class differently is
    cut by the library.
    """

    def __init__(self, tokenizer_json: str):
        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _refuse_others(tokenizer_json, tokenizer)
        self._library = tokenizer.pre_tokenizer
        self._cut = regex.compile(PATTERN).findall
        self._agreed, self._odd = set(map(chr, range(128))), set()
        added = tokenizer.get_added_tokens_decoder().values()
        specials = sorted((t.content for t in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None
        tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self._tokenizer = tokenizer
        self.whole = self._whole_pieces()

    def _whole_pieces(self) -> frozenset[str]:
        """Pre-tokens that are one piece of the vocabulary."""
        decoder = self._tokenizer.decoder
        texts = {decoder.decode([t]) for t in self._tokenizer.get_vocab(with_added_tokens=False)}
        found = [t for t in texts if t and "�" not in t and self.cut(t) == [t]]
        return frozenset(t for t, n in zip(found, self.pieces(found)) if n == 1)

    def _agrees(self, char: str) -> bool:
        for before in "a1!":
            mine = len(self._cut(before + char))
            if mine != len(self._library.pre_tokenize_str(before + char)):
                return False
        return True

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not text.isascii():
            new = set(text) - self._agreed
            if new:
                self._odd.update(c for c in new - self._odd if not self._agrees(c))
                self._agreed |= new - self._odd
                if new & self._odd:
                    return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self._cut(text)

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """(tokens that need no lookup, occurrences of every other pre-token)."""
        parts = self._special.split(text) if self._special else [text]
        counts: Counter = Counter()
        for part in parts:
            counts.update(self.cut(part))
        known = len(parts) - 1
        for token in self.whole.intersection(counts):
            known += counts.pop(token)
        return known, counts

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        out = []
        for i in range(0, len(pre_tokens), CALL):
            found = self._tokenizer.encode_batch_fast(pre_tokens[i:i + CALL],
                                                      add_special_tokens=False)
            out += [len(e) for e in found]
        return out


def _refuse_others(tokenizer_json: str, tokenizer: Tokenizer) -> None:
    """Raise for tokenizers whose counts don't follow from pre-tokens cut by PATTERN."""
    cutter = tokenizer.pre_tokenizer
    plain = (tokenizer.normalizer is None and isinstance(cutter, ByteLevel)
             and not cutter.add_prefix_space and cutter.use_regex)
    if not plain:
        raise ValueError("only byte-level BPE tokenizers without normalizer and prefix space "
                         "are counted by pre-tokens")
    for t in tokenizer.get_added_tokens_decoder().values():
        if t.lstrip or t.rstrip or t.single_word or t.normalized:
            raise ValueError(f"added token {t.content!r} is matched in a way not supported")


@lru_cache(maxsize=2)
def _pre_tokens(tokenizer_json: str) -> PreTokens:
    """One per worker process."""
    return PreTokens(tokenizer_json)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def document_frequencies(docs: DataFrame, tokenizer_json: str, id_col: str,
                         text_col: str) -> DataFrame:
    """One stored row per document: row key, id, bytes, summed tokens, pre-tokens and counts.

    A document must fit a task's memory; batches end between documents.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", id_type),
        T.StructField("n_bytes", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("times", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = _pre_tokens(tokenizer_json)
        # Unique among the rows of the stored table, whichever attempt of a task wrote them.
        row = TaskContext.get().partitionId() << 40
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(at, 256)
                rows, sizes, known, tokens, times, ends = [], [], [], [], [], [0]
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    n, counts = pre.frequencies(text)
                    rows.append(row)
                    row += 1
                    sizes.append(len(text) if text.isascii() else len(text.encode()))
                    known.append(n)
                    tokens += counts.keys()
                    times += counts.values()
                    ends.append(len(tokens))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()),
                     pa.array(known, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(tokens, pa.string())),
                     pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))],
                    names=schema.names)

    return materialize(slim.mapInArrow(count, schema), "frequencies")


def piece_counts(frequencies: DataFrame, tokenizer_json: str) -> DataFrame:
    """Every distinct pre-token, encoded once: token, documents, pieces; stored."""
    distinct = (frequencies.select(F.explode("tokens").alias("token"))
                .groupBy("token").agg(F.count(F.lit(1)).alias("documents")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = _pre_tokens(tokenizer_json)
        for batch in batches:
            found = pre.pieces(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                names=["token", "documents", "pieces"])

    return materialize(distinct.mapInArrow(
        encode, "token string, documents long, pieces long"), "pieces")


def _head_and_tail(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pre-tokens of most documents, ``most`` of them at most, and all others."""
    step = F.floor(F.log2("documents") * 8)
    # One row per eighth of a power of two.
    steps = counted.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect()
    least, total = float("inf"), 0
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    in_head = step >= F.lit(least)
    return (counted.where(in_head).select("token", "pieces"),
            counted.where(~in_head).select("token", "pieces"))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for every row of ``docs``.

    ``path`` names a byte-level BPE tokenizer's JSON file, read on the driver. Counts equal the
    library's without begin, end or added special tokens; special strings inside texts are one
    token each, as its default has it. Null and empty texts have no bytes and no tokens; null and
    repeated ids are rows like any other; other columns of ``docs`` are left out.
    """
    tokenizer_json = _read(path)
    PreTokens(tokenizer_json)  # an unsuitable file is refused before any task runs
    frequencies = document_frequencies(docs, tokenizer_json, id_col, text_col)
    counted = piece_counts(frequencies, tokenizer_json)
    often, seldom = _head_and_tail(counted, head)
    pairs = frequencies.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("p")).select(
        "row", F.col("p.tokens").alias("token"), F.col("p.times").alias("times"))
    # At most ``head`` rows.
    often = F.broadcast(often)
    sums = F.sum(F.col("times") * F.col("pieces")).alias("n")
    near = pairs.join(often, "token").groupBy("row").agg(sums)
    rest = pairs.join(often, "token", "left_anti").join(seldom, "token").groupBy("row").agg(sums)
    looked_up = near.unionByName(rest).groupBy("row").agg(F.sum("n").alias("n"))
    total = F.col("known") + F.coalesce(F.col("n"), F.lit(0))
    return (frequencies.select("row", "id", "n_bytes", "known").join(looked_up, "row", "left")
            .select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"),
                    (total > limit).alias("over_limit")))
