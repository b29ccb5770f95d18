"""Benchmark decontamination: test items contained in documents, however long these are.

Containment is the share of an item's distinct word shingles that a document holds; an item of fewer
words than a shingle is one shingle of its own length. Documents are partitioned by their number n
of distinct shingles into classes (2**(c-1), 2**c]. The MinHash signature of class c is one
permutation with 2**(c+1) bins, so a shingle of a document is its bin's minimum with a chance of at
least 0.78 whatever the document's length, and an item of which many shingles are in the document
agrees with it on some bin almost surely. Items with fewer than ``few`` shingles have no such
margin: all their shingles count as signature. Agreement on a signature shingle makes a candidate;
only for candidates the exact share of common shingles, compared as text, is counted.

The document side keeps only shingles that pass a bit map of all items' shingles. The map has no
false negatives; it grows with the items' shingles up to a bound and may be sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm import shingling
from tenura.llm.joins import checked_side
from tenura.sources.scratch import materialize


@dataclass(frozen=True)
class LeakRules:
    """``map_bits``: least and most log2 of the bits of the map (2**23 bits are 1 MB, 2**28 32 MB);
    in between it has sixteen bits for each of the items' shingles."""

    shingle_words: int = 5
    containment: float = 0.8
    few: int = 16
    map_bits: tuple[int, int] = (23, 28)


_CLASSES = 62


def _bins(values: np.ndarray, size_class: int) -> np.ndarray:
    """Bin of each hash for documents of a class: its leading bits."""
    return values >> np.uint64(63 - min(size_class, 62))


def _minima(sorted_values: np.ndarray, size_class: int) -> np.ndarray:
    """Marks the least hash of each bin among ascending ``sorted_values``."""
    bins = _bins(sorted_values, size_class)
    return np.concatenate(([True], bins[1:] != bins[:-1]))


def size_class(n: int) -> int:
    return max(n - 1, 0).bit_length()


def _probes(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return values & mask, (values >> np.uint64(32)) & mask


def item_shingles(items: DataFrame, rules: LeakRules, id_col: str, text_col: str) -> DataFrame:
    """(item_id, shingle, value, words, few, classes): distinct shingles of each item.

    ``words`` is their length, ``few`` says that there are few of them. Bit c of ``classes`` says
    that the shingle is in the item's signature for documents of class c.
    """
    names = ["item_id", "shingle", "value", "words", "few", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for item, text in zip(batch.column(0).to_pylist(),
                                  batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = shingling.words(text or b"")
                s = shingling.Shingles([words], rules.shingle_words)
                values, first = np.unique(s.hashes, return_index=True)
                classes = np.zeros(len(values), np.int64)
                for c in range(_CLASSES):
                    classes |= _minima(values, c).astype(np.int64)[:len(values)] << c
                if len(values) < rules.few:
                    classes[:] = -1
                out["item_id"] += [item] * len(values)
                out["shingle"] += [s.string(i) for i in first]
                out["value"] += values.view(np.int64).tolist()
                out["words"] += [min(len(words), rules.shingle_words)] * len(values)
                out["few"] += [len(values) < rules.few] * len(values)
                out["classes"] += classes.tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("item_id", pa.int64()), ("shingle", pa.string()), ("value", pa.int64()),
                 ("words", pa.int32()), ("few", pa.bool_()), ("classes", pa.int64())]))

    rows = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    return rows.mapInArrow(
        run, "item_id long, shingle string, value long, words int, few boolean, classes long")


def bit_map(shingles: DataFrame, rules: LeakRules) -> bytes:
    """Bit map of (value, few): bits of all shingles, then bits of those of small items.

    Each partition sends one map; there are at most eight.
    """
    least, most = rules.map_bits
    log_bits = min(max(least, (16 * shingles.count()).bit_length()), most)
    size = (1 << log_bits) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros((2, 1 << log_bits), bool)
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            small = batch.column(1).to_numpy(zero_copy_only=False)
            for k, chosen in enumerate((values, values[small])):
                for probe in _probes(chosen, log_bits):
                    marks[k][probe] = True
        yield pa.RecordBatch.from_pydict({"m": [np.packbits(marks).tobytes()]})

    maps = shingles.select("value", "few").coalesce(8).mapInArrow(run, "m binary").collect()
    joined = np.zeros(2 * size, np.uint8)
    for row in maps:
        joined |= np.frombuffer(row["m"], np.uint8)
    return joined.tobytes()


def _document_hits(docs: DataFrame, marks: bytes, short: list[int],
                   rules: LeakRules) -> DataFrame:
    """(doc_id, shingle, value, size_class, signs): distinct shingles that pass the bit map.

    ``signs`` says that the shingle is part of the document's signature. Only documents with a
    signature shingle in the map have rows. ``short`` names the lengths of items shorter than a
    shingle; shingles of these lengths are looked up among the small items'.
    """
    sent = docs.sparkSession.sparkContext.broadcast(marks)
    names = ["doc_id", "shingle", "value", "size_class", "signs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)
        all_items, small_items = bits.reshape(2, -1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
            for a, b in shingling.groups(sizes):
                rows = _hits(ids.slice(a, b - a).to_pylist(),
                             texts.slice(a, b - a).to_pylist(), all_items, small_items, short,
                             rules)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, (
                        pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_()),
                        strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return rows.mapInArrow(
        run, "doc_id long, shingle string, value long, size_class int, signs boolean")


def _hits(ids: list, texts: list, all_items: np.ndarray, small_items: np.ndarray,
          short: list[int], rules: LeakRules) -> tuple[list, ...]:
    out: tuple[list, ...] = ([], [], [], [], [])
    words = [shingling.words(t or b"") for t in texts]
    found = shingling.Shingles(words, rules.shingle_words)
    bits = all_items.size.bit_length() - 1
    for length in short:
        other = shingling.Shingles(words, length)
        p, q = _probes(other.hashes, bits)
        places = np.flatnonzero(small_items[p] & small_items[q])
        owners = np.searchsorted(other.bounds, places, "right") - 1
        seen = np.unique(np.stack([owners.astype(np.uint64), other.hashes[places]]), axis=1,
                         return_index=True)[1]
        for k in seen:
            row = (ids[owners[k]], other.string(places[k]),
                   int(other.hashes[places[k]].view(np.int64)), 0, True)
            for column, value in zip(out, row, strict=True):
                column.append(value)
    p, q = _probes(found.hashes, bits)
    passed = all_items[p]
    passed &= all_items[q]
    places = np.flatnonzero(passed)
    owners = np.searchsorted(found.bounds, places, "right") - 1
    for d in np.unique(owners):
        values, first = np.unique(found.hashes[found.bounds[d]:found.bounds[d + 1]],
                                  return_index=True)
        c = size_class(len(values))
        p, q = _probes(values, bits)
        kept = all_items[p] & all_items[q]
        signs = _minima(values, c) | (small_items[p] & small_items[q])
        if not (kept & signs).any():
            continue
        for k in np.flatnonzero(kept):
            row = (ids[d], found.string(found.bounds[d] + first[k]),
                   int(values[k].view(np.int64)), c, bool(signs[k]))
            for column, value in zip(out, row, strict=True):
                column.append(value)
    return out


def leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules(),
          item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, containment) for each item that a document of ``docs`` contains.

    Null and empty texts contain nothing and are contained in nothing. Rows without an id are left
    out; ids are read as whole numbers, others raise. Rows that share an id count as one document
    (or item) holding either's shingles.
    """
    own = materialize(item_shingles(items, rules, item_col, text_col), "item-shingles")
    short = own.select("words").where(F.col("words") < rules.shingle_words).distinct()
    # At most as many as a shingle has words.
    lengths = sorted(r["words"] for r in short.collect())
    hits = materialize(_document_hits(docs, bit_map(own, rules), lengths, rules), "document-hits")
    # A shingle that two rows with one id share counts once.
    own = own.groupBy("item_id", "shingle", "value").agg(F.bit_or("classes").alias("classes"))
    own = checked_side(own, "item-signatures")
    hits = hits.groupBy("doc_id", "shingle", "value").agg(
        F.max("size_class").alias("size_class"), F.max("signs").alias("signs"))
    signed = F.expr("shiftrightunsigned(classes, size_class)").bitwiseAND(F.lit(1)) == 1
    candidates = (hits.where("signs").join(own, ["value", "shingle"]).where(signed)
                  .select("doc_id", "item_id").distinct())
    sizes = own.groupBy("item_id").agg(F.count("*").alias("n"))
    asked = candidates.join(own.drop("classes"), "item_id")
    shared = (asked.join(hits.select("doc_id", "value", "shingle"), ["doc_id", "value", "shingle"])
              .groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")))
    share = F.col("shared") / F.col("n")
    return shared.join(sizes, "item_id").where(share >= rules.containment).select(
        "doc_id", "item_id", "shared", share.alias("containment"))


def drop_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """The rows of ``docs`` that contain no item, columns unchanged; rows without an id stay."""
    gone = checked_side(leaks(docs, items, rules).select("doc_id").distinct(), "leaks-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
