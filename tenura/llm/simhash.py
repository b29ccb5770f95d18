"""SimHash near-duplicates: a grid range-join over segment popcounts, verified bit by bit.

A fingerprint is cut into 32 segments of two bits. Its embedding is the vector of the segments'
bit counts (0, 1 or 2), and the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints. Counts are kept in thermometer code (0 = 00, 1 = 01, 2 = 11), so
that the Manhattan distance of two embeddings is the bit count of their XOR.

Grid: two embeddings within distance 3 agree up to distance 1 on the lower or on the upper 16
coordinates. One half of the coordinates is therefore the cell, and a fingerprint looks for
partners in its own cell and in the cells one step up, for either half (one step down is found
from the other side). Cells that hold very many fingerprints are cut again by the quarters of the
other half, where the same argument holds, so no cell is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.components import connected_components
from tenura.llm.joins import checked_side
from tenura.sources.scratch import materialize

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
CELL_LIMIT = 4096

_LANES = np.uint64(0x0101010101010101)
_SHIFTS = [np.uint64(i) for i in range(8)]


# ------------------------------------------------------------------------------ fingerprints


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one UTF-8 text: lower-cased A-Z, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(words))
    spans = zip(begins[:len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes. Eight byte-wide counters are added per word."""
    counts = np.zeros((8, 8), dtype=np.int64)  # [bit within byte, byte]
    for start in range(0, len(hashes), 255 * 64):
        block = hashes[start:start + 255 * 64]
        cuts = np.arange(0, len(block), 255)
        for i, shift in enumerate(_SHIFTS):
            lanes = np.add.reduceat((block >> shift) & _LANES, cuts)
            counts[i] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).T.reshape(-1)  # byte-major, low bit first
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long) per row; a null text counts as empty and gives zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = [0 if (t := x.as_py()) is None else fingerprint(t, size) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# ------------------------------------------------------------------------------ the range-join


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 two-bit segments in thermometer code, packed into one long."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(high).bitwiseAND(low)
    any_ = fp.bitwiseOR(high).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(any_)


def _part(value: Column, part: int, width: int) -> Column:
    """Coordinates ``part`` of an embedding, ``width`` bits of it, as a cell number."""
    return F.shiftrightunsigned(value, part * width).bitwiseAND(F.lit((1 << width) - 1))


def _steps_up(cell: Column, width: int) -> Column:
    """The cell and its neighbours one step up in one coordinate, as (cell, step) structs."""
    own = F.struct(cell.alias("cell"), F.lit(False).alias("step"))
    ups = []
    for i in range(0, width, 2):
        count = F.shiftrightunsigned(cell, i).bitwiseAND(F.lit(3))
        up = (F.when(count == 0, cell.bitwiseOR(F.lit(1 << i)))
              .when(count == 1, cell.bitwiseOR(F.lit(2 << i))))
        ups.append(F.struct(up.alias("cell"), F.lit(True).alias("step")))
    return F.filter(F.array(own, *ups), lambda s: s["cell"].isNotNull())


def _labelled(cells: Column, part: int, name: str) -> Column:
    return F.transform(cells, lambda s: F.struct(F.lit(part).alias(name), s["cell"].alias("cell"),
                                                 s["step"].alias("step")))


def _homes(points: DataFrame) -> DataFrame:
    halves = F.array(*[F.struct(F.lit(h).alias("half"), _part(F.col("e"), h, 32).alias("cell"))
                       for h in (0, 1)])
    return points.select("rep", "fp", "e", F.explode(halves).alias("s")).select(
        "rep", "fp", "e", "s.half", "s.cell")


def _probes(points: DataFrame) -> DataFrame:
    halves = F.flatten(F.array(*[
        _labelled(_steps_up(_part(F.col("e"), h, 32), 32), h, "half") for h in (0, 1)]))
    return points.select("rep", "fp", "e", F.explode(halves).alias("s")).select(
        "rep", "fp", "e", "s.half", F.col("s.cell").alias("cell"), "s.step")


def _quarters(rows: DataFrame, probing: bool) -> DataFrame:
    """Rows of crowded cells, keyed also by a quarter of the other half."""
    other = F.when(F.col("half") == 0, _part(F.col("e"), 1, 32)).otherwise(
        _part(F.col("e"), 0, 32))
    cells = []
    for q in (0, 1):
        quarter = _part(other, q, 16)
        if probing:
            near = F.concat(_steps_up(quarter, 16), _steps_down(quarter, 16))
            cells.append(_labelled(near, q, "quarter"))
        else:
            own = F.struct(quarter.alias("cell"), F.lit(False).alias("step"))
            cells.append(_labelled(F.array(own), q, "quarter"))
    return rows.withColumn("s", F.explode(F.flatten(F.array(*cells)))).select(
        *rows.columns, "s.quarter", F.col("s.cell").alias("sub"))


def _steps_down(cell: Column, width: int) -> Column:
    downs = []
    for i in range(0, width, 2):
        count = F.shiftrightunsigned(cell, i).bitwiseAND(F.lit(3))
        down = (F.when(count == 3, cell.bitwiseXOR(F.lit(2 << i)))
                .when(count == 1, cell.bitwiseXOR(F.lit(1 << i))))
        downs.append(F.struct(down.alias("cell"), F.lit(True).alias("step")))
    return F.filter(F.array(*downs), lambda s: s["cell"].isNotNull())


def _verified(homes: DataFrame, probes: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    # Spark sizes exploded rows like the points they come from, some 34 times too low, and would
    # send them to every task.
    h, p = homes.alias("h"), probes.hint("merge").alias("p")
    same = [F.col(f"h.{k}") == F.col(f"p.{k}") for k in keys]
    # In one and the same cell each pair meets twice; a neighbour cell is entered from below only.
    once = F.col("p.step") | (F.col("p.rep") < F.col("h.rep"))
    manhattan = F.bit_count(F.col("h.e").bitwiseXOR(F.col("p.e"))) <= max_bits
    hamming = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("p.fp"))) <= max_bits
    on = same[0]
    for c in [*same[1:], once, manhattan, hamming]:
        on = on & c
    return h.join(p, on).select(F.col("h.rep").alias("a"), F.col("p.rep").alias("b"))


def links(reps: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Pairs (a, b) of representatives whose fingerprints differ in at most ``max_bits`` bits.

    ``reps`` (fp, rep) holds every fingerprint once. The grid is exact for up to 3 bits.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid covers Manhattan distances up to 3")
    points = reps.select("rep", "fp", embedding(F.col("fp")).alias("e"))
    homes, probes = _homes(points), _probes(points)
    crowded = materialize(homes.groupBy("half", "cell").count()
                          .where(F.col("count") > cell_limit).select("half", "cell"), "cells")
    if crowded.isEmpty():
        return _verified(homes, probes, ["half", "cell"], max_bits)
    plain = _verified(homes.join(crowded, ["half", "cell"], "left_anti"),
                      probes.join(crowded, ["half", "cell"], "left_anti"),
                      ["half", "cell"], max_bits)
    dense = _verified(_quarters(homes.join(crowded, ["half", "cell"], "left_semi"), False),
                      _quarters(probes.join(crowded, ["half", "cell"], "left_semi"), True),
                      ["half", "cell", "quarter", "sub"], max_bits)
    return plain.unionByName(dense)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(id, fingerprint hex, component_id) for every row of ``docs``.

    Equal fingerprints are one point of the join, so copies are never expanded into pairs. Texts
    that are null, empty or without a word have fingerprint zero and link like any other. Rows
    with the same id give one row each. Rows without an id are kept and link others like any row;
    a component is named by the least id in it, and has no name if none of its rows has an id.
    Ids are read as whole numbers, others raise.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    reps = prints.groupBy("fp").agg(F.min("id").alias("least"))
    reps = materialize(reps.withColumn("rep", F.col("fp")), "representatives")
    # Nodes are the fingerprints themselves: one without an id connects others all the same.
    found = connected_components(links(reps.select("fp", "rep"), max_bits, cell_limit),
                                 "near-duplicates")
    parts = materialize(reps.join(found, reps.rep == found.node, "left").select(
        "fp", "least", F.coalesce("component", "rep").alias("part")), "near-duplicate-parts")
    names = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    # One component per fingerprint; only fingerprints cross the shuffle, hot ones once per task.
    classes = parts.join(names, "part").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                  cell_limit: int = CELL_LIMIT) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, columns unchanged.

    The row with the least id stays, of rows that share it the one with the least hash of its text,
    and one of those that have the same id and text. A row without an id stays where its group has
    no row with one.
    """
    keyed = docs.withColumn("__row", F.xxhash64(text_col))
    prints = fingerprints(keyed, "__row", text_col, size).distinct()
    prints = materialize(prints.withColumnRenamed("id", "row"), "fingerprints")
    # Groups are named by their least fingerprint: ids may be null or stand in several groups.
    reps = materialize(prints.select("fp", F.col("fp").alias("rep")).distinct(), "representatives")
    found = connected_components(links(reps, max_bits, cell_limit), "near-duplicates")
    classes = reps.join(found, reps.rep == found.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("part"))
    parts = prints.join(classes, "fp").select("row", "part")
    rows = keyed.groupBy(F.col(id_col).alias("id"), F.col("__row").alias("row")).agg(
        F.count("*").alias("n"))
    rows = materialize(rows.join(parts, "row").select(
        "part", "n", F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("k")),
        "near-duplicate-rows")
    first = rows.groupBy("part").agg(F.min("k").alias("first"))
    rows = rows.join(first, "part")

    def keys(chosen: DataFrame, name: str) -> DataFrame:
        return checked_side(chosen.select(F.col("k.id").alias("__id"),
                                          F.col("k.row").alias("__key")), name)

    gone = keys(rows.where("k <> first"), "near-duplicates-gone")
    twice = keys(rows.where("k = first and n > 1"), "near-duplicates-equal")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
    kept = keyed.join(gone, same, "left_anti")
    copies = kept.join(twice, same, "left_semi").dropDuplicates([id_col, "__row"])
    return kept.join(twice, same, "left_anti").unionByName(copies).select(*docs.columns)
