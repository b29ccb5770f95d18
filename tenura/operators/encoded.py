"""Model inputs as numbers, stored once for all fits.

Each row keeps its numeric inputs and one code per input: the bin of a numeric value (cut at
quantiles of the training rows) or the place of a category in the sorted list. Missing values stay
marked; every fit set fills them with its own medians and modes when it reads the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.operators.preprocess import Part, Preprocessing, in_parts
from tenura.sources.scratch import materialize

# Cuts per numeric input at most.
CUTS = 31
# Rows of a stored file, and so of a task of every later pass.
ROWS_PER_FILE = 1 << 15
# Rows of a block.
BLOCK = 1 << 15
# Tasks whose sums the driver adds itself, and sums of all of them at most; others are added by
# Spark first.
FEW_TASKS = 16
FEW_SUMS = 1 << 19


@dataclass(frozen=True)
class FillSet:
    """How one fit set reads the stored rows."""

    member: np.ndarray  # by part: whether its rows are learned from
    medians: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    median_bins: np.ndarray
    modes: np.ndarray  # codes
    known: list[np.ndarray]  # by categorical input: code -> one-hot place, -1 if not known
    numeric: np.ndarray  # numeric inputs with a median
    preprocessing: Preprocessing


@dataclass(frozen=True)
class Batch:
    """Rows as arrays."""

    x: np.ndarray
    codes: np.ndarray
    label: np.ndarray
    part: np.ndarray
    key_hash: np.ndarray
    key: pa.Array


@dataclass(frozen=True)
class Encoded:
    """The stored rows and how to read them."""

    rows: DataFrame
    key: str
    numeric: list[str]
    categorical: list[str]
    cuts: list[np.ndarray]
    categories: list[list[str]]
    parts: list[Part]
    sets: dict[str, FillSet]
    files: int

    @property
    def names(self) -> list[str]:
        return list(self.sets)

    def sizes(self) -> np.ndarray:
        """Codes per input."""
        return np.array([len(c) + 1 for c in self.cuts] + [len(c) for c in self.categories], int)


def _cuts(df: DataFrame, numeric: Sequence[str], cuts: int) -> list[np.ndarray]:
    """Distinct approximate quantiles per column, one aggregate for all."""
    if not numeric:
        return []
    at = F.array(*[F.lit((i + 1) / (cuts + 1)) for i in range(cuts)])
    row = df.agg(*[
        F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), at,
                            F.lit(max(1000, 20 * cuts))).alias(f"q{i}")
        for i, c in enumerate(numeric)]).first()
    return [np.unique(np.array(row[i] or [], float)) for i in range(len(numeric))]


def encode(
    data: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    learned: Mapping[str, Preprocessing],
    sets: Mapping[str, Sequence[Part]],
    key: str,
    label: str,
    cuts: int = CUTS,
) -> Encoded:
    """Store the rows of all parts that a set uses; cuts come from rows of the training split."""
    parts = sorted({p for used in sets.values() for p in used}, key=str)
    used = data.filter(in_parts(parts))
    train = [p for p in parts if p[0] == "train"] or parts
    edges = _cuts(data.filter(in_parts(train)), numeric, cuts)
    categories = [sorted({v for p in learned.values() for v in p.categories.get(c, ())})
                  for c in categorical]
    number = F.lit(-1)
    for i, p in enumerate(parts):
        number = F.when(F.expr(in_parts([p])), i).otherwise(number)
    slim = used.select(
        F.col(key).alias("key"), F.xxhash64(key).alias("key_hash"),
        F.col(label).cast("double").alias("label"), number.cast("int").alias("part"),
        *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)],
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(categorical)])
    count = sum(p.rows for p in learned.values())
    files = max(1, -(-count // ROWS_PER_FILE))
    values = [pa.array(c, pa.string()) for c in categories]

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.empty((n, len(numeric)))
            codes = np.full((n, len(numeric) + len(categorical)), -1, np.int16)
            for i, cut in enumerate(edges):
                column = batch.column(4 + i).to_numpy(zero_copy_only=False).astype(float)
                x[:, i] = column
                there = ~np.isnan(column)
                codes[there, i] = np.searchsorted(cut, column[there], side="left")
            for i, known in enumerate(values):
                found = pc.index_in(batch.column(4 + len(numeric) + i), value_set=known,
                                    skip_nulls=True)
                codes[:, len(numeric) + i] = pc.fill_null(found, -1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], _lists(x, pa.float64()), _lists(codes, pa.int16())],
                names=["key", "key_hash", "label", "part", "x", "codes"])

    schema = T.StructType([
        T.StructField("key", slim.schema["key"].dataType), T.StructField("key_hash", T.LongType()),
        T.StructField("label", T.DoubleType()), T.StructField("part", T.IntegerType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
        T.StructField("codes", T.ArrayType(T.ShortType()))])
    stored = materialize(slim.repartition(files).mapInArrow(to_codes, schema), "encoded")
    return Encoded(stored, key, list(numeric), list(categorical), edges, categories, parts,
                   {name: _fill_set(learned[name], sets[name], parts, numeric, categorical, edges,
                                    categories) for name in sets}, files)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)
                                    if width else np.zeros(n + 1, np.int32),
                                    pa.array(values.ravel(), kind))


def _fill_set(p: Preprocessing, used: Sequence[Part], parts: Sequence[Part],
              numeric: Sequence[str], categorical: Sequence[str], cuts: Sequence[np.ndarray],
              categories: Sequence[list[str]]) -> FillSet:
    medians = np.array([p.medians.get(c, 0.0) for c in numeric], float)
    known, modes = [], []
    for c, every in zip(categorical, categories):
        mine = {v: i for i, v in enumerate(p.categories.get(c, ()))}
        known.append(np.array([mine.get(v, -1) for v in every], int))
        modes.append(every.index(p.modes[c]) if c in p.modes else -1)
    return FillSet(
        member=np.array([q in set(used) for q in parts]), medians=medians,
        means=np.array([p.means.get(c, 0.0) for c in numeric], float),
        scales=np.array([p.scales.get(c, 1.0) for c in numeric], float),
        median_bins=np.array([np.searchsorted(cut, m, side="left")
                              for cut, m in zip(cuts, medians)], int),
        modes=np.array(modes, int), known=known,
        numeric=np.array([i for i, c in enumerate(numeric) if c in p.medians], int),
        preprocessing=p)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if not n:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def read(batch: pa.RecordBatch) -> Batch:
    n = batch.num_rows
    at = {name: i for i, name in enumerate(batch.schema.names)}
    return Batch(
        x=matrix(batch.column(at["x"]), n),
        codes=matrix(batch.column(at["codes"]), n).astype(np.int64),
        label=batch.column(at["label"]).to_numpy(zero_copy_only=False),
        part=batch.column(at["part"]).to_numpy(zero_copy_only=False),
        key_hash=batch.column(at["key_hash"]).to_numpy(zero_copy_only=False).view(np.uint64),
        key=batch.column(at["key"]))


def filled_codes(codes: np.ndarray, s: FillSet) -> np.ndarray:
    """Codes with the fit set's medians and modes in place of missing ones."""
    fills = np.concatenate((s.median_bins, s.modes))
    return np.where(codes < 0, fills, codes)


def design(batch: Batch, s: FillSet) -> np.ndarray:
    """The feature matrix of a fit set, in the order of its feature names, and a last column 1."""
    columns = s.numeric
    x = batch.x[:, columns] if batch.x.size else np.zeros((len(batch.label), 0))
    x = np.where(np.isnan(x), s.medians[columns], x)
    blocks = [(x - s.means[columns]) / s.scales[columns]]
    codes = filled_codes(batch.codes, s)
    for i, known in enumerate(s.known):
        width = int((known >= 0).sum())
        place = np.append(known, -1)[codes[:, len(s.medians) + i]]
        blocks.append((place[:, None] == np.arange(width)).astype(float))
    return np.hstack([*blocks, np.ones((len(batch.label), 1))])


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    """The rows of a task, that is of one stored file, together."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None


@dataclass(frozen=True)
class Block:
    """Some thousand rows as arrays; ``codes`` and ``margins`` have one row per input and fit set."""

    codes: np.ndarray
    label: np.ndarray
    part: np.ndarray
    key_hash: np.ndarray
    margins: np.ndarray
    key: pa.Buffer | bytes


@dataclass(frozen=True)
class Blocks:
    """The stored rows in blocks, a record each: passes read bytes and no single values.

    ``tasks`` is the number of tasks of a pass.
    """

    table: DataFrame
    tasks: int


def _block_fields() -> list[T.StructField]:
    return [T.StructField("n", T.IntegerType()), *[
        T.StructField(x, T.BinaryType()) for x in (
            "codes", "label", "part", "key_hash", "margins", "key")]]


BLOCK_SCHEMA = T.StructType(_block_fields())


def code_type(rows: Encoded) -> type:
    return np.int8 if rows.sizes().max(initial=0) < 127 else np.int16


def in_blocks(rows: Encoded, margins: int = 0, keys: bool = False) -> Blocks:
    """The rows in blocks, with so many margins of zero each and, if asked, their keys."""
    kind = code_type(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in _runs(batches, BLOCK):
            b = read(raw)
            yield block_record(Block(b.codes.T.astype(kind), b.label, b.part, b.key_hash,
                                     np.zeros((margins, len(b.label))),
                                     _written(b.key) if keys else b""))

    return stored_blocks(rows.rows.mapInArrow(pack, BLOCK_SCHEMA))


def stored_blocks(table: DataFrame, name: str = "blocks") -> Blocks:
    table = materialize(table, name)
    return Blocks(table, table.rdd.getNumPartitions())


def block_record(b: Block) -> pa.RecordBatch:
    values = [b.codes, b.label.astype(np.float64), b.part.astype(np.int32),
              b.key_hash.astype(np.uint64), b.margins.astype(np.float64)]
    return pa.RecordBatch.from_arrays(
        [pa.array([len(b.label)], pa.int32()),
         *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values],
         pa.array([bytes(b.key)], pa.binary())], names=BLOCK_SCHEMA.names)


def opened(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[Block]:
    """The blocks of a task, one after another."""
    for batch in batches:
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i, n in enumerate(at["n"].to_pylist()):
            codes, label, part, key_hash, margins = (
                np.frombuffer(at[name][i].as_buffer(), of) for name, of in (
                    ("codes", kind), ("label", np.float64), ("part", np.int32),
                    ("key_hash", np.uint64), ("margins", np.float64)))
            yield Block(codes.reshape(-1, n), label, part, key_hash, margins.reshape(-1, n),
                        at["key"][i].as_buffer())


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            held.append(batch.slice(start, most))
            n += held[-1].num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _written(column: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([column], names=["key"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def keys_of(block: Block) -> pa.Array:
    return pa.ipc.open_stream(block.key).read_all().column(0).combine_chunks()


def summed_blocks(blocks: Blocks, kind: type,
                  partial: Callable[[Iterator[Block]], np.ndarray], width: int,
                  most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by place over all rows, as ``summed``; ``partial`` gives a task's sums of all places."""
    schema = _sums_schema(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = partial(opened(batches, kind))
        places = np.flatnonzero(sums.any(axis=1))
        yield _sums_batch(places, sums[places], schema)

    return _added(blocks.table.mapInArrow(add, schema), schema,
                  blocks.tasks > FEW_TASKS or blocks.tasks * most > FEW_SUMS)


def summed(rows: Encoded, stored: DataFrame,
           partial: Callable[[Batch, pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
           width: int, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums by place over all rows: (places in order, one row of ``width`` sums each).

    ``partial`` gives (places, sums) of one task's rows, each place once; there are ``most`` places.
    A few tasks' sums are added on the driver; more are added by Spark, so that the driver gets one
    row per place.
    """
    schema = _sums_schema(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = gathered(batches)
        if raw is not None:
            yield _sums_batch(*partial(read(raw), raw), schema)

    return _added(stored.mapInArrow(add, schema), schema,
                  rows.files > FEW_TASKS or rows.files * most > FEW_SUMS)


def _sums_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField("place", T.LongType()), *[
        T.StructField(f"v{i}", T.DoubleType()) for i in range(width)]])


def _sums_batch(places: np.ndarray, sums: np.ndarray, schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int64()),
         *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(len(schema) - 1)]],
        names=schema.names)


def _added(table: DataFrame, schema: T.StructType, many: bool) -> tuple[np.ndarray, np.ndarray]:
    if many:
        table = table.groupBy("place").agg(*[F.sum(n).alias(n) for n in schema.names[1:]])
    table = table.toArrow()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, len(schema) - 1))
    places, which = np.unique(table.column("place").to_numpy(), return_inverse=True)
    return places, np.stack([np.bincount(which, table.column(n).to_numpy(), len(places))
                             for n in schema.names[1:]], axis=1)


def dense(places: np.ndarray, sums: np.ndarray, first: int, size: int) -> np.ndarray:
    """The sums of places first .. first + size, zero where there are none."""
    out = np.zeros((size, sums.shape[1]))
    low, high = np.searchsorted(places, (first, first + size))
    out[places[low:high] - first] = sums[low:high]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly; the same on every machine."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, *seeds: int) -> np.ndarray:
    """A number in [0, 1) per key, by hash."""
    salt = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for seed in seeds:
            salt = mixed(np.array([salt + np.uint64(seed + 1)], np.uint64))[0]
        return mixed(keys + salt).astype(float) / 2.0 ** 64
