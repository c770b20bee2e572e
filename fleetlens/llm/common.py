"""What the operators share: table access, Arrow helpers, hashing in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, null texts as empty ones; clashing columns of the caller stay out."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


#: ASCII letters, of which only upper case changes, and what stands between plain words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN, WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text: str) -> Column:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BETWEEN), "")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out anew by key, so that one file with long texts is not one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])


#: slots of a bitmap of keys, 64 of them to a row
SLOTS = 2**24


def likely_among(df: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """The rows whose key shares a hashed slot with one of ``others``: all rows that a join on it needs and few more, so that wide rows
    without a partner aren't shuffled. The bitmap of slots is broadcast; it has at most ``SLOTS`` / 64 rows, whatever the tables."""
    def slot(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(SLOTS))

    word, bits, at = unused(df, "slot_word"), unused(df, "slot_bits"), slot(key)
    slots = others.select(slot(other).alias("slot"))
    marks = slots.groupBy(F.floor(F.col("slot") / 64).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias(bits))
    marked = F.call_function("getbit", F.col(bits), (at % 64).cast("int")) == 1
    return df.join(F.broadcast(marks), (F.floor(at / 64) == F.col(word)) & marked, "left_semi")


def slices(batch: pa.RecordBatch, most: int | None) -> Iterator[pa.RecordBatch]:
    """The batch, or parts of it of at most so many rows; a batch without rows is one part."""
    most = most or max(1, batch.num_rows)
    return (batch.slice(k, most) for k in range(0, max(1, batch.num_rows), most))


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str, most: int | None = None) -> DataFrame:
    """``mapInArrow`` for a function that returns the columns of a batch as a dict of arrays; it gets at most ``most`` rows at once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, most)):
            columns = function(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array | pa.ChunkedArray) else columns[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the published splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles strictly between 0 and 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], 0)) + 1
        for s, e in zip(np.r_[0, change], np.r_[change, batch.num_rows], strict=True):
            here = tuple(c[s] for c in columns)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """Rows dealt by the keys; the function takes one table per key and returns columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in target]
        for group in grouped(batches, keys):
            got = function(group)
            for column, f in zip(held, target, strict=True):
                column.extend(got[f.name])
            if len(held[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, target, strict=True)], schema=target)
                held = [[] for _ in target]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, target, strict=True)], schema=target)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
