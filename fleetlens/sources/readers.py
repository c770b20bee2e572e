"""Readers with declared schemas."""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import schemas
from fleetlens.columns import nan_to_null
from fleetlens.ordering import order_blocks
from fleetlens.session import materialize, scratch_path

PIECE_BYTES = 8192
COMPRESSED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|passthrough)$"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with header; only the selected columns are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return nan_to_null(df.select(*columns) if columns else df)


def read_gtfs(spark: SparkSession, folder: str, routes: list[str] | None = None) -> dict[str, DataFrame]:
    """routes, stops, trips and stop_times; ``routes`` keeps the trips of those routes."""
    tables = {name: read_csv(spark, f"{folder}/{name}.txt", schema) for name, schema in schemas.GTFS.items()}
    if routes:
        tables["routes"] = tables["routes"].filter(F.col("route_id").isin(routes))
        tables["trips"] = tables["trips"].filter(F.col("route_id").isin(routes))
    return tables


def read_running_times(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RUNNING_TIMES)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def weather_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per hour from JSON documents that hold parallel arrays under ``hourly``."""
    hourly = F.from_json(F.col(column), schemas.WEATHER_PAYLOAD)["hourly"]
    names = ["time", "temperature_2m", "relative_humidity_2m", "precipitation", "rain", "weather_code", "wind_speed_10m"]
    zipped = F.arrays_zip(*[F.col("h")[n].alias(n) for n in names])
    flat = payloads.select(hourly.alias("h")).select(F.explode(zipped).alias("r"))
    return flat.select(*[F.col("r")[n].alias(n) for n in names])


def replay(df: DataFrame, where: dict[str, object] | None = None, order: tuple[str, ...] = ("timestamp_utc",)) -> DataFrame:
    """Rows in time order, filtered by equality before the sort so the filter reaches the scan."""
    out = df
    for column, value in (where or {}).items():
        condition: Column = F.col(column) == F.lit(value)
        out = out.filter(condition)
    return out.orderBy(*order)


def write_replay_files(df: DataFrame, path: str, order: tuple[str, ...], rows_per_file: int = 1_000_000, least: int = 1) -> None:
    """Time-ordered files for a replayed stream, of bounded size; small tables are dealt over at least ``least``.

    The file source reads files by modification time, so the time ranges are
    written one after another; rows are tagged with their range and stored once.
    """
    spark = df.sparkSession
    stored = materialize(df, "replay-rows")
    rows = max(min(rows_per_file, -(-stored.count() // least)), 1)
    blocks = order_blocks(stored.select(order[0]), order[0], rows)
    ranged = scratch_path(spark, "replay-ranges")
    blocks.tag(stored, "_range").write.partitionBy("_range").parquet(ranged)
    source = spark.read.parquet(ranged)
    for number in range(len(blocks.cuts) + 1):
        part = source.filter(F.col("_range") == number).drop("_range")
        part.select(*df.columns).coalesce(1).sortWithinPartitions(*order).write.mode("append").parquet(path)


def replay_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of lines, each with its line end, as numbered pieces of bounded size; a task reads a part of a file in order."""
    part, number = None, 0
    for batch in batches:
        paths, starts, line = batch.column(0), batch.column(1).to_numpy(), batch.column(3)
        ends = np.frombuffer(line.buffers()[1], np.int32)[line.offset:line.offset + len(line) + 1]
        data = memoryview(line.buffers()[2]) if len(line) and ends[-1] > ends[0] else b""
        turns = [0, *(np.flatnonzero(np.diff(starts) != 0) + 1), len(starts)]
        # files change within a run of equal starts where both are small, so paths are compared too
        coded = pa.compute.dictionary_encode(paths).indices.to_numpy() if len(starts) else np.zeros(0, int)
        turns = sorted({*turns, *(np.flatnonzero(np.diff(coded) != 0) + 1)})
        for i, j in zip(turns, turns[1:]):
            path, start, size = paths[i].as_py(), int(starts[i]), batch.column(2)[i].as_py()
            if (path, start) != part:
                part, number = (path, start), 0
            cuts = list(range(int(ends[i]), int(ends[j]), PIECE_BYTES))
            found = [bytes(data[c:min(c + PIECE_BYTES, int(ends[j]))]) for c in cuts]
            n = len(found)
            if n:
                yield pa.record_batch({"file": pa.array([path] * n), "start": pa.array([start] * n, pa.int64()), "number": pa.array(range(number, number + n), pa.int64()),
                                       "size": pa.array([size] * n, pa.int64()), "data": pa.array(found, pa.binary())})
            number += n


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each file from its pieces in order, a batch in memory at a time.

    The line reader ends a last line that the file leaves open, and drops a byte order mark: the sizes tell both.
    """
    file, size, seen, plain, marked = None, 0, 0, None, None

    def told() -> pa.RecordBatch:
        mark = len(codecs.BOM_UTF8)
        if seen >= size:
            digest = plain
        elif seen + mark >= size and not seen + mark > size + 1:
            digest = marked
        else:
            raise ValueError(f"{file} changed while it was read")
        return pa.record_batch({"file": pa.array([file]), "sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for path, length, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
            if path != file:
                if file is not None:
                    yield told()
                file, size, seen, plain, marked = path, length, 0, hashlib.sha256(), hashlib.sha256(codecs.BOM_UTF8)
            held = memoryview(data.as_buffer())
            plain.update(held[:max(size - seen, 0)])
            marked.update(held[:max(size - seen - len(codecs.BOM_UTF8), 0)])
            seen += len(held)
    if file is not None:
        yield told()


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, path, size and SHA-256 of every file below a folder, hashed on the executors.

    Files of any size: parts are read as lines by all tasks, and one task per file hashes their bytes in order, so memory holds pieces and
    a line. Names that Spark's line reader would decompress are read whole, which limits such a file to 2 GB.
    """
    def reader(kind: str) -> DataFrameReader:
        return spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)

    compressed = F.lower("_metadata.file_name").rlike(COMPRESSED)
    files = reader("binaryFile").load(path)
    lines = reader("text").option("lineSep", "\n").load(path).where(~compressed).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line"))
    pieces = lines.mapInArrow(_pieces, "file string, start long, number long, size long, data binary")
    parts = max(4 * spark.sparkContext.defaultParallelism, 1)
    streamed = pieces.repartition(parts, "file").sortWithinPartitions("file", "start", "number").mapInArrow(_hashed, "file string, sha256 string")
    whole = files.where(compressed).select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256"))
    listed = files.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size_bytes"))
    bare = F.when(F.col("size_bytes") == 0, F.sha2(F.lit(b""), 256)).when(F.col("size_bytes") == 3, F.sha2(F.lit(codecs.BOM_UTF8), 256))  # files without a line
    return listed.join(streamed.unionByName(whole), "file", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "size_bytes", F.coalesce("sha256", bare).alias("sha256"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose fingerprint differs, appeared or vanished; an empty result means immutable sources."""
    b = before.select("path", F.col("sha256").alias("before"))
    a = after.select("path", F.col("sha256").alias("after"))
    return b.join(a, "path", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
