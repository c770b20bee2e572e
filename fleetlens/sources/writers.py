"""Writers of derived tables, event logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of bounded size as one JSON document."""
    df.coalesce(1).write.mode("error").json(path)


def write_drift_events(df: DataFrame, path: str) -> None:
    """Drift events with their list and map columns, by kind."""
    df.write.mode("append").partitionBy("drift_type").parquet(path)


def stream_events(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())
