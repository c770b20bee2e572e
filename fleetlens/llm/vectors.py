"""Reading vector columns: which rows take part, and their components in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def taking_part(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of rows with a key and a vector of finite components; rows that share a key count once, by their least
    vector. Where lengths differ, the most frequent one counts (the longer of two) and other rows take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).groupBy(key).agg(F.min(vector).alias(vector))
    lengths = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()  # one row
    return rows.where(F.size(vector) == (lengths[0]["n"] if lengths else 0))


def matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a binary column, all of one size."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def best(df: DataFrame, query: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query in the order, with their ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)
