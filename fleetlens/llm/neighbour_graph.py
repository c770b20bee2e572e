"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one node (its least keys answer for all, since ties go to smaller keys). The graph starts with the best of a
few cells: each node is compared within the cells of its ``CELLS`` nearest of a bounded sample of pivots, in blocks of
``CELL_BLOCK`` nodes. Each round then joins neighbours of neighbours: every node introduces its neighbours and some of those
that list it to each other, if one of them is new since the last round; a pair enters a list only if it is nearer than the
list's last. Rounds end when few lists change. A node is introduced through at most ``NEIGHBOURS`` lists that name it, which
bounds the work around hubs; this is the sampling that NN-descent itself has.

A query starts from its own neighbours (it is a row of the table) and keeps the ``POOL`` nearest nodes seen; all of them that
haven't been opened yet are opened at once, and the walk ends when there are none. All rounds are joins of (query, node)
pairs; vectors travel whole, as doubles scaled by one power of two, so that an outlier neither coarsens the others nor overflows
when squared, and all distances are doubles. The last step measures the pool on the original vectors.

Defined results: see ``taking_part`` for rows that take no part; vectors of zeros take none either; with at most k other rows
all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, by_group
from fleetlens.llm.vectors import best, matrix, taking_part, unpacked
from fleetlens.session import materialize

NEIGHBOURS, POOL, CELLS, CELL_BLOCK, ROUNDS = 20, 200, 3, 512, 8
#: share of changed list entries below which the graph counts as settled
SETTLED = 0.02
#: exponent of the greatest component that travels: its square, summed over all components, is far from overflow
GREATEST = 480
#: vectors per pivot that the number of pivots aims at, the most pivots, and the next blocks that a block of a cell meets
PER_PIVOT, PIVOTS, CIRCLE = 1000, 256, 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T))


def doubles(column: pa.Array) -> np.ndarray:
    return unpacked(column, "f8")


def slim_vectors(nodes: DataFrame, most: float) -> DataFrame:
    """(id, slim): components as doubles, scaled by the power of two that brings the greatest one to about ``GREATEST``."""
    shift = int(GREATEST - np.frexp(most)[1])

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "slim": [v.tobytes() for v in np.ldexp(matrix(batch.column(1)), shift)]}

    return arrow_map(nodes, run, f"id {nodes.schema['id'].dataType.simpleString()}, slim binary")


def nearer(ids: np.ndarray, distance: np.ndarray, keep: np.ndarray, most: int) -> dict:
    """The ``most`` nearest kept partners of each row, as lists for the columns id, near, away."""
    distance = np.where(keep, distance, np.inf)
    part = np.argpartition(distance, most - 1, 1)[:, :most] if distance.shape[1] > most else np.tile(np.arange(distance.shape[1]), (len(ids), 1))
    away = np.take_along_axis(distance, part, 1)
    row, col = np.nonzero(np.isfinite(away))
    return {"id": ids[row].tolist(), "near": ids[part[row, col]].tolist(), "away": away[row, col].tolist()}


def first_lists(slim: DataFrame, kind: str) -> DataFrame:
    """Neighbours within shared cells, compared in pairs of blocks."""
    n = slim.count()
    sample = slim.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, n // PER_PIVOT))).collect()
    pivots = np.stack([np.frombuffer(r["slim"], "f8") for r in sample])

    def cells(batch: pa.RecordBatch) -> dict:
        part = np.argsort(squared(doubles(batch.column("slim")), pivots), 1)[:, :CELLS] if batch.num_rows else np.zeros((0, 1), int)
        each = part.shape[1]
        row = pa.array(np.repeat(np.arange(batch.num_rows), each))
        return {"id": batch.column("id").take(row), "cell": part.ravel(), "slim": batch.column("slim").take(row)}

    filed = materialize(arrow_map(slim, cells, f"id {kind}, cell int, slim binary"), "cells")
    sizes = filed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("blocks"))
    dealt = filed.join(F.broadcast(sizes), "cell")  # at most PIVOTS rows
    # a block meets itself and the next ones around the cell's circle of blocks: all of a small cell, linear work in a large one
    dealt = dealt.withColumn("mine", F.expr("pmod(xxhash64(id), blocks)").cast("int")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.least(F.lit(CIRCLE), F.floor(F.col("blocks") / 2).cast("int")))))
    dealt = dealt.withColumn("bi", F.explode(F.array_distinct(F.array(F.col("mine"), F.pmod(F.col("mine") - F.col("bj"), F.col("blocks")))))).select("cell", "bi", "bj", "id", "mine", "slim")

    def compare(group: pa.Table) -> dict:
        ids, mine, x = group.column("id").to_numpy(), group.column("mine").to_numpy(), doubles(group.column("slim"))
        keep = ~np.eye(len(ids), dtype=bool)
        if group.column("bj")[0].as_py():
            keep &= mine[:, None] != mine
        return nearer(ids, squared(x, x), keep, NEIGHBOURS)

    return by_group(dealt, ["cell", "bi", "bj"], compare, f"id {kind}, near {kind}, away double")


def nearest_lists(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of each node's edges (id, near, away, new); an edge that is there twice counts as old if one is."""
    one = edges.groupBy("id", "near").agg(F.min("away").alias("away"), F.min("new").alias("new"))
    return best(one, "id", k, F.col("away"), F.col("near")).drop("rank")


def introductions(graph: DataFrame, slim: DataFrame, kind: str) -> DataFrame:
    """Pairs of neighbours of one node that are nearer to each other than the last of their lists."""
    last = graph.groupBy("id").agg(F.when(F.count("*") >= NEIGHBOURS, F.max("away")).otherwise(float("inf")).alias("last"))
    listed = graph.select(F.col("id").alias("host"), F.col("near").alias("guest"), "new")
    naming = best(graph.select(F.col("near").alias("host"), F.col("id").alias("guest"), "new"), "host", NEIGHBOURS, F.desc("new"), F.xxhash64("host", "guest")).drop("rank")
    guests = listed.unionByName(naming).groupBy("host", "guest").agg(F.max("new").alias("new"))
    lively = guests.where("new").select("host").distinct()
    seated = guests.join(lively, "host", "left_semi").join(slim.join(last, "id", "left").withColumnRenamed("id", "guest"), "guest")

    def introduce(group: pa.Table) -> dict:
        ids, new, x = group.column("guest").to_numpy(), group.column("new").to_numpy(), doubles(group.column("slim"))
        last_of = group.column("last").to_numpy().astype("f8")
        last_of = np.where(np.isnan(last_of), np.inf, last_of)
        distance = squared(x, x)
        keep = (new[:, None] | new) & (distance < last_of[:, None]) & ~np.eye(len(ids), dtype=bool)
        return nearer(ids, distance, keep, NEIGHBOURS)

    return by_group(seated, ["host"], introduce, f"id {kind}, near {kind}, away double")


def descend(slim: DataFrame, kind: str) -> DataFrame:
    """The neighbour graph (id, near, away)."""
    graph = materialize(nearest_lists(first_lists(slim, kind).withColumn("new", F.lit(True))), "graph")
    for _ in range(ROUNDS):
        found = introductions(graph, slim, kind).withColumn("new", F.lit(True))
        after = materialize(nearest_lists(graph.withColumn("new", F.lit(False)).unionByName(found)), "graph")
        counts = after.agg(F.count("*").alias("n"), F.sum(F.col("new").cast("int")).alias("fresh")).first()
        graph = after
        if (counts["fresh"] or 0) <= SETTLED * counts["n"]:
            break
    return graph


def walk(graph: DataFrame, slim: DataFrame, queries: DataFrame, kind: str, pool: int) -> DataFrame:
    """(query, node) of the nearest nodes that greedy search finds."""
    back = best(graph.select(F.col("near").alias("id"), F.col("id").alias("near"), "away"), "id", 2 * NEIGHBOURS, F.col("away"), F.col("near")).select("id", "near")
    roads = materialize(graph.select("id", "near").unionByName(back).distinct(), "roads")
    asked = slim.join(queries, "id", "left_semi").select(F.col("id").alias("query"), F.col("slim").alias("mine"))

    def measured(pairs: DataFrame) -> DataFrame:
        """Distances of (query, node) pairs; queries' vectors meet nodes' vectors by two joins."""
        both = pairs.join(slim.withColumnRenamed("id", "node"), "node").join(asked, "query").select("query", "node", "slim", "mine")

        def run(batch: pa.RecordBatch) -> dict:
            gap = doubles(batch.column("slim")) - doubles(batch.column("mine")) if batch.num_rows else np.zeros((0, 1))
            return {"query": batch.column("query"), "node": batch.column("node"), "away": (gap * gap).sum(1)}

        return arrow_map(both, run, f"query {kind}, node {kind}, away double")

    def in_pool(rows: DataFrame) -> DataFrame:
        return best(rows, "query", pool, F.col("away"), F.col("node")).drop("rank")

    start = queries.join(roads, "id").select(F.col("id").alias("query"), F.col("near").alias("node"))
    seen = [materialize(measured(start), "walk")]  # a table per round: what was measured isn't written again
    kept = materialize(in_pool(seen[0].withColumn("opened", F.lit(False))), "pool")
    while not kept.where("not opened").isEmpty():
        fresh = kept.where("not opened").select("query", "node")
        past = reduce(DataFrame.unionByName, [s.select("query", "node") for s in seen])
        found = fresh.join(roads, fresh.node == roads.id).select("query", F.col("near").alias("node")).where("query != node").distinct().join(past, ["query", "node"], "left_anti")
        seen.append(materialize(measured(found), "walk"))
        kept = materialize(in_pool(kept.withColumn("opened", F.lit(True)).unionByName(seen[-1].withColumn("opened", F.lit(False)))), "pool")
    return kept.select("query", "node")


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, k: int = 10, pool: int = POOL) -> DataFrame:
    """(query_id, rank, key, score): each query's nearest rows found, by Euclidean distance."""
    is_query = F.col(key) % 100 == 0 if is_query is None else is_query
    rows = taking_part(df, key, vector).where(F.exists(vector, lambda x: x != 0))
    kind = df.schema[key].dataType.simpleString()
    members = materialize(rows.withColumn("asks", is_query).withColumn("place", F.row_number().over(same_vector(vector, key))), "vectors")
    nodes = members.where("place = 1").select(F.col(key).alias("id"), vector)
    most = nodes.agg(F.max(F.array_max(F.transform(vector, F.abs))).cast("double")).first()[0]
    found_schema = f"query_id {kind}, rank int, {key} {kind}, score double"
    if most is None:
        return df.sparkSession.createDataFrame([], found_schema)
    slim = materialize(slim_vectors(nodes, most), "slim-vectors")
    named = members.join(nodes.select(F.col("id"), F.col(vector).alias("_same")), F.col(vector) == F.col("_same")).drop("_same")
    asking = named.where("asks").select(F.col(key).alias("query_id"), "id")
    graph = descend(slim, kind)
    pairs = walk(graph, slim, asking.select("id").distinct(), kind, pool)
    pairs = pairs.unionByName(asking.select(F.col("id").alias("query"), F.col("id").alias("node")).distinct())
    # a node answers with its k + 1 least keys: more can't be among the k nearest of one query, which may be one of them
    answers = named.where(F.col("place") <= k + 1).select(F.col("id").alias("node"), F.col(key), F.col(vector).alias("theirs"))
    asked = named.where("asks").select(F.col("id").alias("query"), F.col(key).alias("query_id"), F.col(vector).alias("mine"))
    both = pairs.join(answers, "node").join(asked, "query").where(F.col("query_id") != F.col(key)).select("query_id", key, "mine", "theirs")

    def exact(batch: pa.RecordBatch) -> dict:
        gap = matrix(batch.column("mine")) - matrix(batch.column("theirs")) if batch.num_rows else np.zeros((0, 1))
        return {"query_id": batch.column("query_id"), key: batch.column(key), "score": np.sqrt((gap * gap).sum(1))}

    scored = arrow_map(both, exact, f"query_id {kind}, `{key}` {kind}, score double")
    return best(scored, "query_id", k, F.col("score"), F.col(key)).select("query_id", "rank", key, "score")


def same_vector(vector: str, key: str):
    """Rows of one vector in order of their keys."""
    from pyspark.sql import Window

    return Window.partitionBy(vector).orderBy(key)
