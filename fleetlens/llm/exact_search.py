"""Exact top-k inner products of integer vectors by a pivot-distance index.

Each vector is filed under its nearest pivot and its distance from it; in that order, vectors are packed into annuli of up to
``ANNULUS`` vectors that know their range of distances and greatest norm. Queries are packed into blocks the same way. For a query
q, a pivot p and an annulus with distances r1 to r2, the triangle inequality gives d(q, v) >= max(d(q, p) - r2, r1 - d(q, p)),
which with the greatest norm bounds the inner product (|q|^2 + |v|^2 - d^2) / 2; <q, p> + |q| * r2 bounds it as well.

Annuli are expanded by their bounds: a query block's best annuli give each query k scores, the worst of which is its
threshold; then come all other annuli with a bound that reaches a threshold, and where bounds stay below, the search stops.
Thresholds only skip work: the result is that of comparing each query with every vector.

The pivots are ``PIVOTS`` vectors with the smallest hashes of their keys; any choice gives the same result. Defined results: see
``taking_part`` for rows that don't take part; ties go to the smaller key; a query is no candidate of its own; with fewer
candidates than k all are returned; an empty table gives no rows. Scores are exact within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map
from fleetlens.llm.vectors import best, matrix, taking_part, unpacked
from fleetlens.session import materialize

SCALE, PIVOTS, ANNULUS, QUERY_BLOCK = 1024, 32, 512, 128


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * vectors).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype("f8"), b.astype("f8")
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where those are exact, else by 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.rint(a.astype("f8") @ b.astype("f8").T).astype(np.int64) if most < 2**52 else a @ b.T


def filed(df: DataFrame, key: str, vector: str, pivots: np.ndarray, scale: int) -> DataFrame:
    """(id, pivot, away, values): whole-number vectors with their nearest pivot and the distance from it."""
    def run(batch: pa.RecordBatch) -> dict:
        values = whole_numbers(matrix(batch.column(1)), scale)
        away = distances(values, pivots)
        nearest = away.argmin(1) if len(values) else np.zeros(0, int)
        return {"id": batch.column(0), "pivot": nearest.astype("i4"), "away": away[np.arange(len(values)), nearest], "values": [v.tobytes() for v in values]}

    return arrow_map(df.select(key, vector), run, f"id {df.schema[key].dataType.simpleString()}, pivot int, away double, values binary")


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Annuli: runs of up to ``size`` rows of one pivot in order of distance, with the bounds of what they hold."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pack() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            values = unpacked(t.column("values"), "i8").astype("f8")
            away = t.column("away").to_numpy()
            return pa.RecordBatch.from_pydict({"pivot": pa.array([t.column("pivot")[0].as_py()], pa.int32()), "low": [away.min()], "high": [away.max()], "norm": [float((values * values).sum(1).max())],
                                               "ids": pa.array([t.column("id").to_pylist()], pa.list_(t.schema.field("id").type)), "values": pa.array([b"".join(t.column("values").to_pylist())], pa.binary())})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                pivot = batch.column("pivot")[at].as_py()
                if held and (held[0].column("pivot")[0].as_py() != pivot or sum(h.num_rows for h in held) >= size):
                    yield pack()
                    held = []
                room = size - sum(h.num_rows for h in held)
                same = int((batch.column("pivot").slice(at, room).to_numpy() == pivot).sum())  # rows are in order of pivots
                held.append(batch.slice(at, same))
                at += same
        if held:
            yield pack()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "pivot", "away", "id").sortWithinPartitions("pivot", "away", "id")
    return dealt.mapInArrow(run, f"pivot int, low double, high double, norm double, ids array<{kind}>, values binary").withColumn("block", F.monotonically_increasing_id())


def reach(queries: np.ndarray, pivot: np.ndarray, low: float, high: float, norm: float) -> np.ndarray:
    """Upper bounds of the inner products of queries with an annulus's vectors."""
    queries = queries.astype("f8")
    own, away = (queries * queries).sum(1), np.sqrt(((queries - pivot) ** 2).sum(1))
    gap = np.maximum(0, np.maximum(away - high, low - away) * (1 - 1e-12) - 1e-6)
    return np.minimum((own + norm - gap * gap) / 2, queries @ pivot.astype("f8") + np.sqrt(own) * high) * (1 + np.sign(own) * 1e-12) + 1e-3


def top_products(df: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, k: int = 10, scale: int = SCALE, pivots: int = PIVOTS,
                 annulus: int = ANNULUS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, key, score) of each query's k greatest inner products."""
    is_query = F.col(key) % 100 == 0 if is_query is None else is_query
    rows = taking_part(df, key, vector)
    sample = rows.orderBy(F.xxhash64(key), key).limit(pivots).collect()  # the pivots
    kind = df.schema[key].dataType.simpleString()
    centres = whole_numbers(np.array([r[vector] for r in sample], "f8"), scale) if sample else np.zeros((1, 0), np.int64)
    index = materialize(filed(rows, key, vector, centres, scale), "pivot-index")
    blocks = materialize(packed(index, annulus), "annuli")
    asked = materialize(packed(index.join(rows.where(is_query).select(F.col(key).alias("id")), "id", "left_semi").select(*index.columns), query_block), "query-blocks")
    # bounds: each query block meets the annuli of every pivot; only the annuli's bounds travel
    outlines = blocks.select("pivot", "block", "low", "high", "norm")
    stated = asked.select(F.col("block").alias("asker"), F.col("values").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))).alias("pivot"))

    def bounded(batch: pa.RecordBatch, floors: bool) -> dict:
        keep, most = [], []
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            bounds = reach(np.frombuffer(row["queries"], "i8").reshape(-1, centres.shape[1]), centres[row["pivot"]], row["low"], row["high"], row["norm"])
            if not floors or (bounds >= np.array(row["floors"], "f8")).any():
                keep.append(i)
                most.append(float(bounds.max()))
        return {c: batch.column(c).take(pa.array(keep, pa.int64())) for c in ("asker", "block")} | {"most": most}

    def compared(batch: pa.RecordBatch) -> dict:
        """The k best of each query in an annulus, but for those below the query's floor."""
        out: dict[str, list] = {c: [] for c in ("query_id", key, "score")}
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            mine, theirs = np.array(row["askers"]), np.array(row["ids"])
            a, b = (np.frombuffer(row[c], "i8").reshape(-1, centres.shape[1]) for c in ("queries", "values"))
            score, floors = products(a, b), row.get("floors") or [-np.inf] * len(mine)
            for q in range(len(mine)):
                ok = np.flatnonzero((theirs != mine[q]) & (score[q] >= floors[q]))
                first = ok[np.lexsort((theirs[ok], -score[q, ok]))[:k]]
                out["query_id"] += [mine[q].item()] * len(first)
                out[key] += theirs[first].tolist()
                out["score"] += score[q, first].tolist()
        return out

    found = f"query_id {kind}, `{key}` {kind}, score long"
    askers = asked.select(F.col("block").alias("asker"), F.col("ids").alias("askers"), F.col("values").alias("queries"))
    bodies = blocks.select("block", "ids", "values")
    bounds = arrow_map(stated.join(outlines, "pivot"), lambda b: bounded(b, False), "asker long, block long, most double")
    # first expansion: the annuli with the highest bounds, enough for k scores each
    nearest = best(bounds, "asker", 2, F.desc("most"), F.col("block")).select("asker", "block")
    first = best(arrow_map(nearest.join(askers, "asker").join(bodies, "block"), compared, found), "query_id", k, F.desc("score"), F.col(key))
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(f"n = {k}").select("query_id", "floor")
    flat = asked.select(F.col("block").alias("asker"), F.posexplode("ids").alias("at", "query_id")).join(floors, "query_id", "left")
    by_asker = flat.groupBy("asker").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor")))), lambda x: x["floor"]).alias("floors"))
    by_asker = materialize(by_asker, "floors")  # a row per query block, as long as the block
    # second expansion: every annulus whose bound reaches a floor; all others stop here
    wanted = arrow_map(stated.join(by_asker, "asker").join(outlines, "pivot"), lambda b: bounded(b, True), "asker long, block long, most double").select("asker", "block")
    pairs = wanted.join(askers.join(by_asker, "asker"), "asker").join(bodies, "block").select("askers", "queries", "ids", "values", "floors")
    return best(arrow_map(pairs, compared, found), "query_id", k, F.desc("score"), F.col(key)).select("query_id", "rank", key, "score")
