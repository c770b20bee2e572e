"""Random forest regression: a task grows a whole tree from binned rows.

Spark's forest shuffles a histogram of every feature and bin for every node and partition, which for deep trees is far more
than the rows themselves. Here the rows travel once per tree as bin codes and a level of a tree is a few passes of numpy, so the
work is rows x features x levels. Settings, splits, gains, importances and predictions are those of ``RandomForestRegressor``:
Poisson weights, a random subset of features per node, ordered splits of categories by their mean, least rows of a child.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import RegressionModel, Regressor, _RandomForestRegressorParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize

CHUNK_ROWS = 4096
PIECE_ROWS = 1 << 17
PIECE_CELLS = 1 << 20
TREE = "tree long, feature binary, cut binary, leaf binary, sets binary, gains binary"


def columns_per_node(strategy: str, columns: int, trees: int) -> int:
    """Features tried at a node, as Spark reads ``featureSubsetStrategy``."""
    known = {"all": columns, "sqrt": ceil(sqrt(columns)), "log2": max(1, ceil(log2(columns))), "onethird": ceil(columns / 3)}
    if strategy == "auto":
        return known["all" if trees == 1 else "onethird"]
    if strategy in known:
        return known[strategy]
    amount = int(strategy) if strategy.isdigit() else ceil(float(strategy) * columns)
    if not 0 < amount:
        raise ValueError(f"featureSubsetStrategy {strategy!r}")
    return min(amount, columns)


def arities(features: DataFrame, column: str) -> dict[int, int]:
    """Values of every nominal feature, from the column's attributes."""
    attrs = features.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    return {a["idx"]: a["num_vals"] if "num_vals" in a else len(a["vals"]) for a in attrs.get("nominal", []) if "vals" in a or "num_vals" in a}


def find_cuts(features: DataFrame, numeric: list[int], bins: int) -> dict[int, np.ndarray]:
    """Upper ends of the bins of each numeric feature of ``x``, all rows read: between neighbouring values where
    there are few, else quantiles."""
    if not numeric:
        return {}
    shares = [i / bins for i in range(1, bins)]
    stats = features.agg(*[e for i in numeric for e in (
        F.percentile_approx(F.col("x")[i], shares, max(10_000, 10 * bins)).alias(f"q{i}"),
        F.approx_count_distinct(F.col("x")[i]).alias(f"d{i}"))]).first()
    few = [i for i in numeric if stats[f"d{i}"] <= 2 * bins]
    values = features.agg(*[F.sort_array(F.collect_set(F.col("x")[i] + F.lit(0.0))).alias(f"v{i}") for i in few]).first() if few else {}
    cuts = {}
    for i in numeric:
        exact = np.array(values[f"v{i}"]) if i in few else None
        if exact is not None and len(exact) <= bins:
            cuts[i] = (exact[:-1] + exact[1:]) / 2.0
        else:
            cuts[i] = np.unique(np.array(stats[f"q{i}"], dtype=float))
    return cuts


def coded(x: np.ndarray, cuts: dict[int, np.ndarray], kind: np.dtype) -> np.ndarray:
    """Bin of every value; a nominal feature is its own bin."""
    out = np.empty(x.shape, kind)
    for i in range(x.shape[1]):
        out[:, i] = np.searchsorted(cuts[i], x[:, i], "left") if i in cuts else x[:, i]
    return out


def _settled(codes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """An order of the rows that depends on their content alone, so that weights do not depend on files and partitions."""
    key = label.view(np.uint64).copy()
    for i in range(codes.shape[1]):
        key = (key ^ codes[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.argsort(key, kind="stable")


def grow(codes: np.ndarray, label: np.ndarray, nominal: np.ndarray, bins: int, tree: int, p: dict) -> dict[str, np.ndarray]:
    """One tree, level by level; all nodes of a level are split together, in pieces of bounded size.

    ``feature`` is -1 in a leaf, the children of a node are ``left`` and ``left + 1``, and rows up to ``cut`` go left. For a
    nominal feature ``cut`` is a row of ``sets``, whose bits are the categories that go left.
    """
    rng = np.random.default_rng([p["seed"] % (1 << 63), tree])
    n, width, share = len(label), codes.shape[1], p["subsamplingRate"]
    if p["bootstrap"] and p["numTrees"] > 1:
        weight = rng.poisson(share, n)
    else:
        weight = (rng.random(n) < share).astype(np.int64)
    here = np.flatnonzero(weight)
    codes, w = codes[here], weight[here].astype(float)
    middle = float(label.mean())
    wy = w * (label[here] - middle)
    tried, least = p["tried"], float(p["minInstancesPerNode"])
    floor = 1e-12 * max(float(label.var()), 1e-300)
    wide = nominal.any()
    node = np.zeros(len(here), np.int64)  # number within the level; rows are kept in this order
    total, sums = np.array([w.sum()]), np.array([wy.sum()])
    ids = np.zeros(1, np.int64)
    made = 1
    out = {k: [] for k in ("id", "feature", "cut", "left", "value", "gain", "rows")}
    sets: list[np.ndarray] = []
    in_sets = 0
    for depth in range(p["maxDepth"] + 1):
        m = len(total)
        feature, cut, left, gain = np.full(m, -1, np.int16), np.full(m, -1, np.int32), np.full(m, -1, np.int32), np.zeros(m)
        starts = np.searchsorted(node, np.arange(m + 1))
        masks: list[tuple[np.ndarray, np.ndarray]] = []
        many = max(1, PIECE_CELLS // (tried * bins)) if depth < p["maxDepth"] else m
        for a in range(0, m, many) if depth < p["maxDepth"] else ():
            b = min(a + many, m)
            subset = np.argsort(rng.random((b - a, width)), axis=1)[:, :tried] if tried < width else np.tile(np.arange(width), (b - a, 1))
            cells = (b - a) * tried * bins
            count, mass = np.zeros(cells), np.zeros(cells)
            for i in range(starts[a], starts[b], PIECE_ROWS):
                j = min(i + PIECE_ROWS, starts[b])
                own = node[i:j] - a
                at = np.take_along_axis(codes[i:j], subset[own], axis=1).astype(np.int64)
                at += (own[:, None] * tried + np.arange(tried)) * bins
                at = at.ravel()
                count += np.bincount(at, np.repeat(w[i:j], tried), cells)
                mass += np.bincount(at, np.repeat(wy[i:j], tried), cells)
            count, mass = count.reshape(b - a, tried, bins), mass.reshape(b - a, tried, bins)
            order = None
            if wide:
                which = nominal[subset]
                c, s = count[which], mass[which]
                order = np.argsort(np.where(c > 0, s / np.maximum(c, 1.0), np.inf), axis=1, kind="stable")
                count[which], mass[which] = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            lower, low = np.cumsum(count, axis=2)[:, :, :-1], np.cumsum(mass, axis=2)[:, :, :-1]
            n_all, s_all = total[a:b, None, None], sums[a:b, None, None]
            upper, high = n_all - lower, s_all - low
            fine = (lower >= least) & (upper >= least)
            won = np.where(fine, low * low / np.maximum(lower, 1.0) + high * high / np.maximum(upper, 1.0) - s_all * s_all / n_all, -np.inf)
            won = won.reshape(b - a, -1) / total[a:b, None]
            best = won.argmax(axis=1)
            size = won[np.arange(b - a), best]
            split = np.flatnonzero((size > floor) & (size >= p["minInfoGain"]))
            slot, at = best[split] // (bins - 1), best[split] % (bins - 1)
            feature[a + split], cut[a + split], gain[a + split] = subset[split, slot], at, size[split]
            if wide:
                place = np.full(which.shape, -1, np.int64)
                place[which] = np.arange(len(order))
                row = place[split, slot]
                chosen = np.flatnonzero(row >= 0)
                goes = np.zeros((len(chosen), bins), bool)
                first = np.arange(bins)[None, :] <= at[chosen, None]
                np.put_along_axis(goes, order[row[chosen]], first, 1)
                goes &= _seen(codes, starts, a + split[chosen], feature[a + split[chosen]], bins)
                masks.append((a + split[chosen], goes))
        parts = np.flatnonzero(feature >= 0)
        left[parts] = made + 2 * np.arange(len(parts))
        table = np.zeros((0, bins), bool)
        if masks:
            held = np.concatenate([x for x, _ in masks])
            table = np.concatenate([x for _, x in masks])
            cut[held] = in_sets + np.arange(len(held))
            sets.append(np.packbits(table, axis=1))
        for k, v in (("id", ids), ("feature", feature), ("cut", cut), ("left", left), ("value", sums / total + middle), ("gain", gain), ("rows", total)):
            out[k].append(v)
        if not len(parts):
            break
        # rows of split nodes go on, to the left child or the right one
        on = feature[node] >= 0
        codes, w, wy, node = codes[on], w[on], wy[on], node[on]
        f = feature[node]
        value = codes[np.arange(len(node)), f].astype(np.int64)
        goes_left = value <= cut[node]
        if len(table):
            named = np.flatnonzero(nominal[f])
            goes_left[named] = table[cut[node[named]] - in_sets, value[named]]
            in_sets += len(table)
        rank = np.full(m, -1, np.int64)
        rank[parts] = np.arange(len(parts))
        node = 2 * rank[node] + ~goes_left
        order = np.argsort(node, kind="stable")
        codes, w, wy, node = codes[order], w[order], wy[order], node[order]
        total, sums = np.bincount(node, w, 2 * len(parts)), np.bincount(node, wy, 2 * len(parts))
        ids = made + np.arange(2 * len(parts))
        made += 2 * len(parts)
    joined = {k: np.concatenate(v) for k, v in out.items() if k != "id"}
    joined["sets"] = np.concatenate(sets) if sets else np.zeros((0, -(-bins // 8)), np.uint8)
    return joined


def _seen(codes: np.ndarray, starts: np.ndarray, nodes: np.ndarray, features: np.ndarray, bins: int) -> np.ndarray:
    """Which categories of its feature a node has; one that it lacks goes right."""
    sizes = starts[nodes + 1] - starts[nodes]
    at = np.repeat(np.arange(len(nodes)), sizes)
    rows = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[nodes][at]
    seen = np.zeros((len(nodes), bins), bool)
    seen[at, codes[rows, features[at]]] = True
    return seen


def walk(trees: list[dict[str, np.ndarray]], codes: np.ndarray, nominal: np.ndarray) -> np.ndarray:
    """Mean of the trees' leaves for every row."""
    every, total = np.arange(len(codes)), np.zeros(len(codes))
    for t in trees:
        node, rows = np.zeros(len(codes), np.int64), every
        while len(rows):
            f = t["feature"][node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            at = node[rows]
            value, cut = codes[rows, f].astype(np.int64), t["cut"][at]
            left = value <= cut
            named = np.flatnonzero(nominal[f])
            left[named] = (t["sets"][cut[named], value[named] >> 3] >> (7 - (value[named] & 7))) & 1 == 1
            node[rows] = t["left"][at] + ~left
        total += t["value"][node]
    return total / len(trees)


def packed(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What a tree needs: children follow from the order of the inner nodes, and only leaves have values."""
    small = np.min_scalar_type(-1 - int(t["cut"].max(initial=0)))
    return {"feature": t["feature"], "cut": t["cut"].astype(small), "leaf": t["value"][t["feature"] < 0], "sets": t["sets"]}


class Trees:
    """Packed trees, unpacked once in every process that walks them."""

    def __init__(self, packs: list[dict[str, np.ndarray]]):
        self.packs, self._open = packs, None

    def __getstate__(self):
        return {"packs": self.packs, "_open": None}

    def open(self) -> list[dict[str, np.ndarray]]:
        if self._open is None:
            self._open = []
            for t in self.packs:
                inner = t["feature"] >= 0
                value = np.zeros(len(inner))
                value[~inner] = t["leaf"]
                self._open.append(t | {"left": np.where(inner, 2 * np.cumsum(inner) - 1, -1).astype(np.int32), "value": value})
        return self._open


class ForestRegressor(Regressor, _RandomForestRegressorParams):
    """Parameters are those of Spark's regressor. Rows always remember their node, and memory does not grow with
    the nodes of a pass, so ``cacheNodeIds`` and ``maxMemoryInMB`` change nothing."""

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def _settings(self, width: int) -> dict:
        if self.getOrDefault("impurity") != "variance" or self.getOrDefault("leafCol") or self.getOrDefault("minWeightFractionPerNode") or self.isDefined("weightCol"):
            raise ValueError("the forest has no weights, leaf numbers or other impurities than the variance")
        names = ("numTrees", "maxDepth", "minInstancesPerNode", "minInfoGain", "seed", "subsamplingRate", "bootstrap")
        p = {n: self.getOrDefault(n) for n in names}
        return p | {"tried": columns_per_node(self.getOrDefault("featureSubsetStrategy"), width, p["numTrees"])}

    def _fit(self, dataset: DataFrame) -> "ForestModel":
        column, target = self.getFeaturesCol(), self.getLabelCol()
        nominal = arities(dataset, column)
        rows = dataset.select(vector_to_array(F.col(column)).alias("x"), F.col(target).cast("double").alias("y"))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").isNotNull() & ~F.isnan("y")).alias("known"), F.max(F.size("x")).alias("width")).first()
        if not size["n"] or size["known"] < size["n"]:
            raise ValueError("a forest needs rows, each with a label")
        bins, width = min(self.getOrDefault("maxBins"), size["n"]), size["width"]
        if nominal and max(nominal.values()) > bins:
            if max(nominal.values()) > self.getOrDefault("maxBins"):
                raise ValueError(f"maxBins {bins} is less than the values of a nominal feature")
            bins = max(nominal.values())
        bins = max(bins, 2)
        p, kind = self._settings(width), np.min_scalar_type(bins)
        cuts = find_cuts(rows, [i for i in range(width) if i not in nominal], bins)
        named = np.array([i in nominal for i in range(width)])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for i in range(0, len(y), CHUNK_ROWS):
                    codes = coded(x[i:i + CHUNK_ROWS], cuts, kind)
                    yield pa.record_batch({"codes": pa.array([codes.tobytes()], pa.binary()), "label": pa.array([y[i:i + CHUNK_ROWS].tobytes()], pa.binary())})

        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, label, tree = [], [], None
            for batch in batches:
                for c, y, t in zip(batch.column(0), batch.column(1), batch.column(2)):
                    codes.append(np.frombuffer(c.as_buffer(), kind).reshape(-1, width).copy())
                    label.append(np.frombuffer(y.as_buffer(), float).copy())
                    tree = t.as_py()
            if tree is None:
                return
            codes, label = np.concatenate(codes), np.concatenate(label)
            order = _settled(codes, label)
            grown = grow(codes[order], label[order], named, bins, tree, p)
            inner = grown["feature"] >= 0
            gains = np.bincount(grown["feature"][inner], (grown["gain"] * grown["rows"])[inner], width)
            kept = packed(grown) | {"gains": gains}
            yield pa.record_batch({"tree": pa.array([tree], pa.int64()), **{k: pa.array([kept[k].tobytes()], pa.binary()) for k in ("feature", "cut", "leaf", "sets", "gains")}})

        spark = dataset.sparkSession
        chunks = materialize(rows.mapInArrow(encode, "codes binary, label binary"), "forest-rows").coalesce(1)
        # a partition for each tree, through which the rows stream from the shared folder
        pairs = chunks.hint("shuffle_replicate_nl").crossJoin(spark.range(0, p["numTrees"], 1, p["numTrees"]).withColumnRenamed("id", "tree"))
        packs, gains = [], []
        for r in sorted(pairs.select("codes", "label", "tree").mapInArrow(plant, TREE).collect(), key=lambda r: r["tree"]):
            feature = np.frombuffer(r["feature"], np.int16)
            packs.append({"feature": feature, "cut": np.frombuffer(r["cut"], f"i{len(r['cut']) // len(feature)}"), "leaf": np.frombuffer(r["leaf"], float),
                          "sets": np.frombuffer(r["sets"], np.uint8).reshape(-1, -(-bins // 8))})
            gains.append(np.frombuffer(r["gains"], float))
        return self._copyValues(ForestModel(Trees(packs), np.array(gains), cuts, named, kind))


class ForestModel(RegressionModel, _RandomForestRegressorParams):
    """Grown trees as arrays, and each tree's gains times rows per feature; scoring broadcasts the trees once."""

    def __init__(self, trees: Trees, gains: np.ndarray, cuts: dict[int, np.ndarray], nominal: np.ndarray, kind: np.dtype):
        super().__init__()
        self.trees, self.gains, self.cuts, self.nominal, self.kind = trees, gains, cuts, nominal, kind
        self._shipped = None

    @property
    def numFeatures(self) -> int:
        return len(self.nominal)

    @property
    def featureImportances(self) -> DenseVector:
        """Gains times rows per feature, of equal weight in every tree, normalised."""
        total = (self.gains / np.maximum(self.gains.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    @property
    def toDebugString(self) -> str:
        lines = [f"ForestModel: uid={self.uid}, numTrees={len(self.gains)}, numFeatures={self.numFeatures}"]

        def told(t: dict, node: int, depth: int) -> None:
            pad, f = " " * (depth + 2), t["feature"][node]
            if f < 0:
                lines.append(f"{pad}Predict: {t['value'][node]}")
                return
            bits = np.flatnonzero(np.unpackbits(t["sets"][t["cut"][node]])) if self.nominal[f] else None
            rule = f"in {{{','.join(map(str, bits))}}}" if bits is not None else f"<= {self.cuts[f][t['cut'][node]]}"
            lines.append(f"{pad}If (feature {f} {rule})")
            told(t, t["left"][node], depth + 1)
            lines.append(f"{pad}Else (feature {f} not {rule})")
            told(t, t["left"][node] + 1, depth + 1)

        for number, t in enumerate(self.trees.open()):
            lines.append(f"  Tree {number} (weight 1.0):")
            told(t, 0, 2)
        return "\n".join(lines)

    def predict(self, value) -> float:
        x = np.asarray(value.toArray(), float)[None, :]
        return float(walk(self.trees.open(), coded(x, self.cuts, self.kind), self.nominal)[0])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._shipped is None:
            self._shipped = dataset.sparkSession.sparkContext.broadcast(self.trees)
        shipped, cuts, nominal, kind, width = self._shipped, self.cuts, self.nominal, self.kind, self.numFeatures

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            return pa.array(walk(shipped.value.open(), coded(values, cuts, kind), nominal), pa.float64())

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(self.getFeaturesCol()))))
