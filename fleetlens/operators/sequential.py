"""Sequential change detectors over ordered errors.

Page-Hinkley and the split-window detector fold a stream from a small state. A fold looks at whole stretches between alarms at
once: the deviation is an affine function of the one it starts from, its minimum a running minimum, and the halves of a window
are differences of running sums. The folds serve three uses: a single bounded group, blocks of a long key, and micro-batches of a stream.

Blocks of a long key are folded in parallel and compose: a block without an alarm takes deviation U to a*U + c and lowers the
minimum to its own, a block with one leaves with its own state. One scan over the blocks' summaries gives every block
its entry; a quiet key needs three rounds however many blocks it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.drift_windows import DriftConfig
from fleetlens.ordering import BLOCK, OrderBlocks, order_blocks
from fleetlens.session import materialize


@dataclass(frozen=True)
class PageHinkley:
    """Standardised cumulative deviation with decay; state is (deviation, minimum)."""

    mean: float = 38.77
    std: float = 46.85
    delta: float = 0.25
    threshold: float = 80.0
    alpha: float = 0.999

    name = "PageHinkley"
    start = (0.0, 0.0)

    @classmethod
    def from_config(cls, cfg: DriftConfig = DriftConfig()) -> "PageHinkley":
        spread = math.sqrt(max(cfg.reference_rmse**2 - cfg.reference_mae**2, 25.0))
        return cls(cfg.reference_mae, spread, cfg.ph_delta, cfg.ph_lambda, cfg.ph_alpha)

    def _stretches(self, state: Sequence[float], errors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(deviations, statistics, whether the last is an alarm) of consecutive stretches; the length doubles while it is quiet."""
        deviation, minimum = state
        steps = (np.abs(errors) - self.mean) / max(self.std, 5.0) - self.delta
        longest = int(math.log(0.01) / math.log(self.alpha)) + 1 if self.alpha < 1 else 1 << 16  # powers stay well above 0
        at, reach = 0, 64
        while at < len(steps):
            part = steps[at:at + min(reach, longest)]
            powers = self.alpha ** np.arange(1, len(part) + 1)
            moved = powers * (deviation + np.cumsum(part / powers))
            lows = np.minimum(np.minimum.accumulate(moved), minimum)
            values = np.maximum(moved - lows, 0.0)
            hit = np.flatnonzero(values >= self.threshold)
            end = hit[0] + 1 if len(hit) else len(part)
            yield moved[:end], values[:end], len(hit) > 0
            deviation, minimum = (0.0, 0.0) if len(hit) else (float(moved[-1]), float(lows[-1]))
            at, reach = at + end, 64 if len(hit) else 2 * reach

    def fold(self, state: Sequence[float], errors: np.ndarray):
        """(new state, statistic per row, severity per row); an alarm clears the state."""
        found = list(self._stretches(state, errors))
        statistics = np.concatenate([v for _, v, _ in found]) if found else np.empty(0)
        shares = ((1.5, "CRITICAL"), (1.0, "HIGH"), (0.6, "MEDIUM"))
        severities = np.select([statistics >= share * self.threshold for share, _ in shares], [name for _, name in shares], "NONE")
        deviation, minimum = map(float, state)
        for moved, _, alarm in found:
            deviation, minimum = (0.0, 0.0) if alarm else (float(moved[-1]), min(minimum, float(moved.min())))
        return (deviation, minimum), statistics, severities

    def summary(self, state: Sequence[float], errors: np.ndarray) -> tuple[tuple, list[float]]:
        """The state after a block, and (a, c, least deviation, alarm): how it would take other states on."""
        after, alarmed, least = state, False, math.inf
        for moved, _, alarm in self._stretches(state, errors):
            alarmed, least = alarmed or alarm, min(least, float(moved.min()))
            after = (0.0, 0.0) if alarm else (float(moved[-1]), min(after[1], float(moved.min())))
        share = self.alpha ** len(errors)
        return after, [share, after[0] - share * state[0], least, float(alarmed)]

    def entries(self, blocks: list[tuple[Sequence[float], Sequence[float], Sequence[float]]]) -> list[tuple]:
        """The state before each of a key's blocks, from what they did (entry, exit, summary) when they were last folded."""
        state, found = self.start, []
        for entry, after, (share, moved, least, alarmed) in blocks:
            same = np.allclose(entry, state, rtol=1e-12, atol=1e-9)
            state = tuple(entry) if same else state
            found.append(state)
            state = tuple(after) if same or alarmed else (share * state[0] + moved, min(state[1], least))
        return found

    @property
    def alarm_levels(self) -> tuple[str, ...]:
        return ("HIGH", "CRITICAL")


@dataclass(frozen=True)
class SplitWindow:
    """Compares the halves of the last values; state is (cooldown, *values)."""

    delta: float = 0.001
    max_window: int = 1000
    min_window: int = 200
    min_gain: float = 15.0
    cooldown: int = 100

    name = "ADWIN"
    start = (0.0,)

    @classmethod
    def from_config(cls, cfg: DriftConfig = DriftConfig()) -> "SplitWindow":
        return cls(cfg.adwin_delta)

    def fold(self, state: Sequence[float], errors: np.ndarray):
        """(new state, statistic per row, severity per row); an alarm keeps the newer half."""
        wait, kept = int(state[0]), np.asarray(state[1:], dtype=float)
        values = np.concatenate([kept, np.abs(errors)])
        total = np.concatenate([[0.0], np.cumsum(values)])
        squares = np.concatenate([[0.0], np.cumsum(values * values)])
        statistics, severities = np.zeros(len(errors)), np.full(len(errors), "NONE", dtype=object)
        low, i, reach = 0, 0, 64
        while i < len(errors):
            if wait > 0:
                skipped = min(wait, len(errors) - i)
                wait, i = wait - skipped, i + skipped
                continue
            high = len(kept) + 1 + np.arange(i, min(i + reach, len(errors)))
            low_at = np.maximum(low, high - self.max_window)
            n = high - low_at
            mid = low_at + n // 2
            older, newer = np.maximum(mid - low_at, 1), high - mid
            before, after = (total[mid] - total[low_at]) / older, (total[high] - total[mid]) / newer
            gap, mean = np.abs(after - before), (total[high] - total[low_at]) / n
            variance = np.maximum((squares[high] - squares[low_at]) / n - mean * mean, 0.0)
            cut = np.sqrt(2.0 * (1.0 / older + 1.0 / newer) * math.log(2.0 / self.delta)) * (np.sqrt(variance) + 1.0)
            full = n >= self.min_window
            hit = np.flatnonzero(full & (gap > cut) & (after > before) & (gap >= self.min_gain))
            end = hit[0] + 1 if len(hit) else len(high)
            statistics[i:i + end] = np.where(full, gap, 0.0)[:end]
            i, reach = i + end, 64 if len(hit) else min(2 * reach, 1 << 16)
            if len(hit):
                severities[i - 1] = "HIGH" if gap[end - 1] > 1.5 * cut[end - 1] else "MEDIUM"
                low, wait = int(mid[end - 1]), self.cooldown
        return (float(wait), *values[max(low, len(values) - self.max_window):].tolist()), statistics, severities

    def summary(self, state: Sequence[float], errors: np.ndarray) -> tuple[tuple, list[float]]:
        return self.fold(state, errors)[0], []

    def entries(self, blocks: list[tuple[Sequence[float], Sequence[float], Sequence[float]]]) -> list[tuple]:
        """A window is forgotten after ``max_window`` quiet rows, so the exit of the block before is mostly right at once."""
        return [self.start, *(tuple(after) for _, after, _ in blocks[:-1])]

    @property
    def alarm_levels(self) -> tuple[str, ...]:
        return ("MEDIUM", "HIGH")


Detector = PageHinkley | SplitWindow
RESULT = [T.StructField("detector", T.StringType()), T.StructField("statistic", T.DoubleType()),
          T.StructField("severity", T.StringType()), T.StructField("in_warning", T.IntegerType()), T.StructField("in_drift", T.IntegerType())]


def annotate(rows: pd.DataFrame, detector: Detector, state, error: str):
    """Rows in order with the detector's columns, and the state after them."""
    state, statistics, severities = detector.fold(state, rows[error].to_numpy(dtype=float))
    out = rows.assign(detector=detector.name, statistic=statistics, severity=severities)
    return out.assign(in_warning=out["severity"].isin(("LOW", "MEDIUM")).astype("int32"), in_drift=out["severity"].isin(detector.alarm_levels).astype("int32")), state


def _fields(df: DataFrame, columns: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in columns]


def detect(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, detector: Detector | Sequence[Detector],
           alarms_only: bool = True, blocks: OrderBlocks | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Output of one detector or of several per row of every key (alarm rows only by default), with the columns ``carry``.

    A key that fits one block is folded once, by all detectors in one pass. A longer key is cut into blocks
    that are folded in parallel from a guessed entry state; each round scans the blocks' summaries for better entries, and
    only (key, block) pairs whose entry changed are folded again. The loop ends when none does, at which point the result is
    the sequential one: round r settles at least the first r blocks of every key, and all of them up to the next alarm in three.
    """
    keys, order = list(keys), list(order)
    detectors = [detector] if isinstance(detector, Detector) else list(detector)
    columns = list(dict.fromkeys([*keys, *order, error, *carry]))
    narrow = df.select(*columns)
    blocks = blocks or order_blocks(narrow, order[0])
    schema = T.StructType(_fields(df, columns) + RESULT)

    def finish(rows: pd.DataFrame, states) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out = pd.concat([annotate(rows, d, state, error)[0] for d, state in states], ignore_index=True)
        out = out[out["in_drift"] == 1] if alarms_only else out
        return out[schema.names]

    if blocks.single:
        begin = [(d, d.start) for d in detectors]
        if not keys:
            one = narrow.withColumn("_k", F.lit(1))
            return one.groupBy("_k").applyInPandas(lambda g: finish(g[columns], begin), schema)
        return narrow.groupBy(*keys).applyInPandas(lambda g: finish(g, begin), schema)

    def entered(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        return finish(rows, [(detectors[d], tuple(state)) for d, state in sorted(zip(entries["_detector"], entries["entry"], strict=True), key=lambda x: x[0])])

    tagged = materialize(blocks.tag(narrow), "sequence")
    entries = _settled(tagged, keys, order, error, detectors)
    return tagged.groupBy(*keys, BLOCK).cogroup(entries.groupBy(*keys, BLOCK)).applyInPandas(entered, schema)


def _settled(tagged: DataFrame, keys: list[str], order: list[str], error: str, detectors: Sequence[Detector]) -> DataFrame:
    """(keys, block, number of the detector, entry) with the state in which a sequential fold enters each block.

    A round folds a block by all detectors whose entry changed, so its rows are shuffled once for all of them.
    """
    part, numbers = [*keys, BLOCK], T.ArrayType(T.DoubleType())
    which = T.StructField("_detector", T.IntegerType())
    names = T.StructType([*(tagged.schema[c] for c in part), which])
    known_schema = T.StructType([*names, *(T.StructField(c, numbers) for c in ("entry", "exit", "summary"))])
    moved_schema = T.StructType([*names, T.StructField("entry", numbers), T.StructField("was", numbers)])
    narrow = tagged.select(*dict.fromkeys([*part, *order, error]))  # a fold needs no carried columns

    def folded(rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        errors, out = rows.sort_values(order, kind="stable")[error].to_numpy(dtype=float), []
        for d, entry in zip(entries["_detector"], entries["entry"], strict=True):
            after, summary = detectors[d].summary(tuple(entry), errors)
            out.append([*[rows[c].iloc[0] for c in part], d, list(entry), list(after), list(summary)])
        return pd.DataFrame(out, columns=known_schema.names)

    def scanned(known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values(BLOCK, kind="stable")
        states = detectors[known["_detector"].iloc[0]].entries([tuple(x) for x in zip(known["entry"], known["exit"], known["summary"], strict=True)])
        return known[[*part, "_detector"]].assign(entry=[list(map(float, s)) for s in states], was=[list(x) for x in known["entry"]])[moved_schema.names]

    def joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        """A null key is a key like others, as in a grouping."""
        right = right.select(*[F.col(c).alias(f"_k_{c}") for c in on])
        return left.join(right, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on]), how)

    def fold(entries: DataFrame) -> DataFrame:
        rows = joined(narrow, entries.select(*part).distinct(), part, "left_semi")
        return rows.groupBy(*part).cogroup(entries.groupBy(*part)).applyInPandas(folded, known_schema)

    begin = F.explode(F.array(*[F.struct(F.lit(i).alias("_detector"), F.array(*[F.lit(float(v)) for v in d.start]).alias("entry")) for i, d in enumerate(detectors)]))
    first = tagged.select(*part).distinct().withColumn("_b", begin).select(*part, "_b.*")
    known = materialize(fold(materialize(first, "entries")), "folded-blocks")
    while True:
        # a row per block and detector: a key of 10^11 rows has some 100,000 blocks
        entries = materialize(known.groupBy(*keys, "_detector").applyInPandas(lambda g: scanned(g[known_schema.names]), moved_schema), "entries")
        changed = entries.filter(F.col("entry") != F.col("was")).drop("was")
        if changed.isEmpty():
            return entries.drop("was")
        known = materialize(joined(known, changed.select(*part, "_detector"), [*part, "_detector"], "left_anti").unionByName(fold(changed)), "folded-blocks")


def stream_detect(stream: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, detector: Detector,
                  alarms_only: bool = True) -> DataFrame:
    """The same detectors on a stream; the state of a key survives in the state store.

    Input files must be time-ordered: rows are sorted inside a micro-batch only.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    keys, order = list(keys), list(order)
    columns = list(dict.fromkeys([*keys, *order, error]))
    schema = T.StructType(_fields(stream, columns) + RESULT)
    state_schema = T.StructType([T.StructField("state", T.ArrayType(T.DoubleType()))])

    def step(_key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get[0]) if held.exists else detector.start
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out, state = annotate(rows, detector, state, error)
        held.update((list(state),))
        yield (out[out["in_drift"] == 1] if alarms_only else out)[schema.names]

    return stream.select(*columns).groupBy(*keys).applyInPandasWithState(
        step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
