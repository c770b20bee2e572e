"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each word enters with word inputs (how much more often it stands in toxic training documents), character inputs (the same for
its character n-grams and its beginning) and a trained embedding of its character trigrams. A run of more than ``PIECE`` word
characters (long identifiers, clauses of scripts without spaces) counts as several words: pieces that overlap by ``OVERLAP``
characters, so that each n-gram of the run stands whole in one of them. Forward and backward gated
recurrent units read windows of ``WINDOW`` words that start every ``STRIDE`` words, so that windows overlap; attention pools each
window into one logit. A document's logit is that of its worst window, calibrated on the training documents. A training
document sees frequencies without its own words (leave one out), else rare words would look telling.

Training is one task. It takes at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` clean labelled documents, those with the smallest hashes of their
ids; this bounds what reaches that task. Scoring covers every word of every document.

Defined results: null and empty texts get the calibrated logit of an empty window; without labels of both kinds each score is
the share of toxic labels (0.5 without any); equal texts get equal scores; a null key can't be labelled and is scored; several
labels of one document count as toxic if any is; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, keyed_text

WINDOW, STRIDE, HIDDEN, ATTENTION = 48, 36, 8, 8
TRAIN_TOXIC, TRAIN_CLEAN = 1000, 2000
TRIGRAMS, EMBEDDED, TOLD = 4096, 6, 6
#: bytes of words and their inputs that a worker remembers, and what a word takes besides its letters and inputs
REMEMBERED, PER_WORD = 60_000_000, 200
THRESHOLD = 0.7
#: windows that are scored together, and fresh words that are looked up together
SCORED, LOOKED_UP = 2048, 20_000
#: rows whose texts a worker holds as Python strings
ROWS = 500
#: most characters of a word, and how many of them the next piece of a longer run repeats; n-grams have at most 5
PIECE, OVERLAP = 40, 8
WORD = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """The words of a text; longer runs as overlapping pieces that cover them."""
    words = WORD(text.lower())
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[s:s + PIECE] for w in words for s in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]


def grams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]


def trigram_rows(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[i:i + 3].encode("utf-8", "replace")) % TRIGRAMS for i in range(len(marked) - 2)]


def trigram_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``trigram_rows`` of all words, one after another, and how many each has; equal trigrams are hashed once."""
    sizes = np.fromiter(map(len, words), int, len(words))
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at = np.arange(sizes.sum()) + 2 * np.repeat(np.arange(len(words)), sizes)
    found, place = np.unique(points[at] << np.uint64(42) | points[at + 1] << np.uint64(21) | points[at + 2], return_inverse=True)
    parts = (found >> np.uint64(42), found >> np.uint64(21) & np.uint64(2**21 - 1), found & np.uint64(2**21 - 1))
    texts = zip(*(map(chr, p.tolist()) for p in parts), strict=True)
    return np.fromiter((zlib.crc32("".join(t).encode("utf-8", "replace")) % TRIGRAMS for t in texts), int, len(found))[place], sizes


class Evidence:
    """What single words and character n-grams tell, as log odds of their document frequencies."""

    def __init__(self, word_odds: dict[str, float], gram_odds: dict[str, float]) -> None:
        self.word_odds, self.gram_odds = word_odds, gram_odds

    def inputs(self, words: list[str]) -> np.ndarray:
        """The told inputs of words: their own odds; highest, mean, highest at the beginning and lowest of their n-grams; their length."""
        if not words:
            return np.zeros((0, TOLD), "f4")
        chars = np.fromiter(map(len, words), int, len(words))
        threes, fours, fives = (np.maximum(chars + 3 - n, 0) for n in (3, 4, 5))  # n-grams of a marked word, shorter ones first
        sizes = threes + fours + fives
        starts = np.cumsum(sizes) - sizes
        g = np.fromiter(map(self.gram_odds.get, chain.from_iterable(map(grams, words)), repeat(0.0)), float, sizes.sum())
        opening = g[starts]
        for some, before in ((fours, threes), (fives, threes + fours)):
            has = some > 0
            opening[has] = np.maximum(opening[has], g[(starts + before)[has]])
        own = np.fromiter(map(self.word_odds.get, words, repeat(0.0)), float, len(words))
        return np.stack([own, np.maximum.reduceat(g, starts), np.add.reduceat(g, starts) / sizes, opening, np.minimum.reduceat(g, starts), np.minimum(chars, 20) / 10 - 1], 1).astype("f4")


def log_odds(toxic: np.ndarray, clean: np.ndarray, scale: float) -> np.ndarray:
    """Smoothed by half a document of each kind, so what is seen once tells little; what tells little counts as 0."""
    odds = np.log((toxic + 0.5) / (clean * scale + 0.5))
    return np.where((toxic + clean > 0) & (np.abs(odds) > 0.2), odds, 0.0)


def gathered_evidence(words: list[str], documents: list[np.ndarray], labels: np.ndarray) -> tuple[Evidence, np.ndarray]:
    """Evidence, and the told inputs of each word as clean (rows from 0) and toxic (rows from len(words)) documents see them:
    without the one document that they are."""
    index: dict[str, int] = {}
    parts = [[index.setdefault(g, len(index)) for g in grams(w)] for w in words]
    sizes = np.array([len(x) for x in parts], int)
    flat, starts = np.array([g for x in parts for g in x], int), np.r_[0, np.cumsum(sizes)[:-1]]
    opening = np.array([g[0] == "<" for g in index], bool)
    word_counts, gram_counts = np.zeros((2, len(words))), np.zeros((2, len(index)))
    for ids, y in zip(documents, labels, strict=True):
        used = np.unique(ids)
        word_counts[y, used] += 1
        at = np.repeat(starts[used] - np.r_[0, np.cumsum(sizes[used])[:-1]], sizes[used]) + np.arange(sizes[used].sum()) if len(used) else used
        gram_counts[y, np.unique(flat[at])] += 1
    scale = (labels == 1).sum() / max(1, (labels == 0).sum())

    def seen(toxic_less: int, clean_less: int) -> tuple[np.ndarray, np.ndarray]:
        less = np.array([[clean_less], [toxic_less]])
        w, g = (np.maximum(c - less, 0) for c in (word_counts, gram_counts))
        return log_odds(w[1], w[0], scale), log_odds(g[1], g[0], scale)

    tables = []
    for less in ((0, 1), (1, 0)):
        w, g = seen(*less)
        g = g[flat]
        tables.append(np.stack([w, np.maximum.reduceat(g, starts), np.add.reduceat(g, starts) / sizes, np.maximum.reduceat(np.where(opening[flat], g, -np.inf), starts),
                                np.minimum.reduceat(g, starts), np.minimum([len(x) for x in words], 20) / 10 - 1], 1) if words else np.zeros((0, TOLD)))
    w, g = seen(0, 0)
    return Evidence({x: float(v) for x, v in zip(words, w, strict=True) if v}, {x: float(v) for x, v in zip(index, g, strict=True) if v}), np.concatenate(tables).astype("f4")


class Ragged:
    """Lists of rows, one after another."""

    def __init__(self, lists: list[list[int]]) -> None:
        self.sizes = np.array([len(x) for x in lists], int)
        self.flat, self.starts = np.array([r for x in lists for r in x], int), np.r_[0, np.cumsum(self.sizes)[:-1]]

    def of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the chosen lists, and their sizes."""
        sizes = self.sizes[chosen]
        return self.flat[np.repeat(self.starts[chosen] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())], sizes


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row, over n rows."""
    out = np.zeros((n, values.shape[1]), "f4")
    if len(rows):
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(values[order], first)
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping windows that cover n words; one empty window for no words."""
    return [(s, min(s + WINDOW, n)) for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and the forward and backward passes. Units read projections of inputs, so a word is projected once."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        wide, h = EMBEDDED + TOLD, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype("f4")
        self.p = {"E": draw(TRIGRAMS, EMBEDDED) * 3, "Wa": draw(2 * h, ATTENTION), "va": draw(ATTENTION), "wo": draw(2 * h), "bo": np.zeros(1, "f4")}
        for d in "fb":
            self.p |= {f"W{d}": draw(wide, 3 * h), f"U{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, "f4")}

    def embed(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.p["E"][flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None].astype("f4")

    def project(self, inputs: np.ndarray) -> np.ndarray:
        return np.concatenate([inputs @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], 1).astype("f4")

    def unit(self, x: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
        """States (time, batch, hidden) of one direction over x (time, batch, 3 * hidden)."""
        steps, batch, _ = x.shape
        h, out, n = np.zeros((batch, HIDDEN), "f4"), np.empty((steps, batch, HIDDEN), "f4"), HIDDEN
        for t in range(steps - 1, -1, -1) if back else range(steps):
            u = h @ U
            zr = sigmoid(x[t, :, :2 * n] + u[:, :2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[t, :, 2 * n:] + r * u[:, 2 * n:])
            new = c + z * (h - c)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, u, z, r, c, m))
            h = np.where(m, new, h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; x (time, batch, 6 * hidden) holds projections for both directions."""
        n = 3 * HIDDEN
        kf, kb = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self.unit(x[:, :, :n], mask, self.p["Uf"], False, kf), self.unit(x[:, :, n:], mask, self.p["Ub"], True, kb)], 2)
        a = np.tanh(states @ self.p["Wa"])
        score = np.where(mask, a @ self.p["va"], -1e9)
        weight = np.exp(score - score.max(0)) * mask
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "states": states, "a": a, "weight": weight, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def backward(self, kept: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the projections, and of the projections."""
        p, g = self.p, {}
        states, a, weight = kept["states"], kept["a"], kept["weight"]
        g["wo"], g["bo"] = kept["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["wo"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["va"] = np.tensordot(d_score, a, 2)
        d_a = d_score[:, :, None] * p["va"] * (1 - a * a)
        g["Wa"] = np.tensordot(states, d_a, ([0, 1], [0, 1]))
        d_states = d_states + d_a @ p["Wa"].T
        n, parts = HIDDEN, []
        for d, part in (("f", d_states[:, :, :n]), ("b", d_states[:, :, n:])):
            U, gU = p[f"U{d}"], np.zeros_like(p[f"U{d}"])
            dx, dh = np.zeros((*part.shape[:2], 3 * n), "f4"), np.zeros(part.shape[1:], "f4")
            for t, h, u, z, r, c, m in reversed(kept[d]):
                dh = dh + part[t]
                dn = np.where(m, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * u[:, 2 * n:] * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                gU += h.T @ du
                dh = np.where(m, 0, dh) + dn * z + du @ U.T
            g[f"U{d}"] = gU
            parts.append(dx)
        return g, np.concatenate(parts, 2)


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def gather(table: np.ndarray, ids: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for windows, time first, and the mask of places that hold a word."""
    steps = max(1, max(e - s for s, e in spans))
    start, end = np.array(spans).T
    at = start + np.arange(steps)[:, None]
    mask = at < end
    return table[ids[np.minimum(at, len(ids) - 1)]] if len(ids) else np.zeros((steps, len(spans), table.shape[1]), "f4"), mask


def train(documents: list[tuple[str, int]], seed: int = 7, rounds: int = 5, passes: int = 3) -> dict:
    """Fit evidence, network and calibration on (text, toxic) pairs. A plain dict of what scoring needs."""
    labels = np.array([y for _, y in documents], int)
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    plain = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], int) for t, _ in documents]
    vocabulary = list(index) or [""]
    evidence, told = gathered_evidence(list(index), plain, labels) if index else (Evidence({}, {}), np.zeros((2, TOLD), "f4"))
    ids = [i + len(index) * y for i, y in zip(plain, labels, strict=True)]  # words as their document's label sees them
    trigrams = Ragged([trigram_rows(w) or [0] for w in vocabulary])
    net, flat = Network(seed), np.concatenate(ids)
    offset = np.r_[0, np.cumsum([len(i) for i in ids])[:-1]]
    owner, spans = [], []
    for d, i in enumerate(ids):
        for s, e in windows(len(i)):
            owner.append(d)
            spans.append((offset[d] + s, offset[d] + e))
    owner, all_spans = np.array(owner), np.array(spans)
    inverse = np.zeros(len(told), int)
    adam = Adam(net.p, 0.01)

    def scored() -> np.ndarray:
        table = net.project(np.concatenate([np.tile(net.embed(trigrams.flat, trigrams.sizes), (2, 1)), told], 1))
        return np.concatenate([net.forward(*gather(table, flat, all_spans[k:k + 2048].tolist())) for k in range(0, len(all_spans), 2048)])

    peak = np.array([told[flat[s:e], :2].sum(1).max(initial=0) for s, e in spans], "f4")  # at first, what stands out by evidence
    for turn in range(rounds):
        logits = peak if turn == 0 else scored()
        order = np.lexsort((-logits, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        place = np.empty(len(order), int)
        place[order] = rank
        chosen = np.where((place < np.where(labels[owner] == 1, 1, 2)) | ((labels[owner] == 0) & (rng.random(len(owner)) < 2 * len(labels) / len(owner))))[0]
        for _ in range(passes):
            for batch in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 256)):
                y = labels[owner[batch]].astype("f4")
                start, end = all_spans[batch].T
                at = start + np.arange(max(1, (end - start).max()))[:, None]
                mask = at < end
                at = flat[np.minimum(at, len(flat) - 1)] if len(flat) else np.zeros_like(at)
                used = np.unique(at)
                inverse[used] = np.arange(len(used))
                at = inverse[at]
                rows, sizes = trigrams.of(used % len(vocabulary))
                inputs = np.concatenate([net.embed(rows, sizes), told[used]], 1)
                x = net.project(inputs)[at]
                kept: dict = {}
                logit = net.forward(x, mask, kept)
                weight = np.where(y == 1, 2.0, 1.0).astype("f4")
                grads, dx = net.backward(kept, ((sigmoid(logit) - y) * weight / len(y)).astype("f4"))
                d_table = summed(at[mask], dx[mask], len(used))
                n, d_in = 3 * HIDDEN, 0
                for d, piece in (("f", d_table[:, :n]), ("b", d_table[:, n:])):
                    grads[f"W{d}"], grads[f"c{d}"] = inputs.T @ piece, piece.sum(0)
                    d_in = d_in + piece @ net.p[f"W{d}"].T
                grads["E"] = summed(rows, np.repeat(d_in[:, :EMBEDDED] / sizes[:, None].astype("f4"), sizes, 0), TRIGRAMS)
                adam.step(grads)
    worst = np.full(len(labels), -np.inf)
    np.maximum.at(worst, owner, scored())
    slope, base = calibrate(worst, labels)
    return {"params": net.p, "evidence": evidence, "slope": slope, "base": base}


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve through document logits, by Newton steps with a weak prior on the slope."""
    x, theta = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        q = sigmoid(x @ theta)
        theta = theta - np.linalg.solve((x.T * (q * (1 - q))) @ x + np.diag([1.0, 0.01]), x.T @ (q - labels) + np.array([1.0, 0.01]) * (theta - [1.0, 0.0]))
    return float(max(theta[0], 0.05)), float(theta[1])


class Scorer:
    """Scores texts; remembers the projections of words within a worker."""

    def __init__(self, model: dict) -> None:
        self.model, self.net = model, Network()
        if "constant" not in model:
            self.net.p, self.evidence = model["params"], model["evidence"]
        self.forget()

    def forget(self) -> None:
        self.types: dict[str, int] = {}
        self.fresh, self.letters, self.table = [], 0, np.empty((1 << 12, 6 * HIDDEN), "f4")

    def numbers(self, words: list[str]) -> np.ndarray:
        types = self.types
        new = [w for w in dict.fromkeys(words) if w not in types]
        if new:
            types.update(zip(new, range(len(types), len(types) + len(new)), strict=True))
            self.fresh += new
            self.letters += sum(map(len, new))
        return np.fromiter(map(types.__getitem__, words), np.int32, len(words))

    def learn(self) -> None:
        for k in range(0, len(self.fresh), LOOKED_UP):
            part = self.fresh[k:k + LOOKED_UP]
            made = self.net.project(np.concatenate([self.net.embed(*trigram_table(part)), self.evidence.inputs(part)], 1))
            first = len(self.types) - len(self.fresh) + k
            while len(self.table) < first + len(part):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[first:first + len(part)] = made
        self.fresh = []

    def scores(self, texts: Iterable[str], n: int | None = None) -> np.ndarray:
        """Scores of n texts, which may come one by one."""
        n = len(texts) if n is None else n
        if "constant" in self.model:
            return np.full(n, self.model["constant"])
        worst = np.full(n, -np.inf, "f4")
        ids, owner, spans, at = [], [], [], 0

        def flush() -> None:
            nonlocal ids, owner, spans, at
            if spans:
                self.learn()
                flat, who = np.concatenate(ids), np.array(owner)
                for k in range(0, len(spans), SCORED):
                    np.maximum.at(worst, who[k:k + SCORED], self.net.forward(*gather(self.table, flat, spans[k:k + SCORED])))
            ids, owner, spans, at = [], [], [], 0
            if 4 * self.letters + (self.table.itemsize * self.table.shape[1] + PER_WORD) * len(self.types) > REMEMBERED:
                self.forget()

        for d, text in enumerate(texts):
            words = words_of(text)
            ids.append(self.numbers(words))
            for s, e in windows(len(words)):
                owner.append(d)
                spans.append((at + s, at + e))
            at += len(words)
            if len(spans) >= 4096:
                flush()
        flush()
        return sigmoid(self.model["slope"] * worst.astype(float) + self.model["base"])


def sample_rows(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """(doc_id, text, toxic): at most so many labelled texts of each kind, by smallest hash of the id. Rows held out by their id are never read."""
    marks = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic = 1").orderBy(*by_hash).limit(toxic).unionByName(marks.where("toxic = 0").orderBy(*by_hash).limit(clean))
    return keyed_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # the broadcast is bounded by the limits


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> list[tuple[str, int]]:
    """(text, toxic) of the sample, in order of the id."""
    return [(r["text"], r["toxic"]) for r in sorted(sample_rows(docs, labels, toxic, clean).collect(), key=lambda r: r["doc_id"])]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts, null as empty, of which only ``ROWS`` at a time are Python strings."""
    return (text or "" for k in range(0, len(column), ROWS) for text in column.slice(k, ROWS).to_pylist())


_SCORERS: dict[str, Scorer] = {}


def shared_scorer(spark: SparkSession, model: dict) -> Callable[[], Scorer]:
    """Gives the one scorer of the model in a worker; a worker keeps no scorer of another model."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def get() -> Scorer:
        if name not in _SCORERS:
            _SCORERS.clear()
            give_back()  # of another model's scorer, and of what the worker did before
            _SCORERS[name] = Scorer(shared.value)
        return _SCORERS[name]

    return get


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, score, predicted)."""
    scorer = shared_scorer(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> dict:
        got = scorer().scores(texts_of(batch.column(1)), batch.num_rows)
        return {key: batch.column(0), "score": got, "predicted": (got >= threshold).astype("i4")}

    slim = keyed_text(docs, key, text)
    return arrow_map(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, score double, predicted int")


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that; else it stays with the process."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the bounded sample, trained by one task: neither the sample nor what training takes is in the driver, only the model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        made = pickle.dumps(train([(text, toxic) for _, text, toxic in rows]))
        del rows
        give_back()  # before the worker scores
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["model"])

    made = sample_rows(docs, labels).select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([])


def passing(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score stays below the threshold, with all their columns; scored in place, without a join."""
    kind = docs.schema
    scorer = shared_scorer(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            got = scorer().scores(texts_of(batch.column(at)), batch.num_rows)
            yield batch.filter(pa.array(got < threshold))

    return docs.mapInArrow(run, kind)
