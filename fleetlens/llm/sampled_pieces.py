"""SentencePiece segmentations sampled without replacement by Gumbel top-k, and decoding.

The lattice of a text has an edge for each piece at each place; a path's probability is the product of its pieces' unigram
probabilities over that of all paths. Perturbing the log probabilities of all paths with Gumbel noise and taking the k highest
is sampling k distinct paths without replacement. The search is A-star with exact bounds: the highest perturbed value of a set of
paths is a Gumbel variable at the set's log probability, cut off at its parent's value. Below the best path, the paths that leave
it at one edge are such a set; the agenda holds those sets, and the highest one holds the next path, which is drawn within it.

Units (a run of spaces with the word after it, a line feed) meet only at their ends, as no piece crosses them, so lattices
are kept by unit, and all units of a text are drawn at once. ``inclusion`` is the chance that a path's perturbed value exceeds the
agenda's highest rest, the usual inclusion score for weighting samples. Draws are seeded by the row's key and ``seed`` alone.

A model of the merge kind has ranks instead of probabilities; then a piece of rank r has a probability in proportion to
1 / (r + 2). Characters without a piece of their own are spelt in byte pieces, as one edge.

Defined results: null and empty texts have one segmentation without pieces; where a text has fewer than k segmentations, all are
returned, with inclusion 1; rows with equal keys and texts get equal samples; a null key is seeded as a key of its own; a literal
``U+2581`` is spelt in bytes, so decoding always gives the text; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.common import arrow_map, keyed_text

SAMPLES, ALPHA = 2, 1.0
SPACE = "▁"
#: lattice places and characters of a unit up to which a worker remembers them
PLACES, UNIT = 1_000_000, 48
#: characters of units whose lattices are made together, and rows that are sampled before they leave
TOGETHER, ROWS = 50_000, 200
#: bits of a code point; one that no piece has
POINT, NONE = 21, 2**21 - 1


class Pieces:
    """The pieces of a model, their log probabilities, and the lattices of units."""

    def __init__(self, model_file: str | None, alpha: float) -> None:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file or public_tokenizers.path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in plain])
        if len(scores) and scores.min() < -1000:  # ranks
            scores = -np.log(2 + scores.max() - scores)
        scores = alpha * scores
        scores -= np.log(np.exp(scores).sum())
        self.pieces = {model.id_to_piece(i): (i, float(s)) for i, s in zip(plain, scores, strict=True)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = float(scores.min()) - 10.0
        self.beginnings = {b: n for n, b in enumerate(sorted({p[:n] for p in self.pieces for n in range(1, len(p) + 1)}), 1)}
        # the beginnings as a tree: (node, code point) leads to a node, from 0 on; a node may be a piece
        step = np.array([self.beginnings.get(b[:-1], 0) << POINT | ord(b[-1]) for b in self.beginnings], np.int64)
        order = np.argsort(step)
        self.steps, self.nodes = np.r_[step[order], np.iinfo(np.int64).max], np.r_[order + 1, 0].astype(np.int32)
        self.piece, self.score = np.full(len(step) + 1, -1, np.int32), np.zeros(len(step) + 1)
        for p, (i, x) in self.pieces.items():
            self.piece[self.beginnings[p]], self.score[self.beginnings[p]] = i, x
        self.spelt = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.spelt[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.spelt[i] = bytes([b])
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.units = (lambda text: [text]) if crossing or any("\n" in p for p in self.pieces) else re.compile(r"\n| *[^ \n]+| +").findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.places = self.edges = 0
        self.first = np.zeros(1 << 12, np.int32)  # first edge of a place; places of a unit run from its end to its start
        self.cdf, self.lp, self.next, self.code = (np.zeros(1 << 14, kind) for kind in ("f4", "f4", "i4", "i4"))
        self.fresh: tuple[list, ...] = ([], [], [], [], [])
        self.spellings: list[list[int]] = []

    def lattice(self, unit: str) -> int:
        """The place at the start of a unit; its places and edges wait in ``fresh``."""
        first, cdf, lp, nxt, code = self.fresh
        text, n, base, edges = unit.replace(" ", SPACE), len(unit), self.places + len(self.fresh[0]), self.edges
        beta, pieces, beginnings = [0.0] * (n + 1), self.pieces, self.beginnings
        for i in range(n - 1, -1, -1):
            scores, ends, ids, end = [], [], [], i
            if unit[i] != SPACE:
                while end < n and (end == i or unit[end] != SPACE):
                    end += 1
                    part = text[i:end]
                    if part not in beginnings:
                        break
                    found = pieces.get(part)
                    if found is not None:
                        scores.append(found[1] + beta[end])
                        ends.append(end)
                        ids.append(found[0])
            if not ends or ends[0] != i + 1:  # no piece for this character alone
                self.spellings.append([self.bytes[b] for b in unit[i].encode()])
                scores.append(self.unknown * len(self.spellings[-1]) + beta[i + 1])
                ends.append(i + 1)
                ids.append(-len(self.spellings))
            first.append(edges + len(cdf))
            if len(scores) == 1:
                beta[i] = scores[0]
                cdf.append(2.0)
                lp.append(0.0)
            else:
                top = max(scores)
                weights = [math.exp(x - top) for x in scores]
                total = sum(weights)
                beta[i] = whole = top + math.log(total)
                seen = 0.0
                for w, x in zip(weights, scores, strict=True):
                    seen += w / total
                    cdf.append(seen)
                    lp.append(x - whole)
                cdf[-1] = 2.0
            nxt += [base + n - 1 - e if e < n else -1 for e in ends]
            code += ids
        return base + n - 1

    def lattices(self, units: list[str]) -> None:
        """Remember several units; what ``lattice`` does, for all of their places at once. Places run by their distance to the unit's end."""
        sizes = np.fromiter(map(len, units), int, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        raw, ends = points, np.repeat(np.cumsum(sizes), sizes)
        points = np.where(points == ord(SPACE), NONE, np.where(points == 32, ord(SPACE), points))
        n = len(points)
        left = ends - np.arange(n)
        order = np.argsort(left, kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        # edges: start, characters, id, score
        at, node, far, found, alone = np.arange(n), np.zeros(n, np.int64), 0, [], np.ones(n, bool)
        while len(at):
            step = node << POINT | points[at + far]
            k = np.searchsorted(self.steps, step)
            on = self.steps[k] == step
            at, node, far = at[on], self.nodes[k[on]].astype(np.int64), far + 1
            has = self.piece[node] >= 0
            found.append((at[has], np.full(has.sum(), far), self.piece[node[has]], self.score[node[has]]))
            if far == 1:
                alone[at[has]] = False
            more = left[at] > far
            at, node = at[more], node[more]
        spelt = np.flatnonzero(alone)
        spellings = [[self.bytes[b] for b in chr(c).encode()] for c in raw[spelt].tolist()]
        found.append((spelt, np.full(len(spelt), 1), -len(self.spellings) - 1 - np.arange(len(spelt)), self.unknown * np.fromiter(map(len, spellings), float, len(spelt))))
        self.spellings += spellings
        start, chars, code, x = (np.concatenate(c) for c in zip(*found, strict=True))
        rank = np.r_[chars[:len(chars) - len(spelt)], np.full(len(spelt), UNIT + 1)]  # a spelt character comes behind the pieces
        by = np.argsort(place[start] * (UNIT + 2) + rank)
        start, chars, code, x = start[by], chars[by], code[by], x[by]
        target = np.where(chars == left[start], n, place[np.minimum(start + chars, n - 1)])
        counts = np.bincount(place[start], minlength=n)
        first = np.r_[0, np.cumsum(counts)]
        beta, share = np.zeros(n + 1), np.empty(len(x))
        bounds = np.r_[0, np.cumsum(np.bincount(left)[1:])]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, e = first[a], first[b]
            x[s:e] += beta[target[s:e]]
            begin, some = first[a:b] - s, counts[a:b]
            top = np.maximum.reduceat(x[s:e], begin)
            weight = np.exp(x[s:e] - np.repeat(top, some))
            total = np.add.reduceat(weight, begin)
            share[s:e] = weight / np.repeat(total, some)
            beta[a:b] = whole = np.where(some == 1, top, top + np.log(total))
            x[s:e] -= np.repeat(whole, some)
        number = np.arange(len(x)) - np.repeat(first[:-1], counts)
        later = np.flatnonzero(number)
        for k in range(1, int(counts.max())):
            later = later[number[later] >= k]
            now = later[number[later] == k]
            share[now] += share[now - 1]
        share[first[1:] - 1] = 2.0
        base = self.places
        self.append(self.edges + first[:-1], share, x, np.where(target == n, -1, base + target), code)
        self.known.update(zip(units, (base + place[np.cumsum(sizes) - sizes]).tolist(), strict=True))

    def learn(self, units: list[str]) -> None:
        """Remember the units that aren't too long; what was known before may be forgotten."""
        if self.places > PLACES:
            self.forget()
        some, chars = [], 0
        for unit in dict.fromkeys(units):
            if unit not in self.known and len(unit) <= UNIT:
                some.append(unit)
                chars += len(unit)
                if chars > TOGETHER:
                    self.lattices(some)
                    some, chars = [], 0
        if some:
            self.lattices(some)

    def settle(self) -> None:
        """Append the fresh places and edges to the arrays."""
        fresh, self.fresh = self.fresh, ([], [], [], [], [])
        self.append(*fresh)

    def append(self, first: list | np.ndarray, *edges: list | np.ndarray) -> None:
        while len(self.first) <= self.places + len(first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        total = self.edges + len(edges[0])
        while len(self.cdf) < total:
            self.cdf, self.lp, self.next, self.code = (np.concatenate([a, np.zeros_like(a)]) for a in (self.cdf, self.lp, self.next, self.code))
        self.first[self.places:self.places + len(first)] = first
        self.first[self.places + len(first)] = total
        for mine, values in zip((self.cdf, self.lp, self.next, self.code), edges, strict=True):
            mine[self.edges:total] = values
        self.places, self.edges = self.places + len(first), total

    def starts(self, text: str) -> np.ndarray:
        """First places of the units of a text."""
        units = self.units(" " + text)
        out = list(map(self.known.get, units))
        if None in out or self.places > 2 * PLACES:
            self.learn(units)
            out = list(map(self.known.get, units))
            for i, unit in enumerate(units):
                if out[i] is None:
                    out[i] = self.lattice(unit)
            if self.fresh[0]:
                self.settle()
        return np.array(out, np.int32)

    def draw(self, places: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """A path through each unit from the given place on: edges in order, and edges per unit."""
        steps, unit, at = [], np.arange(len(places)), places
        while len(at):
            edge, u = self.first[at], rng.random(len(at), "f4")
            low = np.flatnonzero(self.cdf[edge] <= u)
            while len(low):
                edge[low] += 1
                low = low[self.cdf[edge[low]] <= u[low]]
            steps.append((unit, edge))
            at = self.next[edge]
            live = at >= 0
            at, unit = at[live], unit[live]
        counts = np.bincount(np.concatenate([u for u, _ in steps]), minlength=len(places)) if steps else np.zeros(0, int)
        begin = np.cumsum(counts) - counts
        path = np.empty(counts.sum(), np.int32)
        for k, (u, e) in enumerate(steps):
            path[begin[u] + k] = e
        return path, counts

    def ids(self, path: np.ndarray) -> np.ndarray:
        code = self.code[path]
        spelt = np.flatnonzero(code < 0)
        if not len(spelt):
            return code
        parts = [self.spellings[-c - 1] for c in code[spelt].tolist()]
        sizes = np.ones(len(code), np.int64)
        sizes[spelt] = [len(x) for x in parts]
        out = np.repeat(code, sizes)
        out[out < 0] = [i for x in parts for i in x]
        return out

    def samples(self, text: str, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, float, float]]:
        """Up to k distinct (ids, log probability, inclusion), in the order of their perturbed values."""
        if not text:
            return [(np.zeros(0, np.int32), 0.0, 1.0)]
        units = self.starts(text)
        paths: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        agenda: list[tuple[float, int, int, tuple[int, ...]]] = []  # value, path, edge number, edges drawn there
        found = []

        def rest(value: float, location: np.ndarray) -> np.ndarray:
            """Gumbel values at the locations, cut off at the value of the set they are part of."""
            with np.errstate(divide="ignore"):
                return location - np.log(np.exp(location - value) - np.log(rng.random(len(location))))

        def add(value: float, path: np.ndarray, counts: np.ndarray, fresh: int) -> None:
            """Take a path; the sets of paths that leave it at one of its edges from number ``fresh`` on join the agenda."""
            lp = self.lp[path].astype(float)
            before = np.cumsum(lp) - lp
            paths.append((path, counts, before))
            found.append((self.ids(path), float(lp.sum()), value))
            number = np.flatnonzero(lp[fresh:] < 0) + fresh
            if len(number):
                values = rest(value, before[number] + np.log(-np.expm1(lp[number])))
                top = np.argpartition(-values, k)[:k + 1] if len(values) > k + 1 else np.arange(len(values))
                agenda.extend((float(values[t]), len(paths) - 1, int(number[t]), (int(path[number[t]]),)) for t in top)

        add(-math.log(-math.log(rng.random())), *self.draw(units, rng), 0)
        while agenda and len(found) < k:
            value, owner, number, drawn = agenda.pop(max(range(len(agenda)), key=lambda i: agenda[i][0]))
            path, counts, before = paths[owner]
            place = int(np.searchsorted(self.first[:self.places], path[number], "right")) - 1
            edges = np.arange(self.first[place], self.first[place + 1])
            left = np.where(np.isin(edges, drawn), 0.0, np.exp(self.lp[edges].astype(float)))
            edge = int(edges[min(np.searchsorted(np.cumsum(left), rng.random() * left.sum(), "right"), np.flatnonzero(left)[-1])])
            others = left.sum() - math.exp(float(self.lp[edge]))
            if len(edges) > len(drawn) + 1 and others > 0:
                agenda.append((float(rest(value, np.array([before[number] + math.log(others)]))[0]), owner, number, (*drawn, edge)))
            unit = int(np.searchsorted(np.cumsum(counts), number, "right"))
            on = self.next[edge]
            more, more_counts = self.draw(np.r_[[on] if on >= 0 else [], units[unit + 1:]].astype(np.int32), rng)
            done = number - int(counts[:unit].sum()) + 1  # edges of this unit up to the new one
            if on >= 0:
                more_counts = np.r_[counts[:unit], more_counts[:1] + done, more_counts[1:]]
            else:
                more_counts = np.r_[counts[:unit], [done], more_counts]
            add(value, np.r_[path[:number], np.int32(edge), more].astype(np.int32), more_counts, number + 1)
        kappa = max((a[0] for a in agenda), default=-math.inf)
        return [(ids, lp, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(700.0, lp - kappa)))) for ids, lp, _ in found]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spelt.__getitem__, ids)).decode()[1:]


_PIECES: dict[tuple, Pieces] = {}


def pieces_of(model_file: str | None = None, alpha: float = ALPHA) -> Pieces:
    """One per worker process."""
    if (model_file, alpha) not in _PIECES:
        _PIECES[model_file, alpha] = Pieces(model_file, alpha)
    return _PIECES[model_file, alpha]


def seeded(key: object, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode()), len(repr(key))])


def encode_samples(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, seed: int = 1, alpha: float = ALPHA, model_file: str | None = None) -> DataFrame:
    """(key, sample, ids, score, inclusion): up to k distinct segmentations of each text."""
    def run(batch: pa.RecordBatch) -> dict:
        p, row, sample, ids, score, inclusion = pieces_of(model_file, alpha), [], [], [], [], []
        p.learn([u for value in batch.column(1).to_pylist() for u in p.units(" " + value)])
        for i, (me, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            for n, (codes, lp, share) in enumerate(p.samples(value, k, seeded(me, seed)), 1):
                row.append(i)
                sample.append(n)
                ids.append(codes)
                score.append(lp)
                inclusion.append(share)
        ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype("i4")
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
        return {key: batch.column(0).take(pa.array(row, pa.int64())), "sample": sample, "ids": flat, "score": score, "inclusion": inclusion}

    slim = keyed_text(df, key, text)
    return arrow_map(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, sample int, ids array<int>, score double, inclusion double", ROWS)


def decode_samples(df: DataFrame, ids: str = "ids", text: str = "decoded", model_file: str | None = None) -> DataFrame:
    """The rows with their ids replaced by the text that they spell; null ids spell nothing."""
    others = [c for c in df.columns if c != ids]

    def run(batch: pa.RecordBatch) -> dict:
        p = pieces_of(model_file)
        return {c: batch.column(c) for c in others} | {text: [p.decode(x or []) for x in batch.column(ids).to_pylist()]}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(others).schema)
    return arrow_map(df.select(*others, ids), run, f"{kinds}, `{text}` string")


def checksums(encoded: DataFrame, key: str = "doc_id", model_file: str | None = None) -> DataFrame:
    """(key, sample, n_pieces, score, inclusion, ids_crc32, text_crc32): checksums of the ids and of the text that they spell."""
    def run(batch: pa.RecordBatch) -> dict:
        p, out = pieces_of(model_file), {c: [] for c in ("n_pieces", "ids_crc32", "text_crc32")}
        for ids in batch.column("ids"):
            codes = ids.values.to_numpy()
            out["n_pieces"].append(len(codes))
            out["ids_crc32"].append(zlib.crc32(codes.astype("<u4").tobytes()))
            out["text_crc32"].append(zlib.crc32(p.decode(codes.tolist()).encode()))
        return {c: batch.column(c) for c in (key, "sample", "score", "inclusion")} | out

    kind = encoded.schema[key].dataType.simpleString()
    return arrow_map(encoded, run, f"`{key}` {kind}, sample int, n_pieces long, score double, inclusion double, ids_crc32 long, text_crc32 long", ROWS)
