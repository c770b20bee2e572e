"""Removal of word runs that an earlier document has, by suffix automata of reference passages.

A document loses each word that lies in a run of ``size`` words which also starts in a document with a smaller key.

1. Runs have an owner: the first of the least hashes among their n-grams of ``GRAM`` words, which depends on the run alone. An
   owner hash that one document alone has can't own a repeated run; only owners of several documents go on. What a batch of
   texts has several times is known to be shared at once, and only its least and greatest document are told to others, so no
   owner sends more than two rows a batch to one task.
2. The words around such an owner that its runs cover are its passage. Equal passages of a batch become one row.
3. Passages are the reference text. They are dealt by their owner into shards of about ``SHARD`` rows; an owner of more than
   ``SHARD`` documents is taken apart into single runs, dealt by their words. Each shard becomes a suffix automaton whose states
   know the least document that has their words. Passages are streamed through the automaton of their shard; where matching
   statistics reach ``size`` words, the state of the last ``size`` words tells the first document that has them.
4. Runs first seen in a smaller document are marked in each occurrence of their passage, and the union of marks is cut.

A whole-corpus automaton that is broadcast would have to meet every document with every shard, work that grows with the
square of the corpus; dealing by owner brings each run only to the one shard that can hold its like.

Defined results: null and empty texts have no words; texts with fewer words than ``size`` lose nothing; rows that share a key
don't take words from each other; rows with a null key are returned whole and are no reference; an empty table gives no rows.
Words are compared as symbols of 32 bits, whole runs by all their symbols and 64 bits of an owner hash.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, by_group, keyed_text, mix64, unused
from fleetlens.llm.words import Words, hashed_words, shingles
from fleetlens.session import materialize

SIZE, GRAM, SHARD = 13, 5, 4000


def owners(part: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs (word numbers within the chunk), their owners' word numbers, and hashes of n-grams by word number."""
    ends = np.repeat(part.offsets[1:], part.counts)
    runs = np.flatnonzero(np.arange(len(ends)) + size <= ends)
    if not len(runs):
        return runs, runs, np.zeros(0, np.uint64)
    grams = shingles(part.hashes, gram)
    best, at = grams[runs], runs.copy()
    for k in range(1, size - gram + 1):
        other = grams[runs + k]
        less = other < best
        best = np.where(less, other, best)
        at[less] = runs[less] + k
    return runs, at, grams


def owner_hashes(docs: DataFrame, key: str, text: str, size: int, gram: int) -> DataFrame:
    """(deal, owner, key): owners by document. Rows that name an owner are of owners that several documents of the batch have; they
    are dealt evenly. Of these documents the least and the greatest are dealt by the owner too, as all documents of other
    owners are; such rows have no other owner than ``deal``."""

    def run(batch: pa.RecordBatch) -> dict:
        keys, docs_of, owner_of = batch.column(0).to_numpy(), [], []
        for part in hashed_words(batch.column(1)):
            _, at, grams = owners(part, size, gram)
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                docs_of.append(np.searchsorted(part.offsets, at[first], "right") - 1 + part.first)
                owner_of.append(grams[at[first]])
        if not docs_of:
            return None
        key_of, owner = keys[np.concatenate(docs_of)], np.concatenate(owner_of)
        order = np.lexsort((key_of, owner))
        key_of, owner = key_of[order], owner[order]
        new = np.r_[True, (key_of[1:] != key_of[:-1]) | (owner[1:] != owner[:-1])]
        key_of, owner = key_of[new], owner[new]
        first = np.r_[True, owner[1:] != owner[:-1]]
        last = np.r_[first[1:], True]
        known = ~(first & last)
        deal = np.r_[owner[first | last], mix64(owner[known] ^ mix64(key_of[known].astype(np.uint64)))]
        every = np.r_[np.flatnonzero(first | last), np.flatnonzero(known)]
        plain = np.arange(len(every)) < (first | last).sum()
        return {"deal": deal.view(np.int64), "owner": pa.array(owner[every].view(np.int64), mask=plain), key: key_of[every]}

    return arrow_map(docs.select(key, text), run, f"deal long, owner long, `{key}` {docs.schema[key].dataType.simpleString()}")


def shards_of(deal: list[int], shards: int) -> np.ndarray:
    """Shards by scrambled 64 bits, all of a batch at once."""
    return (mix64(np.array([x & (2**64 - 1) for x in deal], np.uint64)) % np.uint64(shards)).astype("i4")


def passages(docs: DataFrame, key: str, text: str, size: int, gram: int, shards: int) -> DataFrame:
    """(shard, owner, symbols, keys, rows, starts): passages of a batch with their occurrences. ``docs`` has the columns key, row,
    text, the asked owners and those of them that are taken apart."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column(3)), 0))
        keys, rows = (batch.column(c).to_pylist() for c in (0, 1))
        found: dict[tuple[int, bytes, bool], list[tuple[int, int]]] = {}
        for part in hashed_words(batch.column(2)):
            runs, at, grams = owners(part, size, gram)
            if not len(runs):
                continue
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], len(at)] - 1
            doc = np.searchsorted(part.offsets, at[first], "right") - 1
            hashes, bounds = grams[at[first]].view(np.int64), np.searchsorted(doc, np.arange(len(part.counts) + 1))
            asked, apart = (batch.column(c).slice(part.first, len(part.counts)) for c in (3, 4))
            here = np.concatenate([np.isin(hashes[bounds[d]:bounds[d + 1]], asked[d].values.to_numpy()) for d in range(len(part.counts))])
            taken = {d: set(apart[d].as_py()) for d in np.flatnonzero(apart.value_lengths().to_numpy()).tolist()}
            short = mix64(part.hashes).astype("<u4").tobytes()
            offsets = part.offsets.tolist()
            chosen = np.flatnonzero(here)
            for d, owner, s, e in zip(doc[chosen].tolist(), hashes[chosen].tolist(), runs[first[chosen]].tolist(), (runs[last[chosen]] + size).tolist(), strict=True):
                single = owner in taken.get(d, ())
                for a, b in [(k, k + size) for k in range(s, e - size + 1)] if single else [(s, e)]:
                    found.setdefault((owner, short[4 * a:4 * b], single), []).append((part.first + d, a - offsets[d]))
        deal = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") if single else o for o, w, single in found]
        return {"shard": shards_of(deal, shards), "owner": [o for o, _, _ in found], "symbols": [w for _, w, _ in found],
                "keys": [[keys[d] for d, _ in x] for x in found.values()], "rows": [[rows[d] for d, _ in x] for x in found.values()], "starts": [[at for _, at in x] for x in found.values()]}

    return arrow_map(docs, run, f"shard int, owner long, symbols binary, keys array<{kind}>, rows array<long>, starts array<int>")


class Automaton:
    """Suffix automaton of several sequences; each state knows the least document among the ends of its words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def add(self, symbols: list[int], document: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in symbols:
            seen = nxt[last].get(c)
            if seen is not None and length[seen] == length[last] + 1:
                last = seen
            else:
                if seen is None:
                    state = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    least.append(None)
                    p = last
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = state
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][c]
                        link[state] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                    last = state
                else:
                    last = self._split(last, c, seen)
            if least[last] is None or document < least[last]:
                least[last] = document

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for its words that end with c after p's, so that their ends can differ from q's."""
        state = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.least.append(None)
        self.link[q] = state
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = state
            p = self.link[p]
        return state

    def settle(self) -> None:
        """Ends of longer words are ends of their suffixes."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            t = link[s]
            if least[s] is not None and t >= 0 and (least[t] is None or least[s] < least[t]):
                least[t] = least[s]

    def first_documents(self, symbols: list[int], size: int) -> list[int | None]:
        """For each run of ``size`` symbols the least document that has it, by matching statistics."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        state = matched = 0
        out: list[int | None] = []
        for i, c in enumerate(symbols):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            while state and length[link[state]] >= size:  # the state of the last ``size`` symbols
                state = link[state]
                matched = min(matched, length[state])
            if i >= size - 1:
                out.append(least[state] if matched >= size else None)
        return out


def answered(key: str, size: int):
    """Word spans to cut, by occurrence, from all passages of a shard."""

    def answer(group: pa.Table) -> dict:
        occurrences: dict[bytes, list[tuple]] = {}
        for words, *where in zip(*(group.column(c).to_pylist() for c in ("symbols", "keys", "rows", "starts")), strict=True):
            occurrences.setdefault(words, []).append(where)
        texts = {w: np.frombuffer(w, "<u4").tolist() for w in occurrences}
        automaton = Automaton()
        for w, symbols in texts.items():
            automaton.add(symbols, min(min(keys) for keys, _, _ in occurrences[w]))
        automaton.settle()
        out: dict[str, list] = {c: [] for c in (key, "row", "start", "end")}
        for w, symbols in texts.items():
            firsts = automaton.first_documents(symbols, size)
            least = min(firsts)
            for me, row, at in ((k, r, s) for part in occurrences[w] for k, r, s in zip(*part, strict=True)):
                if least < me:
                    end = -1
                    for n, first in enumerate(firsts):
                        if first < me:
                            if n > end:  # a gap since the last span
                                out[key].append(me)
                                out["row"].append(row)
                                out["start"].append(at + n)
                                out["end"].append(at + n + size)
                            out["end"][-1] = at + n + size
                            end = n + size
        return out

    return answer


def with_row(df: DataFrame, key: str, text: str) -> DataFrame:
    return keyed_text(df, key, text).select(key, F.xxhash64(text).alias("row"), text)


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(_key, of_rows) of keys with word spans [start, end) that an earlier document has, each with the hash of its row's text.

    All texts travel once, dealt by their key: a caller that joins the same rows to the result by the key alone reads the same shuffle again.
    """
    docs = with_row(df, key, text)
    kind = docs.schema[key].dataType.simpleString()
    hashes = owner_hashes(docs.where(F.col(key).isNotNull()), key, text, size, gram)
    same = Window.partitionBy("deal")
    shared = hashes.withColumns({"least": F.min(key).over(same), "most": F.max(key).over(same)}).where("owner is not null or least < most")
    asked = materialize(shared.select(key, F.coalesce("owner", "deal").alias("owner")), "shared-owners")
    apart = materialize(asked.groupBy("owner").agg(F.count("*").alias("n")).where(f"n > {shard}").select("owner", F.col("owner").alias("apart")), "frequent-owners")
    lists = asked.join(apart, "owner", "left").groupBy(key).agg(F.collect_set("owner").alias("asked"), F.collect_set("apart").alias("apart"))
    none = F.array().cast("array<long>")
    joined = docs.join(lists, key, "left").select(key, "row", text, F.coalesce("asked", none).alias("asked"), F.coalesce("apart", none).alias("apart"))
    found = passages(joined, key, text, size, gram, max(1, -(-asked.count() // shard)))
    spans = by_group(found, ["shard"], answered(key, size), f"`{key}` {kind}, row long, start int, end int")
    return spans.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("row", "start", "end")).alias("of_rows"))


def spans_of(row: Column, of_rows: str) -> Column:
    """The spans of a row's text; null without any."""
    mine = F.transform(F.filter(of_rows, lambda s: s["row"] == row), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.size(mine) > 0, mine)


def kept_words(value: str, spans: list | None) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and which of them are cut."""
    words = value.encode().split()
    gone = np.zeros(len(words) + 1, np.int32)
    for m in spans or []:
        gone[m["start"]] += 1
        gone[m["end"]] -= 1
    return words, np.cumsum(gone)[:-1] > 0


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(key, n_words, n_removed, kept, spans): the kept words joined by one space, and the word spans [start, end) that were cut."""
    spans, docs = repeated_spans(df, key, text, size, gram, shard), with_row(df, key, text)
    found = docs.join(spans, F.col(key) == F.col("_key"), "left").select(key, text, spans_of(F.col("row"), "of_rows").alias("spans"))

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept", "spans")}
        for value, marks in zip(*(batch.column(c).to_pylist() for c in (1, 2)), strict=True):
            words, covered = kept_words(value, marks)
            edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
            out["n_words"].append(len(words))
            out["n_removed"].append(int(covered.sum()))
            out["kept"].append(b" ".join(compress(words, (~covered).tolist())).decode())
            out["spans"].append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
        return out | {key: batch.column(0)}

    kind = found.schema[key].dataType.simpleString()
    return arrow_map(found, run, f"`{key}` {kind}, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """The rows, with all their columns, without words that an earlier document has: a text that loses words is its kept words joined
    by a space, other texts stay as they are, and a document of which nothing is left goes."""
    named = {c: unused(df, c) for c in ("_key", "of_rows")}
    spans = repeated_spans(keyed_text(df, key, text), key, text, size, gram, shard).select(*(F.col(c).alias(n) for c, n in named.items()))
    mine = spans_of(F.xxhash64(F.coalesce(text, F.lit(""))), named["of_rows"])
    rows = df.join(spans, F.col(key) == F.col(named["_key"]), "left").select(*df.columns, mine.alias(unused(df, "spans")))
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(batch.column(len(df_columns)).is_valid().to_numpy(zero_copy_only=False)).tolist():
                words, covered = kept_words(texts[i], batch.column(len(df_columns))[i].as_py())
                texts[i] = b" ".join(compress(words, (~covered).tolist())).decode()
                keep[i] = not covered.all()
            columns = [pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(df_columns))]
            yield pa.RecordBatch.from_arrays(columns, names=df_columns).filter(pa.array(keep))

    df_columns = df.columns
    return rows.mapInArrow(run, df.schema)
