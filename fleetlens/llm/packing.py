"""Best-fit packing planned on the histogram of lengths.

Tokenised documents are cut into pieces of at most ``size`` tokens. Pieces are counted by length (at most ``size`` counts reach
the driver, however many documents there are); best-fit decreasing runs over the counts and gives, for each length, ranges of
ranks with the sequences and the offset they fill. A piece then takes its slot by its rank within its length. Ranks come
from small shares of each length whose counts are summed up, so a length that most pieces have is not one task.

Defined results: a null or empty text is the end token alone; equal rows are packed one by one; an empty table gives no rows;
a null key is kept. The shorter piece of a cut document is its first one.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, keyed_text
from fleetlens.session import materialize

SPACE = r"\t-\r \x85\xa0  -     　"
#: entries of a worker's memory of coded words; more are coded each time
REMEMBERED = 300_000
#: pieces of one length that are ranked together
SHARE = 256


class WordCodes(dict):
    """Codes of words with the white space before them, as packed 32-bit ids. No piece of the byte-level vocabulary crosses from
    text into the white space after it, so words can be coded alone. Special tokens inside a text get their own ids."""

    def __init__(self, ranks_file: str, pattern: str, specials: dict[str, int]) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.specials = {t: np.array([n], "<u4").tobytes() for t, n in specials.items()}
        longest_first = sorted(specials, key=len, reverse=True)
        self.parts = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if specials else lambda text: [text]

    def __missing__(self, word: str) -> bytes:
        code = np.array(self.encode(word), "<u4").tobytes()
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = code
        return code

    def ids(self, text: str) -> bytes:
        parts = self.parts(text)
        return b"".join(self.specials[part] if k % 2 else b"".join(map(self.__getitem__, self.words(part))) for k, part in enumerate(parts))


_CODES: dict[tuple, WordCodes] = {}


def word_codes(ranks_file: str | None = None, tokenizer_file: str | None = None) -> WordCodes:
    """One coder per worker process. By default the ranks of ``byte_bpe_50k``, which are the ids of its JSON form, and the special
    tokens that the JSON form names."""
    import public_tokenizers

    where = (ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"))
    if where not in _CODES:
        with open(where[1], encoding="utf-8") as f:
            specials = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", []) if t["special"]}
        _CODES[where] = WordCodes(where[0], public_tokenizers.PATTERN, specials)
    return _CODES[where]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % size or size
    return [(0, n)] if n <= size else [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2, ranks_file: str | None = None, keep_ids: bool = False, tokenizer_file: str | None = None) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32), with ``ids`` on demand."""
    kind = df.schema[key].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        ids, row = word_codes(ranks_file, tokenizer_file).ids, []
        piece, start, length, crc, kept = [], [], [], [], []
        for i, value in enumerate(batch.column(1).to_pylist()):
            packed = memoryview(ids(value) + last)
            for k, (s, n) in enumerate(cut(len(packed) // 4, size)):
                row.append(i)
                piece.append(k)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(packed[4 * s:4 * (s + n)]))
                if keep_ids:
                    kept.append(np.frombuffer(packed[4 * s:4 * (s + n)], "<u4").astype("i4"))
        return {key: batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc, "ids": kept}

    return arrow_map(keyed_text(df, key, text), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def best_fit_plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots (length, first rank, first sequence, offset) in order of length and rank, and the number of sequences.

    Best-fit decreasing, done for all pieces of a length at once: the fullest sequences that still take the length get as
    many pieces as fit, then the next fuller ones, then new sequences.
    """
    open_at: dict[int, list[tuple[int, int]]] = {size: []}  # free tokens -> runs of sequences (first, how many)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, many: int, free: int, each: int) -> None:
            nonlocal left, rank
            for j in range(each):
                slots.append((length, rank, first, size - free + j * length))
                rank += many
            left -= many * each
            open_at.setdefault(free - each * length, []).append((first, many))

        for free in sorted(f for f in open_at if length <= f < size):
            each = free // length
            runs, open_at[free] = open_at[free], []
            for first, many in runs:
                whole = min(many, left // each)
                if whole:
                    place(first, whole, free, each)
                if whole < many and 0 < left < each:
                    place(first + whole, 1, free, left)
                    whole += 1
                if whole < many:
                    open_at[free].append((first + whole, many - whole))
        each = size // length
        for many, full in ((left // each, each), (1, left % each)):
            if many and full:
                place(opened, many, size, full)
                opened += many
    return sorted(slots), opened


def ranked_within_length(pieces: DataFrame, counts: dict[int, int], *order: str, share: int = SHARE) -> DataFrame:
    """Adds ``rank``, from 0 within each length. ``counts`` has one entry per length, so the joined table is that small."""
    spark = pieces.sparkSession
    shares = spark.createDataFrame([(n, -(-c // share)) for n, c in counts.items()], "length long, shares long")
    dealt = pieces.join(F.broadcast(shares), "length").withColumn("share", F.expr(f"pmod(xxhash64({', '.join(order)}), shares)")).drop("shares")
    sizes = dealt.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "share").orderBy(*order))
    return dealt.withColumn("within", within).join(sizes, ["length", "share"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("share", "within", "before")


def pack(pieces: DataFrame, key: str = "doc_id", size: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces. The pieces are read several times: give a written table.

    A piece of full length is a sequence of its own, with a negative number, and needs no rank; so the most frequent length of a large corpus is
    neither shuffled nor sorted.
    """
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    shorter = pieces.where(F.col("length") < size)
    counts = {r["length"]: r["n"] for r in shorter.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    slots, _ = best_fit_plan(counts, size)
    lengths, ranks, firsts, offsets = (np.array(x, np.int64) for x in (zip(*slots, strict=True) if slots else ([],) * 4))
    wide = max(counts.values(), default=0) + 1
    assert wide * (size + 1) < 2**63, "a slot's number has to fit 64 bits"
    steps = lengths * wide + ranks  # in order of length and rank
    ranked = ranked_within_length(shorter, counts, key, "piece") if counts else shorter.withColumn("rank", F.lit(0).cast("long"))
    columns = [c for c in ranked.columns if c != "rank"]

    def run(batch: pa.RecordBatch) -> dict:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(steps, length * wide + rank, "right") - 1
        return {c: batch.column(c) for c in columns} | {"sequence_id": firsts[at] + rank - ranks[at], "offset": offsets[at]}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(columns).schema)
    return arrow_map(ranked.select(*columns, "rank"), run, f"{kinds}, sequence_id long, offset long").unionByName(full)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2, ranks_file: str | None = None, keep_ids: bool = False, tokenizer_file: str | None = None) -> DataFrame:
    """Tokenise, cut, plan and place: one row per piece."""
    pieces = materialize(token_pieces(df, key, text, size, end, ranks_file, keep_ids, tokenizer_file), "pieces")
    out = pack(pieces, key, size)
    return out.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))
