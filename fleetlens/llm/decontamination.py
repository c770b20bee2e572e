"""Benchmark decontamination: words of documents that stand inside a passage of a test item.

Texts are normalised to words: runs of ASCII letters (lower-cased) and digits and of all characters beyond ASCII. A window is ``WINDOW``
consecutive words of an item; an item of fewer words is one window. The hash set of all windows is broadcast, in blocks of at most
``BROADCAST`` windows and item references, with one scan of the documents per block, so that what is sent has a fixed bound. A document's windows
are hashed and looked up; a hit is verified by its words. All work is DataFrame expressions.

Defined results: null and empty texts have no words; rows that share key and text are one document, rows that share but a key are
documents of their own, with a null key too; items with a null id or without words take no part, rows that share an id are one
item; an empty table of items leaves every document clean, an empty table of documents gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import WORD, plain_words, unused
from fleetlens.session import materialize

WINDOW = 10
#: windows and references to items in one broadcast hash set, some 100 bytes each
BROADCAST = 200_000
#: range of the slots that hashes fall on before they are folded
SLOTS = 1 << 40


def windows_at(words: Column, size: Column, made) -> Column:
    """``made`` of each run of so many words; empty if there are fewer."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: made(F.slice(words, i, size)))


def item_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(hash, size, window, items): each distinct window once, with the ids of its items as strings."""
    rows = items.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("named"), plain_words(text).alias("words")).where(F.size("words") > 0)
    runs = rows.select("named", F.explode(windows_at(F.col("words"), F.least(F.size("words"), F.lit(window)), lambda run: run)).alias("window"))
    return runs.groupBy("window").agg(F.sort_array(F.collect_set("named")).alias("items")).select(F.xxhash64("window").alias("hash"), F.size("window").alias("size"), "window", "items")


def marked(windows: DataFrame) -> bytes:
    """A byte per slot, 1 where a window's hash falls; 32 slots or more per window."""
    slots = [r["slot"] for r in windows.select(F.pmod("hash", F.lit(SLOTS)).alias("slot")).distinct().collect()]  # at most ``BROADCAST`` numbers
    n = 1 << max(16, (32 * len(slots)).bit_length())
    found = bytearray(n)
    for slot in slots:
        found[slot % n] = 1
    return bytes(found)


def found_windows(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, digest, n_words, at, size, items) of each occurrence of a window, and a row per document without an occurrence.

    The slots of the hash set travel with the plan, so that only windows that fall on a marked one become rows; those meet the set.
    """
    slots = marked(windows)
    sized = docs.withColumn("long", F.explode(F.array(*(F.lit(s) for s in sizes))))
    starts = F.when(F.size("words") >= F.col("long"), F.sequence(F.lit(1), F.size("words") - F.col("long") + 1)).otherwise(F.array().cast("array<int>"))

    def looked(at: Column) -> Column:
        return F.xxhash64(F.slice("words", at, F.col("long")))

    def is_marked(at: Column) -> Column:
        return F.substring(F.lit(slots), F.pmod(looked(at), F.lit(len(slots))).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")

    # 0 stands for the document; explode_outer, since Spark would look all windows up again to filter empty arrays before explode
    runs = sized.withColumn("at", F.explode_outer(F.concat(F.array(F.lit(0)), F.filter(starts, is_marked))))
    runs = runs.withColumn("looked", F.when(F.col("at") > 0, looked(F.col("at"))))
    same = (F.col("looked") == F.col("hash")) & (F.slice("words", F.greatest("at", F.lit(1)), F.col("long")) == F.col("window"))
    met = runs.join(F.broadcast(windows), same, "left").where("at = 0 or hash is not null")
    return met.select("key", "digest", F.size("words").alias("n_words"), (F.col("at") - 1).alias("at"), "size", "items")


def merged(spans: Column) -> Column:
    """Sorted spans (start, end) as disjoint ones."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def contamination(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, digest, n_words, n_hit, spans, items): per document the SHA-256 of its text, its hit words as disjoint spans
    (start and end in words, from 0), and the sorted ids (as strings) of the items with a window in it."""
    windows = materialize(item_windows(items, item, item_text, window), "test-windows")
    held = windows.agg(F.count("*") + F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect()) or [window]  # at most ``window`` rows
    docs = df.select(F.col(key).alias("key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), plain_words(text).alias("words"))
    blocks, found = max(1, -(-held // BROADCAST)), None
    for block in range(blocks):
        part = found_windows(docs, windows.where(F.pmod("hash", F.lit(blocks)) == block), sizes)
        found = part if found is None else found.unionByName(part)
    hit = F.col("at") >= 0
    rows = found.groupBy("key", "digest").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set(F.when(hit, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")))).alias("met"),
                                              F.collect_set("items").alias("sets"))
    rows = rows.withColumn("spans", merged(F.sort_array("met")))
    return rows.select(F.col("key").alias(key), "digest", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"), "spans",
                       F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"))


def without_passages(text: Column, spans: Column) -> Column:
    """The text without the words of the spans; a word takes along what stands between it and the next one."""
    words, between = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.split(text, WORD)
    pieces = F.zip_with(words, F.slice(between, 2, F.size(words)), lambda w, b: F.concat(w, b))
    kept = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    return F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))


def decontaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, whole: bool = False) -> DataFrame:
    """The rows, with all their columns, without the passages of items; with ``whole``, without the documents that hold one."""
    named, digest, spans = (unused(df, c) for c in ("named", "digest", "spans"))
    hit = contamination(df, items, key, text, item, item_text, window).where("n_hit > 0")
    hit = hit.select(F.col(key).alias(named), F.col("digest").alias(digest), F.col("spans").alias(spans))
    same = F.col(key).eqNullSafe(F.col(named)) & (F.sha2(F.coalesce(F.col(text), F.lit("")), 256) == F.col(digest))
    if whole:
        return df.join(hit, same, "left_anti")
    cut = F.when(F.col(spans).isNull(), F.col(text)).otherwise(without_passages(F.col(text), F.col(spans)))
    return df.join(hit, same, "left").select(*(cut.alias(c) if c == text else F.col(c) for c in df.columns))
