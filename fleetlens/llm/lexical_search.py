"""Ranked lexical search: NRA over impact-sorted lists.

Terms are plain words (``common.plain_words``). One pass over the documents keeps each one's number of terms and its counts of the
items' terms; the counts of the corpus come from that table. Then every shard of documents (at most ``SHARD`` postings) has its lists:
per term, its documents by falling impact. An item's lists are read in step, ``STEP`` times deeper each round, without random
access. A document's lower score is what has been read of it; its upper score adds, for each list it was not met in, the last
impact read there. Reading ends when no document that was not met can reach the k-th lower score, and each that still can, ties included, has
equal lower and upper scores. The best of all shards meet by (item, score). A shard starts from the k-th score that its task has seen, so later shards read
less. Items are handled in blocks of about ``VOCABULARY`` terms, which bounds what is sent to the tasks; N, L and document frequencies cover all documents.

Defined results: each row of the documents is a document, so rows that share a key are ranked one by one, a null key comes first among equals; null and
empty texts have no terms and are not counted; rows that share an item id (or have none) are one item; items without terms or
without a document above 0 have no rows; empty tables give none; texts of any length are read whole, in pieces; extra columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, plain_words
from fleetlens.session import materialize

VOCABULARY, SHARD, FIRST, STEP = 200_000, 2_000_000, 16, 4
#: bytes of a text that are split at a time
PIECE = 1 << 20
#: upper-case ASCII letters become lower-case ones, all other ASCII characters but letters and digits become spaces
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms, and counts by number of those in the vocabulary."""
    n, counts, plain, at = 0, Counter(), text.translate(PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        words = plain[at:end if end >= 0 else None].split()
        n += len(words)
        counts.update(map(vocabulary.get, words))
        at = end if end >= 0 else len(plain)
    counts.pop(None, None)
    return n, counts


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, counts) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batch: pa.RecordBatch) -> dict:
        found = [term_counts(t or b"", shared.value) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
        return {"key": batch.column(0), "n": [n for n, _ in found], "terms": [list(c) for _, c in found], "counts": [list(c.values()) for _, c in found]}

    return arrow_map(docs, rows, f"key {docs.schema['key'].dataType.simpleString()}, n long, terms array<int>, counts array<long>")


def read_lists(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, least: int) -> np.ndarray:
    """Scores of a shard's documents; those of its k best are final, as are those of any that ties with them. Lists are
    (documents, impacts) by falling impact; below ``least``, and at 0, a score is of no interest."""
    lower, depth, done = np.zeros(docs, np.int64), FIRST, 0
    while True:
        bounds, unseen = [], np.zeros(docs, np.int64)
        for who, impact in lists:
            lower[who[done:depth]] += impact[done:depth]
            last = int(impact[depth - 1]) if depth < len(impact) else 0
            bounds.append(last)
            if last:
                unseen[who[:depth]] -= last
        ahead = sum(bounds)
        kth = max(least, 1, int(np.partition(lower, -k)[-k]) if docs >= k else 0)
        if ahead == 0 or ahead < kth and not np.any((unseen != -ahead) & (lower + unseen + ahead >= kth)):
            return np.where(lower >= kth, lower, 0)
        done, depth = depth, depth * STEP


def top_of_shards(batches: Iterator[pa.RecordBatch], items: list, weights: np.ndarray, documents: int, length: int, k: int, types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    best = np.zeros((len(items), k), np.int64)  # of this task so far, falling
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, int)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SHARD, "right")))
            shard, found = batch.slice(start, end - start), []
            start = end
            term, tf = shard.column("terms").flatten().to_numpy(), shard.column("counts").flatten().to_numpy()
            n = shard.column("n").to_numpy()
            who = np.repeat(np.arange(shard.num_rows), pc.list_value_length(shard.column("terms")).to_numpy())
            m = 10 + (90 * n * documents) // length
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[who]))
            by = np.lexsort((-impact, term))
            who, impact, edges = who[by], impact[by], np.searchsorted(term[by], np.arange(len(weights) + 1))
            rank = np.empty(shard.num_rows, np.int64)
            rank[pc.sort_indices(shard.column("key"), null_placement="at_start").to_numpy()] = np.arange(shard.num_rows)
            for number, (_, own) in enumerate(items):
                lists = [(who[edges[t]:edges[t + 1]], impact[edges[t]:edges[t + 1]]) for t in own if edges[t] < edges[t + 1]]
                lists = [x for x in lists if x[1][0] > 0]
                least = int(best[number, -1])
                if not lists or sum(int(v[0]) for _, v in lists) < least:
                    continue
                scores = read_lists(lists, shard.num_rows, k, least)
                met = np.flatnonzero(scores)
                met = met[np.lexsort((rank[met], -scores[met]))][:k]
                best[number] = -np.sort(-np.r_[best[number], scores[met]])[:k]
                found += [(number, int(d), int(scores[d])) for d in met]
            if found:
                ids, at, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([items[i][0] for i in ids], types[0]), shard.column("key").take(pa.array(at)).cast(types[1]), pa.array(score, pa.int64())], ["item", "key", "score"])


def search(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item, rank, key, score): per item its k best documents, falling, equal scores by ascending key."""
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    wanted = materialize(items.select(F.col(item).alias("item"), F.explode(plain_words(item_text)).alias("term")).distinct(), "item-terms")
    blocks = max(1, -(-wanted.count() // VOCABULARY))
    schema = f"item {wanted.schema['item'].dataType.simpleString()}, key {docs.schema['key'].dataType.simpleString()}, score long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()  # about VOCABULARY terms
        found = found.unionByName(block_search(docs, [(r["item"], r["terms"]) for r in rows], k, schema))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def block_search(docs: DataFrame, items: list[tuple], k: int, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    vocabulary = {t.encode(): n for n, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    rows = materialize(postings(docs, vocabulary), "postings")
    documents, length = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents or not items:
        return spark.createDataFrame([], schema)
    frequency = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most a row per term of the block
    weights = np.zeros(len(vocabulary), np.int64)
    for term, df in frequency:
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    shared = spark.sparkContext.broadcast(([(i, sorted(vocabulary[t.encode()] for t in terms)) for i, terms in items], weights))
    empty = spark.createDataFrame([], schema).schema
    types = (to_arrow_type(empty["item"].dataType), to_arrow_type(empty["key"].dataType))
    return rows.where(F.size("terms") > 0).mapInArrow(lambda batches: top_of_shards(batches, *shared.value, documents, length, k, types), schema)
