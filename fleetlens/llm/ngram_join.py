"""Join of documents whose sets of word n-grams have a Jaccard similarity of at least ``similarity``, by chosen paths.

Each run samples tokens of a set with a shared hash, one out of ``similarity * size`` on average, so a pair at the threshold
shares at least one sampled token on average. A sampled token is a bucket; within a bucket that has more than ``SMALL``
members the next level samples tokens again with a hash of the path so far, and so on to ``LEVELS``. A path depends on the
document alone, so all paths come from one pass over the texts; levels are read only where buckets are large. Runs are
repeated until the recall that branching-process survival promises for a pair at the threshold reaches ``RECALL``.

1. Equal sets are one node from the start; nothing is compared within such a class.
2. Buckets that hold several nodes are kept, and of those with more than ``SMALL`` nodes their next level instead. Bottom-k sketches
   compare nodes: first each node with the least one of its bucket, in one of ``LEADERS`` buckets, which ties large groups of
   copies together in linear work; then, where buckets still hold several components, all pairs of different components.
   Buckets beyond ``SMALL`` on the last level are compared in pairs of blocks, so none is cut.
3. Every pair within a component is compared exactly, by whole sets in pairs of blocks; only counts and spanning edges leave.

The result has a row per document: ``class_id`` (least document of the connected class) and ``n_links`` (documents within the
similarity, copies counted). Defined results: null and empty texts have no n-gram, are a class of their own and have no link;
a text with fewer words than n is one n-gram; equal texts are linked; rows with the same key must not occur twice (they are
taken as one document); a null key drops out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map, by_group, keyed_text, likely_among, mix64
from fleetlens.llm.components import components
from fleetlens.llm.words import hashed_words, shingles
from fleetlens.session import materialize

WORDS, SIMILARITY, RECALL, LEVELS, SMALL, SKETCH, LEADERS = 5, 0.8, 0.9999, 2, 128, 64, 4
#: what a sketch may be short of the similarity: four standard deviations
SLACK = 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / SKETCH)


def survival(level: int) -> float:
    """Chance that a pair at the threshold shares a path of so many levels within one run: one shared child on average."""
    return 1.0 if level == 0 else 1 - math.exp(-survival(level - 1))


def runs(recall: float = RECALL, levels: int = LEVELS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def sampled(tokens: np.ndarray, parents: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that the parents' hashes pick: number of the parent, and the path that the token adds to it."""
    with np.errstate(over="ignore"):
        parent, token = np.nonzero(tokens[None, :] * (mix64(parents) | np.uint64(1))[:, None] < np.uint64(share))
        return parent, mix64(tokens[token] + parents[parent])


def paths(tokens: np.ndarray, similarity: float, n_runs: int, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(number of the parent, path) of each level; the parents of the first level are the runs."""
    share = min(2**64 - 1, int(2**64 / (similarity * len(tokens)))) if len(tokens) else 0
    parents, found = mix64(np.arange(n_runs, dtype=np.uint64) + np.uint64(1)), []
    for _ in range(levels):
        found.append(sampled(tokens, parents, share))
        parents = found[-1][1]
    return found


def sets_of(column: pa.Array, n: int):
    """The sorted distinct n-gram hashes of each text."""
    for part in hashed_words(column):
        at, grams = part.offsets.tolist(), shingles(part.hashes, n)
        for d, words in enumerate(part.counts.tolist()):
            yield np.unique(grams[at[d]:at[d + 1] - n + 1] if words >= n else shingles(part.hashes[at[d]:at[d + 1]], n))


SCHEMA = "key binary, node long, size int, sketch binary, " + ", ".join(f"level{i} array<struct<parent:int,path:long>>" for i in range(LEVELS))


def lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(p) for p, _ in parts])].astype("i4")
    parent, path = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(parent.astype("i4")), pa.array(path.view(np.int64))], ["parent", "path"]))


def read_sets(df: DataFrame, key: str, text: str, n: int, similarity: float) -> DataFrame:
    """Per document: digests of its set of n-grams (null if empty; ``node`` is the short one), the set's size, bottom-k sketch
    (upper halves of the least hashes) and paths."""
    n_runs = runs()

    def run(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows:
            return None
        out: dict[str, list] = {c: [] for c in ["key", "size", "sketch", *(f"level{i}" for i in range(LEVELS))]}
        for tokens in sets_of(batch.column(1), n):
            out["key"].append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            out["size"].append(len(tokens))
            out["sketch"].append((tokens[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
            for i, level in enumerate(paths(tokens, similarity, n_runs, LEVELS)):
                out[f"level{i}"].append(level)
        nodes = [k and int.from_bytes(k[:8], "little", signed=True) for k in out["key"]]
        return out | {"doc": batch.column(0), "node": nodes} | {f"level{i}": lists(out[f"level{i}"]) for i in range(LEVELS)}

    slim = keyed_text(df, key, text).where(F.col(key).isNotNull())
    return arrow_map(slim, run, f"doc {slim.schema[key].dataType.simpleString()}, {SCHEMA}")


def alike(sketches: list[np.ndarray], whole: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarities of the pairs (left, right). Below the smaller of two sketches' ends both show all they
    have, so the share there estimates that of the sets; a whole set has no end."""
    high = np.uint32(2**32 - 1)
    table = np.full((len(sketches), SKETCH), high)
    for i, s in enumerate(sketches):
        table[i, :len(s)] = s
    ends = np.where(whole, high, table[:, -1])
    out = np.empty(len(left))
    for k in range(0, len(left), 8192):
        a, b = left[k:k + 8192], right[k:k + 8192]
        end = np.minimum(ends[a], ends[b])[:, None]
        merged = np.sort(np.concatenate([table[a], table[b]], 1), 1)
        seen = (merged <= end) & (merged < high)
        both = ((merged[:, 1:] == merged[:, :-1]) & seen[:, 1:]).sum(1)
        out[k:k + 8192] = both / np.maximum(1, seen.sum(1) - both)
    return out


def in_blocks(members: DataFrame, group: str, member: str, size: str, small: int = SMALL) -> DataFrame:
    """Adds block pairs (bi, bj): a group up to ``small`` rows is one block; larger ones are dealt to blocks, and each row goes
    to every pair that its block is part of. ``mine`` is the row's block."""
    blocks = members.withColumn("blocks", F.ceil(F.col(size) / small).cast("int")).withColumn("mine", F.expr(f"pmod(xxhash64({group}, {member}), blocks)").cast("int"))
    return blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj")).drop("other", "blocks")


def linked_by_sketch(similarity: float):
    """Spanning edges among the components whose members' sketches look alike, as edges between their roots."""

    def compare(group: pa.Table) -> dict:
        labels, mine = (group.column(c).to_numpy() for c in ("root", "mine"))
        if labels.min() == labels.max():
            return {"a": [], "b": []}
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        left, right = np.triu_indices(len(labels), 1)
        keep = labels[left] != labels[right]
        if bi != bj:
            keep &= mine[left] != mine[right]
        left, right = left[keep], right[keep]
        sketches = [np.frombuffer(s, "<u4") for s in group.column("sketch").to_pylist()]
        hit = alike(sketches, group.column("size").to_numpy() <= SKETCH, left, right) >= similarity - SLACK
        roots, place = np.unique(labels, return_inverse=True)
        return spanning(roots, place[left[hit]], place[right[hit]])

    return compare


def lowest_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of the n nodes that each one is connected to."""
    lowest = np.arange(n)
    while True:
        new = lowest.copy()
        np.minimum.at(new, left, lowest[right])
        np.minimum.at(new, right, lowest[left])
        new = new[new]
        if (new == lowest).all():
            return lowest
        lowest = new


def spanning(docs: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict:
    """Edges from each node to the least node of its component, instead of all edges."""
    lowest = lowest_of(len(docs), left, right)
    moved = lowest != np.arange(len(docs))
    return {"a": docs[moved].tolist(), "b": docs[lowest[moved]].tolist()}


def leader_edges(batch: pa.RecordBatch, similarity: float) -> dict:
    sketches = [np.frombuffer(s, "<u4") for c in ("sketch", "lead_sketch") for s in batch.column(c).to_pylist()]
    n = batch.num_rows
    whole = np.concatenate([batch.column(c).to_numpy() <= SKETCH for c in ("size", "lead_size")])
    hit = np.flatnonzero(alike(sketches, whole, np.arange(n), np.arange(n) + n) >= similarity - SLACK) if n else []
    return {"a": batch.column("node").take(pa.array(hit, pa.int64())), "b": batch.column("lead").take(pa.array(hit, pa.int64()))}


def bucket_rows(sets: DataFrame) -> DataFrame:
    """(bucket, node, members), from a row per class of equal sets, of buckets that hold several nodes: those of each level that aren't too large, and all that are left
    on the last."""
    out, large = None, None
    for i in range(LEVELS):
        above = F.col("p.parent") if i == 0 else F.get(F.col(f"level{i - 1}.path"), F.col("p.parent"))
        rows = sets.select("*", F.explode(f"level{i}").alias("p")).select("node", above.alias("parent"), F.col("p.path").alias("bucket"))
        if large is not None:
            rows = rows.join(large, "parent", "left_semi")
        mixed = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("bucket")
        held = materialize(rows.join(mixed, "bucket").select("bucket", "node").distinct(), "bucket-nodes")
        sizes = held.groupBy("bucket").agg(F.count("*").alias("members"))
        found = held.join(sizes if i == LEVELS - 1 else sizes.where(f"members <= {SMALL}"), "bucket")
        out = found if out is None else out.unionByName(found)
        large = materialize(sizes.where(f"members > {SMALL}").select(F.col("bucket").alias("parent")), "large-buckets")
    return out


def exact_links(similarity: float):
    """Links and spanning edges of a pair of blocks, from whole sets."""

    def compare(group: pa.Table) -> dict:
        group = group.take(pa.array(np.unique(group.column("doc").to_numpy(), return_index=True)[1]))  # repeated rows count once
        docs, mine, copies = (group.column(c).to_numpy() for c in ("doc", "mine", "copies"))
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in group.column("tokens").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        common = np.zeros((len(sets), len(sets)), "f4")
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for k in range(0, len(tokens), 4096):
            s, e = np.searchsorted(place, [k, k + 4096])
            x = np.zeros((len(sets), min(4096, len(tokens) - k)), "f4")
            x[owner[s:e], place[s:e] - k] = 1
            common += x @ x.T
        near = common >= similarity * (sizes[:, None] + sizes - common) - 1e-6
        np.fill_diagonal(near, False)
        tied = np.arange(len(docs))
        if bi != bj:
            across = mine[:, None] != mine
            tied = lowest_of(len(docs), *np.nonzero(near & ~across))  # the blocks' own groups give these edges
            near &= across
        found = spanning(docs, *(tied[x] for x in np.nonzero(near)))
        links = near @ copies
        return {"doc": [*docs.tolist(), *found["a"]], "links": [*links.tolist(), *[0] * len(found["a"])], "near": [*[None] * len(docs), *found["b"]]}

    return compare


def token_sets(df: DataFrame, text: str, n: int) -> DataFrame:
    """The rows with their text replaced by its set of n-grams."""
    others = [c for c in df.columns if c != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(others).schema)

    def run(batch: pa.RecordBatch) -> dict:
        return {c: batch.column(c) for c in others} | {"tokens": [t.tobytes() for t in sets_of(batch.column(text), n)]}

    return arrow_map(df, run, f"{kinds}, tokens binary")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: key, ``class_id``, ``n_links``."""
    docs = keyed_text(df, key, text)
    sets = materialize(read_sets(docs, key, text, n, similarity), "ngram-sets")
    kind = sets.schema["doc"].dataType.simpleString()
    # 1: classes of equal sets
    classes = materialize(sets.where("size > 0").groupBy("key").agg(F.min("node").alias("node"), F.min("doc").alias("rep"), F.countDistinct("doc").alias("copies")), "ngram-classes")
    # only the least document of a class goes on; it is met by its own key, as the class's key may be that of very many rows
    firsts = materialize(sets.join(classes.select(F.col("rep").alias("doc"), "key"), ["doc", "key"], "left_semi").drop("doc", "key"), "ngram-nodes")
    # 2: components of what looks alike, first by each bucket's least node, then among components
    buckets = materialize(bucket_rows(firsts), "buckets")
    slim = firsts.join(buckets.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("size").alias("size"), F.min("sketch").alias("sketch"))
    slim = materialize(slim, "sketches")
    some = buckets.where(F.pmod("bucket", F.lit(LEADERS)) == 0)
    leads = some.groupBy("bucket").agg(F.min("node").alias("lead"))
    led = some.join(leads, "bucket").where("node != lead").select("node", "lead").distinct()
    lead_slim = slim.select(F.col("node").alias("lead"), F.col("size").alias("lead_size"), F.col("sketch").alias("lead_sketch"))
    edges = materialize(arrow_map(led.join(slim, "node").join(lead_slim, "lead"), lambda b: leader_edges(b, similarity), "a long, b long"), "leader-edges")
    labelled = buckets.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("bucket")
    open_pairs = in_blocks(labelled.join(mixed, "bucket"), "bucket", "node", "members").join(slim, "node")
    more = by_group(open_pairs, ["bucket", "bi", "bj"], linked_by_sketch(similarity), "a long, b long")
    loose = components(edges.unionByName(more))
    # 3: exact links within components
    sizes = loose.groupBy("root").agg(F.count("*").alias("members"))
    asked = materialize(loose.join(sizes, "root").join(classes, "node").select(F.col("rep").alias("doc"), "root", "members", "copies"), "asked")
    texts = likely_among(docs.select(F.col(key).alias("doc"), text), "doc", asked, "doc")
    whole = token_sets(asked.join(texts, "doc"), text, n)
    exact = materialize(by_group(in_blocks(whole, "root", "doc", "members"), ["root", "bi", "bj"], exact_links(similarity), f"doc {kind}, links long, near {kind}"), "exact-links")
    final = components(exact.where("near is not null").select(F.col("doc").alias("a"), F.col("near").alias("b")))
    links = exact.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links"))
    found = classes.join(links, "rep", "left").join(final.select(F.col("node").alias("rep"), "root"), "rep", "left")
    found = found.select("key", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sets.select("doc", "key").distinct().join(found, "key", "left")
    return out.select(F.col("doc").alias(key), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of the least document of each class, with all their columns; rows with a null key stay."""
    kept = near_duplicates(df, key, text, n, similarity).where(F.col(key) == F.col("class_id")).select(key)
    return df.join(kept, key, "left_semi").unionByName(df.where(F.col(key).isNull()))
