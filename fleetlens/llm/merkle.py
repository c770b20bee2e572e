"""Merkle dataset manifest: a digest per row, a tree of digests per group, one root, and a proof per row.

A leaf is the SHA-256 of the row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. The leaves of a group ascend
by key; while a group has several nodes, every ``FAN`` consecutive ones (the last run may be shorter, even one) become the SHA-256 of their
hex digests. What remains is the group's subroot; subroots in order of their groups (null first, then bytewise) give the root by the same rule.

A level is one window over nodes in order: ``lag`` and ``lead`` at fixed offsets, masked by the node's slot in its run and by the run's
length, are its siblings, and the row of a run's first child hashes the parent. Parents stay on the row of their first leaf, so the
offsets of level l are multiples of ``FAN ** l`` and all levels of a block share one shuffle and one sort. A block is
``FAN ** STEPS`` consecutive nodes, so a group of any size is spread over many tasks and no run crosses a block; the tops of blocks are the
nodes of the next tier, a table 4096 times smaller. Row numbers come from a range partitioning and one count per partition.

Defined results: rows with equal keys are ordered by their leaves (equal rows have equal results); null keys come first; a group of
one row has its leaf as subroot; null and empty text are different fields; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import materialize

FAN, STEPS = 8, 4
BLOCK = FAN**STEPS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row's fields."""
    texts = [c.cast("string") for c in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``at``: the row's number in the order, from 0. Rows are range-partitioned and sorted; a number is its place in the partition and the
    count of rows in earlier ones. Equal rows are dealt out by a seeded random column, so they do not meet in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "dealt"]
    ranged = df.withColumn("dealt", F.rand(17)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("dealt")
    held = materialize(ranged.withColumn("place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition, so the next window and broadcast are bounded
    begins = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    rows = held.withColumn("part", part).join(F.broadcast(begins), "part")
    return rows.withColumn("at", F.col("begin") + F.col("place").bitwiseAND(F.lit(2**33 - 1))).drop("part", "begin", "place")


def levels(nodes: DataFrame, both: bool) -> DataFrame:
    """Adds ``top`` (on a block's first row: the digest of the block) and, with ``both``, per level ``left``, ``right`` and ``several``: the
    siblings before and after the row's ancestor, and whether the group has more than one node there."""
    block = Window.partitionBy("tree", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    rows = nodes.withColumn("top", F.col("digest"))
    for level in range(STEPS):
        stride = FAN**level
        number, on_level = F.floor(F.col("pos") / stride), F.floor((F.col("size") + stride - 1) / stride)
        slot, several, here = number % FAN, on_level > 1, F.col("pos") % stride == 0
        length = F.least(F.lit(FAN), on_level - (number - slot))
        before = [F.when(here & several & (slot >= k), F.lag("top", k * stride).over(block)) for k in range(FAN - 1, 0, -1) if both]
        after = [F.when(here & several & (slot + k < length), F.lead("top", k * stride).over(block)) for k in range(1, FAN)]
        sides = {f"right{level}": F.when(here, F.concat_ws("", *after))} | ({f"left{level}": F.when(here, F.concat_ws("", *before)), f"several{level}": several} if both else {})
        rows = rows.withColumns(sides)
        parent = F.when(several, digest(F.col("top"), F.col(f"right{level}"))).otherwise(F.col("top"))
        rows = rows.withColumn("top", F.when(here & (slot == 0), parent))
        if not both:
            rows = rows.drop(f"right{level}")
    if both:  # what stands on an ancestor's row holds for all rows below it
        down = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({f"{side}{level}": F.last(f"{side}{level}", ignorenulls=True).over(down) for level in range(STEPS) for side in ("left", "right")})
    return rows


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """(tree, pos, digest, size) of the leaves, of the tops of their blocks, and so on; the last tier has one node per tree."""
    found = [nodes]
    while not nodes.where("size > 1").isEmpty():
        tops = levels(nodes.select("tree", "pos", "digest", "size"), False).where(F.col("pos") % BLOCK == 0)
        nodes = materialize(tops.select("tree", F.floor(F.col("pos") / BLOCK).alias("pos"), F.col("top").alias("digest"), F.floor((F.col("size") + BLOCK - 1) / BLOCK).alias("size")), "tree-tier")
        found.append(nodes)
    return found


def climbed(rows: DataFrame) -> DataFrame:
    """``found`` folded with the siblings of a tier, and the siblings added to ``proof``."""
    for level in range(STEPS):
        folded = F.when(F.col(f"several{level}"), digest(F.col(f"left{level}"), F.col("found"), F.col(f"right{level}"))).otherwise(F.col("found"))
        rows = rows.withColumn("found", folded).withColumn("proof", F.concat("proof", f"left{level}", f"right{level}"))
    return rows.drop(*(f"{c}{level}" for level in range(STEPS) for c in ("left", "right", "several")), "top")


def to_the_top(rows: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Rows of the lowest tier, with ``found`` and ``proof`` carried up through all tiers."""
    for height, tier in enumerate(steps[:-1]):  # the last tier has no siblings
        if height == 0:
            rows = climbed(levels(rows, True))
            continue
        above = levels(tier, True).select("tree", F.col("pos").alias("over"), *(f"{c}{level}" for level in range(STEPS) for c in ("left", "right", "several")))
        rows = climbed(rows.withColumn("over", F.floor(F.col("pos") / BLOCK**height)).join(above, ["tree", "over"])).drop("over")
    return rows


def manifest(df: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, seen: dict[str, Column] | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, proof_sha256, folded_root, verified): a row per row.

    ``proof_sha256`` is the digest of the row's siblings from its leaf to the root, left to right. ``seen`` are columns as someone finds
    them later: ``folded_root`` comes from the leaf of those and the stored siblings, and ``verified`` says whether it is the root.
    """
    stored = [F.col(c) for c in fields]
    later = [(seen or {}).get(c, F.col(c)) for c in fields]
    leaves = materialize(df.select(F.col(key).alias("key"), F.col(group).alias("family"), leaf_of(stored).alias("digest"), leaf_of(later).alias("found")), "leaves")
    rows = numbered(leaves, "family", "key", "digest")
    families = materialize(rows.groupBy("family").agg(F.min("at").alias("tree"), F.count("*").alias("size")), "families")
    rows = rows.join(families.withColumnRenamed("family", "named"), F.col("family").eqNullSafe(F.col("named"))).drop("named")
    rows = materialize(rows.select("key", "family", "digest", "found", "tree", (F.col("at") - F.col("tree")).alias("pos"), "size"), "placed-leaves")
    below = tiers(rows.select("tree", "pos", "digest", "size"))
    groups = materialize(numbered(below[-1].select(F.col("tree").alias("named"), "digest"), "named"), "subroots")
    count = groups.count()
    subroots = groups.select("named", F.lit(0).cast("long").alias("tree"), F.col("at").alias("pos"), "digest", F.lit(count).cast("long").alias("size"))
    above = tiers(subroots.select("tree", "pos", "digest", "size"))
    root = above[-1].first()  # one row
    if root is None:
        return df.sparkSession.createDataFrame([], f"{key} {leaves.schema['key'].dataType.simpleString()}, {group} {leaves.schema['family'].dataType.simpleString()}, leaf string, subroot string, "
                                                   "root string, proof_sha256 string, folded_root string, verified boolean")
    rows = to_the_top(rows.withColumn("proof", F.lit("")), below)
    rows = rows.select("key", "family", F.col("digest").alias("leaf"), F.col("tree").alias("named"), "found", "proof").join(subroots.withColumnRenamed("digest", "subroot"), "named")
    rows = to_the_top_of_groups(rows, above)
    return rows.select(F.col("key").alias(key), F.col("family").alias(group), "leaf", "subroot", F.lit(root["digest"]).alias("root"), F.sha2("proof", 256).alias("proof_sha256"),
                       F.col("found").alias("folded_root"), (F.col("found") == root["digest"]).alias("verified"))


def to_the_top_of_groups(rows: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Rows with the ``pos`` of their subroot, carried up through the tiers of subroots."""
    for height, tier in enumerate(steps[:-1]):
        above = levels(tier, True).select(F.col("pos").alias("over"), *(f"{c}{level}" for level in range(STEPS) for c in ("left", "right", "several")))
        rows = climbed(rows.withColumn("over", F.floor(F.col("pos") / BLOCK**height)).join(above, "over")).drop("over")
    return rows
