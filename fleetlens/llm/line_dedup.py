"""Line dedup: a line goes if an earlier line, in order of (document, line number), is the same or within ``EDITS`` edits.

All work is DataFrame expressions. Equal lines meet by hash. For near lines, a pair within t edits shares at least one of the t + 1
segments of the shorter line, unchanged and hardly moved: each line is listed under its own segments (index) and, for each
length that a partner can have, under the substrings of its own that can be such a segment (probes, the positions that
multi-match-aware selection leaves). Keys that different lines share give candidates. A key with more than ``CROWD``
lines in its index is split again: what is left of its lines without the shared segment must be within t edits as well, so it
is cut into segments in turn, until keys are small or hardly anything is left. As one earlier near line is enough, the lines of
a key first meet its earliest line alone; all pairs are made only where a line behind it is left open, less those whose counts of
characters differ too much. Candidates are verified by a banded
bit-parallel edit distance: one bit per diagonal of the band, one integer per number of edits; those that the built-in bounded distance
rules out don't come to it.

Defined results: blank lines always stay; lines with fewer than ``MIN_CHARS`` characters go only if equal; null and empty texts are
one blank line; rows that share a key are one document whose rows keep the same lines; rows with a null key stay whole and are
no reference; a document that loses lines is its kept lines joined by a line feed; an empty table gives no rows. Keys are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import keyed_text, likely_among, unused
from fleetlens.session import materialize

EDITS, MIN_CHARS, CROWD = 2, 20, 64
#: line numbers below a key in the number that orders lines
PER_DOC = 2**31
#: kinds of characters that are counted to rule pairs of lines out
KINDS = 16


def segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of the i-th of even parts; the last ones are longer by one where it doesn't come out even."""
    size = F.floor(length / parts).cast("int")
    longer = parts - (length - size * parts)
    return size * i + F.greatest(F.lit(0), i - longer), size + F.when(i >= longer, 1).otherwise(0)


def places(edits: int, probes: bool) -> Column:
    """A constant array of where to look: for probes, how much shorter the partner is, which segment, and how far it moved."""
    found = []
    for shorter in range(edits + 1 if probes else 1):
        for i in range(edits + 1):
            shifts = range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1) if probes else (0,)
            found += [F.struct(F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for shift in shifts]
    return F.array(*found)


def segment_rows(lines: DataFrame, above: str | None, text: str, edits: int, probes: bool, rest: bool) -> DataFrame:
    """(id, key[, rest]) of the segments that stand for a line, or of the substrings that can be a partner's segment. One short
    expression per row of places: a single expression for all of them would be too long to be compiled."""
    rows = lines.withColumn("chars", F.char_length(text)).withColumn("look", F.explode(places(edits, probes)))
    chars = F.col("chars") - F.col("look.shorter")
    start, size = segment(chars, F.col("look.i"), edits + 1)
    rows = rows.where(chars > edits).select("*", (start + F.col("look.shift")).alias("at"), size.alias("size"), chars.alias("theirs")).where("at >= 0 and at + size <= chars")
    def hashed(line: Column) -> Column:
        return F.xxhash64(*([F.col(above)] if above else []), F.col("look.i"), F.col("theirs"), F.substring(line, F.col("at") + 1, F.col("size")))

    # where each character is a byte, places of bytes are found without reading what is before them; equal bytes have equal hashes
    key = F.when(F.octet_length(text) == F.col("chars"), hashed(F.col(text).cast("binary"))).otherwise(hashed(F.col(text)))
    left = F.concat(F.substring(text, F.lit(1), F.col("at")), F.substring(text, F.col("at") + F.col("size") + 1, F.col("chars")))
    return rows.select("id", key.alias("key"), *([left.alias("rest")] if rest else []))


def keys_of(lines: DataFrame, edits: int, probes: bool) -> DataFrame:
    return segment_rows(lines, None, "line", edits, probes, False)


def rests_of(rows: DataFrame, above: str | None, text: str, edits: int, probes: bool) -> DataFrame:
    return segment_rows(rows, above, text, edits, probes, True)


def bag(text: str) -> Column:
    """How many characters of each of some kinds a text has; characters beyond ASCII are of none."""
    kinds = ["".join(chr(c) for c in range(32, 127) if c % KINDS == k) for k in range(KINDS)]
    return F.array(*(F.char_length(text) - F.char_length(F.translate(text, kind, "")) for kind in kinds))


def bags_within(a: Column, b: Column, edits: int) -> Column:
    """Whether texts with such bags can be within so many edits: an edit takes a character from one kind and adds one to another at most."""
    return sum((F.abs(F.get(a, F.lit(k)) - F.get(b, F.lit(k))) for k in range(KINDS)), F.lit(0)) <= 2 * edits


def edit_distance_within(a: Column, b: Column, edits: int) -> Column:
    """Whether b (not shorter than a) is within so many edits of a.

    Bit k of state e says that a prefix of a, k - edits characters longer than the prefix of b read so far, is within e edits of it.
    """
    wide = 2 * edits + 1
    full = (1 << wide) - 1
    chars = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.char_length(a).alias("m"), F.char_length(b).alias("n"))

    def run(c: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            same = sum((F.when(F.get(c["a"], j + (k - edits)) == F.get(c["b"], j), 1 << k).otherwise(0) for k in range(wide)), F.lit(0))
            states = [acc["r0"].bitwiseAND(same)]
            for e in range(1, edits + 1):
                before, after = acc[f"r{e - 1}"], states[e - 1]
                moved = F.shiftright(before, 1).bitwiseOR(before).bitwiseOR(F.shiftleft(after, 1))
                states.append(acc[f"r{e}"].bitwiseAND(same).bitwiseOR(moved).bitwiseAND(F.lit(full)))
            return F.when(acc[f"r{edits}"] == 0, acc).otherwise(F.struct(*(s.alias(f"r{e}") for e, s in enumerate(states))))

        first = F.struct(*(F.lit(((1 << (e + 1)) - 1) << edits).alias(f"r{e}") for e in range(edits + 1)))
        done = F.call_function("shiftleft", F.lit(1), c["m"] - c["n"] + edits)
        return F.aggregate(F.sequence(F.lit(0), c["n"] - 1), first, step, lambda acc: acc[f"r{edits}"].bitwiseAND(done) != 0)

    # one binding of the split texts, so that they are split once
    far = (F.char_length(b) - F.char_length(a) > edits) | (F.levenshtein(a, b, edits) < 0)
    return F.when(far, F.lit(False)).otherwise(F.element_at(F.transform(F.array(chars), run), 1))


def crowded_pairs(index: DataFrame, probe: DataFrame, edits: int, crowd: int) -> DataFrame:
    """Candidates (a, b) of keys that several lines share, of which the later line is open and which their characters don't rule out;
    ``id`` is (place, id, open, bag) of a line. Crowded keys are split by segments of what is left of their lines."""
    pairs = None
    while True:
        sizes = index.groupBy("key").agg(F.count("*").alias("lines"))
        index = materialize(index.join(sizes, "key").withColumn("split", (F.col("lines") > crowd) & (F.char_length("rest") > edits)), "crowded-index")
        later = F.greatest("a", "b")
        mine, theirs = index.where("not split").select("key", F.col("id").alias("a")), probe.select("key", F.col("id").alias("b"))
        met = mine.where("a.open").join(theirs, "key").unionByName(mine.where("not a.open").join(theirs.where("b.open"), "key"))
        found = met.where((F.col("a.id") != F.col("b.id")) & later["open"] & bags_within(F.col("a.bag"), F.col("b.bag"), edits)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
        again = index.where("split")
        if again.isEmpty():
            return pairs
        hot = again.select("key").distinct()
        next_index = rests_of(again, "key", "rest", edits, False).distinct()
        next_probe = rests_of(probe.join(hot, "key", "left_semi"), "key", "rest", edits, True).distinct()
        shared = next_index.groupBy("key").agg(F.count("*").alias("n")).select("key")
        index, probe = next_index, materialize(next_probe.join(shared, "key", "left_semi"), "crowded-probes")


def met_segments(lines: DataFrame, edits: int) -> DataFrame:
    """(key, low, high, id): probes that meet a segment of another line; ``low`` and ``high`` are the least and the greatest line
    with the segment. A line probes its own segments too, so all lines of a segment that several have are among its ids."""
    index = keys_of(lines, edits, False).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    probe = keys_of(lines, edits, True)
    index = index.hint("shuffle_hash")  # a row per key, so what a task holds is as small as its share of the keys; neither side is sorted
    return probe.join(index, (probe.key == index.key) & ~((F.col("low") == F.col("high")) & (F.col("low") == F.col("id")))).select(index.key, "low", "high", "id").distinct()


def led_lines(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(key, lead, id): lines with the earliest line that has a segment they meet."""
    shared = met.where("low != high")
    index = keys_of(texts.select(F.struct("place", "id").alias("id"), "line"), edits, False).join(shared.select("key").distinct(), "key", "left_semi")
    leads = index.groupBy("key").agg(F.min("id").alias("least")).select("key", F.col("least.id").alias("lead"))
    return met.where("low = high").select("key", F.col("low").alias("lead"), "id").unionByName(shared.join(leads, "key").where("id != lead").select("key", "lead", "id"))


def open_pairs(led: DataFrame, texts: DataFrame, settled: DataFrame, edits: int, crowd: int) -> DataFrame:
    """Pairs (a, b) of ids of different lines that share a segment with each other and an earlier line, the later one not settled."""
    lines = texts.join(settled.withColumn("done", F.lit(True)), "id", "left").select(F.struct("place", "id", F.col("done").isNull().alias("open"), bag("line").alias("bag")).alias("id"), "line")
    left = led.join(settled, "id", "left_anti").select("key").distinct()
    rows = [materialize(rests_of(lines, None, "line", edits, probes).join(left, "key", "left_semi").distinct(), "shared-segments") for probes in (False, True)]
    return crowded_pairs(*rows, edits, crowd)


def near_ids(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Ids of the later lines of the pairs (a, b) that are near."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (texts.select(*(F.col(c).alias(f"{side}_{c}") for c in ("id", "place", "line"))) for side in "ab")
    both = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
    a_longer = F.char_length("a_line") > F.char_length("b_line")
    short, long = F.when(a_longer, F.col("b_line")).otherwise(F.col("a_line")), F.when(a_longer, F.col("a_line")).otherwise(F.col("b_line"))
    return both.where(edit_distance_within(short, long, edits)).select(F.when(F.col("a_place") > F.col("b_place"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, line, place) of lines that aren't blank; ``place`` orders them."""
    rows = docs.where(F.col(key).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("number", "line")).where(F.trim("line") != "")
    place = F.col(key).cast("decimal(20,0)") * F.lit(PER_DOC).cast("decimal(11,0)") + F.col("number")
    return rows.select(F.xxhash64("line").alias("id"), "line", place.cast("decimal(38,0)").alias("place"))


def lines_at(docs: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """Texts of lines by (id, place), read from the documents that hold them."""
    doc = F.floor(F.col("place") / F.lit(PER_DOC).cast("decimal(11,0)")).cast("long")
    asked = places.withColumn("doc", doc).withColumn("number", (F.col("place") - F.col("doc").cast("decimal(20,0)") * F.lit(PER_DOC).cast("decimal(11,0)")).cast("int"))
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("id", "place", "number")).alias("asked"))
    holders = likely_among(docs, key, asked, "doc")
    rows = holders.join(lists, F.col(key) == lists.doc).select(F.split(text, "\n").alias("lines"), F.explode("asked").alias("p"))
    return rows.select("p.id", "p.place", F.get("lines", F.col("p.number")).alias("line")).dropDuplicates(["id"])


def dropped_lines(docs: DataFrame, key: str, text: str, edits: int = EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """(id, place): lines that may go. An occurrence goes if its place is behind ``place``, or in any case where that is null."""
    every = numbered_lines(docs, key, text)
    firsts = materialize(every.groupBy("id").agg(F.min("place").alias("place"), F.count("*").alias("n")), "first-lines")
    met = materialize(met_segments(every.where(F.char_length("line") >= min_chars).select("id", "line"), edits), "met-segments")
    ids = met.select(F.explode(F.array("low", "high", "id")).alias("id")).distinct()
    asked = materialize(firsts.join(ids, "id", "left_semi").select("id", "place"), "asked-lines")
    texts = materialize(lines_at(docs, key, text, asked), "line-texts")
    led = materialize(led_lines(met, texts, edits), "led-lines")
    settled = materialize(near_ids(led.select(F.col("lead").alias("a"), F.col("id").alias("b")), texts, edits), "settled-lines")
    more = near_ids(open_pairs(led, texts, settled, edits, crowd), texts, edits)
    near = settled.unionByName(more).distinct().withColumn("near", F.lit(True))
    return firsts.join(near, "id", "left").where("near or n > 1").select("id", F.when(F.col("near").isNull(), F.col("place")).alias("place"))


def removed_numbers(docs: DataFrame, key: str, text: str, edits: int, min_chars: int, crowd: int) -> DataFrame:
    """(doc, removed): numbers of the lines to drop, for documents that lose any."""
    acts = materialize(dropped_lines(docs, key, text, edits, min_chars, crowd), "dropped-lines")
    doc = F.floor(F.col("at") / F.lit(PER_DOC).cast("decimal(11,0)")).cast("long")
    gone = numbered_lines(docs, key, text).select("id", F.col("place").alias("at")).join(acts, "id").where("place is null or at > place").withColumn("doc", doc)
    number = (F.col("at") - F.col("doc").cast("decimal(20,0)") * F.lit(PER_DOC).cast("decimal(11,0)")).cast("int")
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set(number)).alias("removed"))


def kept_lines(text: str, removed: str = "removed") -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(removed, i)), "\n")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """(key, kept, n_lines, n_removed, removed): the text of the kept lines and the numbers (from 0) of those that went."""
    docs = keyed_text(df, key, text)
    lists = removed_numbers(docs, key, text, edits, min_chars, crowd)
    rows = docs.join(lists, docs[key] == lists.doc, "left").withColumn("n_lines", F.size(F.split(text, "\n")).cast("long"))
    return rows.select(key, F.when(F.col("removed").isNull(), F.col(text)).otherwise(kept_lines(text)).alias("kept"), "n_lines",
                       F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """The rows, with all their columns, without their repeated lines; a document that lost lines and has but blank ones left goes."""
    doc, removed = unused(df, "doc"), unused(df, "removed")
    lists = removed_numbers(keyed_text(df, key, text), key, text, edits, min_chars, crowd).select(F.col("doc").alias(doc), F.col("removed").alias(removed))
    rows = df.join(lists, F.col(key) == F.col(doc), "left").withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(kept_lines(text, removed)))
    return rows.where(F.col(removed).isNull() | (F.trim(F.regexp_replace(text, "\n", "")) != "")).select(*df.columns)
