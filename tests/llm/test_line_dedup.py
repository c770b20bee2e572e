import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, edits=2, min_chars=20):
    lines = {k: (t or "").split("\n") for k, t in rows if k is not None}
    first = {}
    for k in sorted(lines):
        for n, line in enumerate(lines[k]):
            first.setdefault(line, (k, n))
    long = sorted((x for x in first if len(x) >= min_chars and x.strip(" ")), key=len)
    near = set()
    for i, a in enumerate(long):
        for b in long[i + 1:]:
            if len(b) - len(a) > edits:
                break
            if distance(a, b) <= edits:
                near.add(max(a, b, key=first.get))
    out = []
    for k, t in rows:
        here = (t or "").split("\n")
        gone = [] if k is None else [n for n, x in enumerate(here) if x.strip(" ") and (x in near or first[x] < (k, n))]
        kept = "\n".join(x for n, x in enumerate(here) if n not in gone)
        out.append((k, len(here), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("h")).collect()), key=str)


def test_distance_expression(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(400):
        a = "".join(r.choices("abé😀", k=r.randrange(0, 12)))
        b = list(a)
        for _ in range(r.randrange(0, 4)):
            at = r.randrange(len(b) + 1)
            b[at:at + r.randrange(2)] = r.choices("abé", k=r.randrange(2))
        pairs.append(tuple(sorted((a, "".join(b)), key=len)))
    pairs = [p for p in pairs if p[1]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", line_dedup.edit_distance_within(F.col("a"), F.col("b"), edits).alias("near")).collect()
        assert all(x["near"] == (distance(x["a"], x["b"]) <= edits) for x in got)


@pytest.mark.parametrize("crowd", [64, 2])
def test_odd_rows_equal_brute_force(spark, crowd):
    """Near lines, crowds of them, shared beginnings, repeated lines, blank and short ones; a small crowd forces splitting."""
    r = random.Random(4)
    base = ["".join(r.choices("abcdef ", k=r.randrange(18, 60))) + "x" for _ in range(25)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(r.randrange(1, 5)):
            line = list(r.choice(base))
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(line))
                line[at:at + r.randrange(2)] = r.choices("abcxyz", k=r.randrange(2))
            lines.append("".join(line) if r.random() < 0.8 else r.choice(["", " ", "short", f"Chapter {k}", f"This is page {k} of the long book"]))
        rows.append((k, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, base[0]), (None, base[0]), (102, "z" * 50_000), (-3, base[0] + "\n" + base[0]), (103, "é" * 30 + "\n" + "é" * 29)]
    df = spark.createDataFrame([(k, t, "i", 3) for k, t in rows], "doc_id long, text string, id string, place int")
    assert rows_of(line_dedup.dedup_lines(df, crowd=crowd)) == brute(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark):
    data = "/root/testdata/sf0.001"
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted((tuple(x) for x in entry.queries()["op4_line_dedup"](spark, data).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()), key=str)
    seen = {k: v for k, *v in got}
    want = {k: v for k, *v in brute_by_blocks(rows)}
    assert seen == want


def brute_by_blocks(rows):
    """As ``brute``, with the count of differing characters per length as a first bound, so that all pairs are affordable."""
    from collections import Counter

    lines = {k: (t or "").split("\n") for k, t in rows}
    first = {}
    for k in sorted(lines):
        for n, line in enumerate(lines[k]):
            first.setdefault(line, (k, n))
    long = sorted((x for x in first if len(x) >= 20 and x.strip(" ")), key=len)
    bags = [Counter(x) for x in long]
    near = set()
    for i, a in enumerate(long):
        for j in range(i + 1, len(long)):
            if len(long[j]) - len(a) > 2:
                break
            if sum((bags[j] - bags[i]).values()) <= 2 and distance(a, long[j]) <= 2:
                near.add(max(a, long[j], key=first.get))
    out = []
    for k, t in rows:
        here = (t or "").split("\n")
        gone = [n for n, x in enumerate(here) if x.strip(" ") and (x in near or first[x] < (k, n))]
        kept = "\n".join(x for n, x in enumerate(here) if n not in set(gone))
        out.append((k, len(here), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_clashing_names_stay(spark):
    rows = [(1, "a line of some length here\nshort", "x", 5, 7), (2, "a line of some length here\nother", "y", 6, 8), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, doc int, place int")
    got = line_dedup.without_repeated_lines(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == [rows[0], (2, "other", "y", 6, 8), rows[2]]


def test_a_family_of_near_lines_does_not_make_all_pairs(spark):
    r = random.Random(5)
    base = "".join(r.choices("abcdefgh", k=60))
    lines = [base] + [base[:at] + c + base[at + 1:] for at in range(0, 60, 2) for c in "XYZ"]
    texts = spark.createDataFrame([*enumerate(lines)], "id long, line string").withColumn("place", F.col("id").cast("decimal(38,0)"))
    met = line_dedup.met_segments(texts.select("id", "line"), 2)
    led = line_dedup.led_lines(met, texts, 2)
    settled = line_dedup.near_ids(led.select(F.col("lead").alias("a"), F.col("id").alias("b")), texts, 2)
    assert {x["id"] for x in settled.collect()} == set(range(1, len(lines)))
    assert line_dedup.open_pairs(led, texts, settled, 2, 1000).count() == 0
    none = settled.limit(0)
    assert line_dedup.open_pairs(led, texts, none, 2, 1000).count() > 20 * len(lines)


def test_families_whose_earliest_line_is_far_from_the_rest(spark):
    r = random.Random(6)
    rows = []
    for family in range(6):
        base = "".join(r.choices("abcé", k=r.randrange(20, 40)))
        for _ in range(25):
            line = list(base)
            for _ in range(r.randrange(0, 4)):
                at = r.randrange(len(line) + 1)
                line[at:at + r.randrange(2)] = r.choices("abé", k=r.randrange(2))
            rows.append("".join(line))
    r.shuffle(rows)
    docs = [(k, "\n".join(rows[k::30])) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(line_dedup.dedup_lines(df, crowd=3)) == brute(docs)


def test_lines_of_other_characters_make_no_pairs(spark):
    """Lines that share their first half and differ in the rest meet their earliest line, but not each other."""
    rng = random.Random(3)
    lines = ["the same first half of each of these lines, " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44)) for _ in range(60)]
    texts = spark.createDataFrame([*enumerate(lines)], "id long, line string").withColumn("place", F.col("id").cast("decimal(38,0)"))
    met = line_dedup.met_segments(texts.select("id", "line"), 2)
    led = line_dedup.led_lines(met, texts, 2)
    none = spark.createDataFrame([], "id long")
    assert led.count() >= len(lines) - 1
    assert line_dedup.open_pairs(led, texts, none, 2, 1000).count() < len(lines)


def test_counts_of_characters_never_rule_a_near_line_out(spark):
    rng, rows = random.Random(4), []
    for _ in range(300):
        a = [rng.choice("abcxyz é你\t/~") for _ in range(rng.randint(3, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(b))
            b[k:k + rng.randint(0, 1)] = rng.choices("abcqr0é~", k=rng.randint(0, 1))
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(~line_dedup.bags_within(line_dedup.bag("a"), line_dedup.bag("b"), 2)).count() == 0
