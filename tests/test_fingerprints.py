"""Hashes of files that are read in parts, against hashlib."""

import gzip
import hashlib
import random

import pytest

from fleetlens.session import materialize
from fleetlens.sources import readers

BOM = b"\xef\xbb\xbf"
FILES = {
    "a.bin": random.Random(1).randbytes(400_000), "sub/b.bin": b"\n" * 5, "c.txt": BOM + b"abc\ndef", "d.txt": BOM + b"abc\r\ndef\n", "f.csv.gz": gzip.compress(b"hello\n" * 100),
    "g.txt": b"x", "h.bin": b"\0" * 100_000 + b"\n", "i b%20.txt": b"\r\n\r" * 1000, "j.txt": BOM, "k.txt": b"\n", "l.txt": BOM + b"\n", "m.bin": BOM + random.Random(2).randbytes(90_000),
}


@pytest.fixture
def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


@pytest.fixture
def no_large_values(spark):
    """A file must not become one value: on real data it is larger than an executor's memory."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    for key in ("sources.binaryFile.maxLength", "files.maxPartitionBytes", "files.openCostInBytes"):
        spark.conf.unset(f"spark.sql.{key}")


def test_files_of_any_size_and_content(spark, folder, no_large_values):
    got = {r.path.split(f"{folder.name}/")[1]: (r.file_name, r.size_bytes, r.sha256) for r in readers.fingerprints(spark, f"file://{folder}").collect()}
    assert got == {n: (n.split("/")[-1], len(c), hashlib.sha256(c).hexdigest()) for n, c in FILES.items()}


def test_one_part_per_file(spark, folder):
    got = {r.file_name: r.sha256 for r in readers.fingerprints(spark, f"file://{folder}", "*.bin").collect()}
    assert got == {n.split("/")[-1]: hashlib.sha256(c).hexdigest() for n, c in FILES.items() if n.endswith(".bin")}


def test_a_changed_byte_of_a_large_file_is_found(spark, folder, no_large_values):
    before = materialize(readers.fingerprints(spark, f"file://{folder}"), "fingerprints")
    assert readers.unchanged(before, readers.fingerprints(spark, f"file://{folder}")).isEmpty()
    content = FILES["a.bin"]
    (folder / "a.bin").write_bytes(content[:200_000] + bytes([content[200_000] ^ 1]) + content[200_001:])
    (folder / "m.bin").write_bytes(FILES["m.bin"] + b"\n")
    changed = readers.unchanged(before, readers.fingerprints(spark, f"file://{folder}")).collect()
    assert sorted(r.path.split("/")[-1] for r in changed) == ["a.bin", "m.bin"]
