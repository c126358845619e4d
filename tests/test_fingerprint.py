"""The fingerprint of a folder against plain hashing, for files read in many splits."""

import hashlib

import numpy as np
import pytest

from terrasift.plans.catalogue import QUERIES
from terrasift.sources import fingerprint

SPLIT, OPEN_COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _file(data):
    if len(data) <= fingerprint.WHOLE:
        return _sha(data)
    lines = data.split(b"\n")
    lines = [_sha(v) for v in (lines[:-1] if lines[-1] == b"" else lines)]
    runs = [_sha("".join(lines[i : i + fingerprint.RUN]).encode()) for i in range(0, len(lines), fingerprint.RUN)]
    return _sha(f"{len(data)}|{''.join(runs)}".encode())


def _folder(files):
    shards = {}
    for name in sorted(files, key=str.encode):
        shards.setdefault(_sha(name.encode())[:2], []).append(name + _file(files[name]))
    return _sha("|".join(_sha("|".join(shards[s]).encode()) for s in sorted(shards)).encode())


@pytest.fixture
def small_parts(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "WHOLE", 2000)
    monkeypatch.setattr(fingerprint, "RUN", 16)
    yield lambda size: [spark.conf.set(c, str(size)) for c in (SPLIT, OPEN_COST)]
    for c in (SPLIT, OPEN_COST):
        spark.conf.unset(c)


def test_files_in_splits(spark, tmp_path, small_parts):
    noise = np.random.default_rng(5).integers(0, 256, 12000, np.uint8).tobytes()
    files = {
        "a.parquet": noise, "b.parquet": noise[:9000] + b"\n", "c.parquet": noise[:9000] + b"\n\n", "whole.parquet": noise[:2000],
        "crlf.parquet": b"\r\n\xff\x00" * 2000, "ends.parquet": b"\n" * 3000, "one+long line.parquet": b"x" * 3000,
        "bom.parquet": b"\xef\xbb\xbfab\n" * 1000, "table%20.parquet/part 1.parquet": noise[:7000],
    }
    (tmp_path / "table%20.parquet").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "left_out.txt").write_bytes(noise)
    got = []
    for size in (2501, 7000):
        small_parts(size)
        for folder in (str(tmp_path), f"file://{tmp_path}/")[: 1 + (size == 7000)]:
            digests = {r.name: r.h for r in fingerprint.file_digests(spark, folder, "*.parquet").collect()}
            assert sorted(digests) == sorted(files)
            assert {n for n in files if digests[n] != _file(files[n])} <= {"bom.parquet"}
            got.append((digests["bom.parquet"], QUERIES["dataset_fingerprint"](spark, folder).first()[0]))
    assert len(set(got)) == 1


def test_every_byte_counts(spark, tmp_path, small_parts):
    small_parts(1500)
    data = bytearray(b"abc\n" * 2000)
    seen = set()
    for at, byte in ((0, 97), (0, 98), (3, 32), (4001, 10), (7999, 32)):
        changed = bytearray(data)
        changed[at] = byte
        (tmp_path / "t.parquet").write_bytes(changed)
        got = QUERIES["dataset_fingerprint"](spark, str(tmp_path)).first()[0]
        assert got == _folder({"t.parquet": bytes(changed)})
        seen.add(got)
    assert len(seen) == 5


def test_no_files(spark, tmp_path):
    assert QUERIES["dataset_fingerprint"](spark, str(tmp_path)).first()[0] == _sha(b"")
