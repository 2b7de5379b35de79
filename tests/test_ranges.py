"""Files read in byte ranges give what whole files give, wherever they are cut."""

import random

import pytest
from pyspark.sql import functions as F

from filelake.operators import views as V
from filelake.sources import ranges
from filelake.sources.files import read_files

PIECES = [b"abc", "é".encode(), "漢字".encode(), "😀".encode(), b"\x00", b"\xff", b"\xe2\x82", b"\n", b"\r", b"\r\n", b"word " * 5, "﻿".encode(), b"\x80"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, path = random.Random(2), tmp_path_factory.mktemp("files") / "a b"
    path.mkdir()
    contents = [b"", b"\n", b"\r", b"x", b"\r\n\r\n", b"\xef\xbb\xbfmarked\n", b"a" * 333, "é".encode() * 150, "aé漢😀".encode() * 40, b"ab\r" * 30]
    contents += [b"".join(rnd.choice(PIECES) for _ in range(rnd.randrange(120))) for _ in range(6)]
    for k, data in enumerate(contents):
        (path / f"{k}.txt").write_bytes(data)
    return str(path)


@pytest.mark.parametrize("step", [1, 2, 7, 16, 100, 1 << 20])
def test_any_cut(spark, folder, step):
    rows = lambda df: sorted(map(tuple, df.collect()))
    files, cut = read_files(spark, folder), ranges.list_ranges(spark, folder, step)
    texts = files.select("file_id", F.lit("utf-8").alias("encoding"), F.lit(False).alias("truncated"), "content")
    assert rows(ranges.range_lines(cut)) == rows(V.split_lines(V.decode_files(texts)))
    assert rows(ranges.range_hex(cut)) == rows(V.hex_dump(files))
    assert rows(ranges.range_strings(cut, 4, 16)) == rows(V.extract_strings(files, 4, 16))


@pytest.mark.parametrize("step", [1000, 4096, 5000, 70_000])
def test_long_runs_and_lines(spark, tmp_path, step):
    rnd = random.Random(step)
    (tmp_path / "one.txt").write_bytes("".join(rnd.choice("aé漢😀") for _ in range(60_000)).encode())
    (tmp_path / "two.txt").write_bytes(b"x" * 30_000 + b"\n" + b"y" * 4097 + b"\x00" + b"z" * 40_000)
    rows = lambda df: sorted(map(tuple, df.collect()))
    files, cut = read_files(spark, f"file://{tmp_path}"), ranges.list_ranges(spark, f"file://{tmp_path}", step)
    assert rows(ranges.range_strings(cut)) == rows(V.extract_strings(files))
    texts = files.select("file_id", F.lit("utf-8").alias("encoding"), F.lit(False).alias("truncated"), "content")
    assert rows(ranges.range_lines(cut)) == rows(V.split_lines(V.decode_files(texts)))


def test_source_of_ranges(spark, folder):
    whole = {r.file_id: bytes(r.content) for r in read_files(spark, folder).collect()}
    found = ranges.read_ranges(spark, folder, 50)
    assert found.rdd.getNumPartitions() == sum(-(-len(b) // 50) for b in whole.values())
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.file_id, r.offset)):
        assert r.offset == len(got.get(r.file_id, b"")) and r.size == len(whole[r.file_id])
        got[r.file_id] = got.get(r.file_id, b"") + bytes(r.data)
    assert got == whole


@pytest.mark.parametrize("step", [7, 50, 1 << 20])
def test_digests_of_files_by_ranges(spark, folder, step):
    import hashlib

    whole = {r.file_id: bytes(r.content) for r in read_files(spark, folder).collect()}
    shared = ranges.read_ranges(spark, folder, step, 120)
    assert shared.rdd.getNumPartitions() == sum(-(-len(b) // (max(120 // step, 1) * step)) for b in whole.values())
    found = sorted(map(tuple, ranges.file_digests(shared).collect()))
    assert found == sorted((k, -(-len(b) // step), len(b), hashlib.md5(b).hexdigest()) for k, b in whole.items() if b)


def test_digests_gather_no_file(spark, sf_dir):
    # a file as one value would be twice as long in hex, and strings end at 2 GB
    from filelake.plans import catalogue

    plan = catalogue.QUERIES["read_ranges"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
