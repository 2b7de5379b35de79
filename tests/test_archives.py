"""Archives by their directory: little is read to list, damage costs one row, entries of any size come in pieces."""

import io
import os
import random
import zipfile

from pyspark.sql import functions as F

from filelake.operators import archives as A
from filelake.operators import readers
from filelake.sources.files import list_files


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def packed(entries, method=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as z:
        for path, content in entries:
            z.writestr(path, content)
    return buffer.getvalue()


def test_listing_reads_a_small_share():
    data = packed([(f"d{k}/e.bin", os.urandom(100_000)) for k in range(50)])
    file = Counting(data)
    assert [e[1] for e in A.directory(file)] == [f"d{k}/e.bin" for k in range(50)] and file.taken < 0.02 * len(data)


def test_damage_costs_one_entry():
    rnd = random.Random(1)
    texts = [(f"{k}.txt", "".join(rnd.choice("abcdef \n") for _ in range(5000))) for k in range(20)]
    good = packed(texts)
    places = [e[2] for e in A.directory(io.BytesIO(good))]
    for k in (0, 7, 19):
        for at, want in ((places[k] + 60, 19), (places[k], 19)):  # in its data; its header
            bad = bytearray(good)
            bad[at] ^= 0xFF
            rows = [*A.unpacked(bytes(bad), 1 << 30)]
            assert len(rows) == 20 and sum(r[3] is not None for r in rows) == want and rows[k][1] == f"{k}.txt" and rows[k][4]
    (row,) = A.unpacked(good[:-10], 1 << 30)
    assert row[1] is None and row[4]


def test_pieces_of_large_entries(spark, tmp_path):
    big = b"0123456789abcdef" * 700_000  # 11 MB of a few packed bytes
    (tmp_path / "a.zip").write_bytes(packed([("big.txt", big), ("empty", b""), ("dir/", b"")]))
    (tmp_path / "b.zip").write_bytes(packed([("stored.bin", b"xyz" * 1000)], zipfile.ZIP_STORED))
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04 no archive")
    listed = A.list_archives(list_files(spark, f"file://{tmp_path}"))
    pieces = A.entry_pieces(listed, 1 << 20)
    sizes = {r.path: (r.n, r.most) for r in pieces.groupBy("path").agg(F.count("*").alias("n"), F.max(F.octet_length("data")).alias("most")).collect()}
    assert sizes == {"big.txt": (11, 1 << 20), "empty": (1, 0), "stored.bin": (1, 3000), None: (1, None)}
    got = {r.path: (r.content, r.error is None) for r in A.entry_contents(pieces).collect()}
    assert got["big.txt"] == (big, True) and got["empty"] == (b"", True) and got["stored.bin"] == (b"xyz" * 1000, True) and got[None] == (None, False)
    assert A.entry_contents(pieces, 5000).where("path = 'big.txt' and content is null and size = 11200000").count() == 1


def test_one_entry_too_large_for_a_row(spark):
    files = spark.createDataFrame([(1, packed([("a", b"x" * 100), ("b", b"y" * 10)])), (2, None), (3, b"")], "file_id long, content binary")
    got = sorted((r.file_id, r.path or "", r.content or b"", r.error is not None) for r in A.explode_archives(files, 50).collect())
    assert got == [(1, "a", b"", True), (1, "b", b"y" * 10, False), (2, "", b"", True), (3, "", b"", True)]


def test_copies_are_unpacked_once(spark):
    inner = packed([("x.txt", "one"), ("x.txt", "two"), ("y.txt", "three")])
    outer = packed([("a/in.zip", inner), ("b/in.zip", inner), ("c/other.bin", inner)])
    rows = [(k, f"{k}.zip", outer) for k in range(5)] + [(9, "n.zip", inner), (10, "null.zip", None)]
    files = spark.createDataFrame(rows, "file_id long, name string, content binary")
    lineage, contents = readers.nested_archives(files)
    # of 5 outer archives and 11 inner ones two contents are archives, with three texts
    assert sorted(len(r.content) for r in contents.collect()) == sorted([len(outer), len(inner), 3, 3, 5])
    depths = {r.depth: r["count"] for r in lineage.groupBy("depth").count().collect()}
    assert depths == {0: 7, 1: 5 * 3 + 3, 2: 5 * 2 * 3}
    assert lineage.select("file_id").distinct().count() == lineage.count()
    found = readers.expand_nested(files).where("depth = 2").groupBy(F.col("content").cast("string").alias("t")).count().collect()
    assert {r.t: r["count"] for r in found} == {"one": 10, "two": 10, "three": 10}
