import hashlib
import io
import os
import struct
import zipfile

import pytest

from plumbline.sources import archive_ranges as AR, archives as A


def pack(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_ranges_equal_the_whole_archive(spark, tmp_path, method):
    members = [("d/", b""), ("d/a.txt", b"a" * 50_000), ("empty", b""), ("r", os.urandom(30_000)), ("é", "é".encode() * 10)]
    content = pack(members, method)
    (tmp_path / "a b.zip").write_bytes(content)
    (tmp_path / "none.zip").write_bytes(pack([]))
    (tmp_path / "cut.zip").write_bytes(content[:60])
    paths = spark.createDataFrame([(f"file:{tmp_path}/{n}.zip".replace(" ", "%20") if n == "a b" else str(tmp_path / f"{n}.zip"), 1) for n in ("a b", "none", "cut", "absent")] + [(None, 2)], "path string, name int")
    listed = AR.archive_directories(paths)
    whole = spark.createDataFrame([(1, content)], "archive_id int, content binary")
    same = lambda df: sorted(map(tuple, df.select("name", "is_dir", "mode", "size").collect()))
    assert same(listed.where("problem IS NULL")) == same(A.scan_archive_members(whole))
    opened = AR.expand_members(listed, 7000)
    assert sorted(map(tuple, opened.select("name", "sha256").collect())) == sorted(map(tuple, A.expand_archive(whole).select("name", "sha256").collect()))
    found = sorted((r.rule, os.path.basename(r.entity_id)) for r in AR.check_archive_files(listed, opened).collect())
    assert found == [("broken_archive", "absent.zip"), ("broken_archive", "cut.zip"), ("empty_archive", "none.zip")]
    parts = {}
    for r in AR.member_pieces(listed, 7000, 1000).orderBy("name", "piece").collect():
        parts.setdefault(r.name, []).append((r.piece, bytes(r.content)))
    assert {n: b"".join(c for _, c in p) for n, p in parts.items()} == {n: d for n, d in members if n != "d/"}
    assert all([k for k, _ in p] == list(range(len(p))) for p in parts.values()) and len(parts["r"]) > 1


def test_broken_members_are_findings(spark, tmp_path):
    content = bytearray(pack([("good", b"g" * 500), ("bad", os.urandom(500)), ("sized", b"s" * 400)], zipfile.ZIP_STORED))
    at = content.find(b"bad") + 3
    content[at + 20] ^= 0xFF  # a flipped byte
    entry = content.rfind(b"sized") - 46
    struct.pack_into("<I", content, entry + 24, 399)  # another size in the directory
    (tmp_path / "x.zip").write_bytes(content)
    listed = AR.archive_directories(spark.createDataFrame([(str(tmp_path / "x.zip"),)], "path string"))
    opened = AR.expand_members(listed)
    got = {r.name: (r.sha256, r.problem) for r in opened.collect()}
    assert got == {"good": (hashlib.sha256(b"g" * 500).hexdigest(), None), "bad": (None, "broken_member"), "sized": (None, "broken_member")}
    assert {r.name for r in AR.member_pieces(listed).collect()} == {"good"}


def test_an_archive_is_many_groups(spark, tmp_path):
    data = os.urandom(1 << 20)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(64):
            z.writestr(f"m{k}", data)
    listed = AR.archive_directories(spark.createDataFrame([(str(tmp_path / "big.zip"),)], "path string"))
    groups = AR.member_groups(listed, 4 << 20)
    from pyspark.sql import functions as F

    sizes = groups.groupBy(F.spark_partition_id()).agg(F.sum("packed")).collect()
    assert len(sizes) > 2 and sum(r[1] for r in sizes) == 64 << 20
    assert {r.sha256 for r in AR.expand_members(listed, 4 << 20).collect()} == {hashlib.sha256(data).hexdigest()}
