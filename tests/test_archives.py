"""Archives and arrays read by many tasks, on made files."""

import gzip
import io
import random
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import archives, binary


def members(n):
    return {f"d{i % 5}/m{i:04d}.{'wav' if i % 3 else 'txt'}": random.Random(i).randbytes(i * 37 % 5000) for i in range(n)}


def as_zip(path, files, kind=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", kind) as z:
        z.mkdir("empty")
        for name, raw in files.items():
            z.writestr(name, raw)


def as_tar(path, files, mode):
    with tarfile.open(path, mode) as t:
        for name, raw in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "d0/m0000.txt"
        t.addfile(link)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("archives")
    files = members(200)
    (root / "sub").mkdir()
    as_zip(root / "a.zip", files)
    as_zip(root / "sub" / "b.zip", files, zipfile.ZIP_STORED)
    as_tar(root / "c.tar", files, "w")
    as_tar(root / "d.tar.gz", files, "w:gz")
    return root, files


def test_contents_of_all_formats_are_read_by_many_tasks(spark, tree):
    root, files = tree
    rows = archives.member_contents(archives.archive_index(spark, str(root)), split_bytes=50_000).withColumn("task", F.spark_partition_id()).collect()
    for name in ("a.zip", "b.zip", "c.tar", "d.tar.gz"):
        own = [r for r in rows if r.path.endswith("/" + name)]
        assert {r.member: bytes(r.content) for r in own} == files
        assert {r.error for r in own} == {None}
        tasks = len({r.task for r in own})
        assert tasks == 1 if name == "d.tar.gz" else tasks > 1


def test_index_reads_no_contents_and_may_be_filtered(spark, tree):
    root, files = tree
    index = archives.archive_index(spark, f"file://{root}", (".zip",))
    assert {r.path.rpartition("/")[2] for r in index.select("path").distinct().collect()} == {"a.zip", "b.zip"}
    some = archives.member_contents(index.where("member like 'd1/%' and path like '%a.zip'")).collect()
    assert {r.member for r in some} == {m for m in files if m.startswith("d1/")}
    summary = {r.path.rpartition("/")[2]: (r.members, r.audio_members, r.error) for r in binary.archive_summary(binary.archive_members(spark, str(root))).collect()}
    audio = sum(m.endswith(".wav") for m in files)
    assert summary == {n: (200, audio, None) for n in ("a.zip", "b.zip", "c.tar", "d.tar.gz")}


def test_faults_are_rows_and_the_rest_is_read(spark, tmp_path):
    files = {f"m{i}": bytes(range(256)) * 8 for i in range(6)}
    as_zip(tmp_path / "z.zip", files, zipfile.ZIP_STORED)
    raw = bytearray((tmp_path / "z.zip").read_bytes())
    at = raw.index(b"m3" + bytes(range(256)))
    raw[at + 300] ^= 255
    (tmp_path / "z.zip").write_bytes(raw)
    as_zip(tmp_path / "bz.zip", {"x": b"abc"}, zipfile.ZIP_BZIP2)
    (tmp_path / "no.zip").write_bytes(b"not a zip file")
    as_tar(tmp_path / "t.tar", files, "w")
    (tmp_path / "t.tar").write_bytes((tmp_path / "t.tar").read_bytes()[:8000])
    as_tar(tmp_path / "g.tgz", files, "w:gz")
    (tmp_path / "g.tgz").write_bytes(gzip.compress(gzip.decompress((tmp_path / "g.tgz").read_bytes())[:8000]))
    as_zip(tmp_path / "empty.zip", {})
    rows = {(r.path.rpartition("/")[2], r.member): (r.content and bytes(r.content), r.error) for r in archives.member_contents(archives.archive_index(spark, str(tmp_path))).collect()}
    for m, content in files.items():
        found, error = rows["z.zip", m]
        assert (found, error) == (content, None) if m != "m3" else found is None and "checksum" in error
    assert "compression 12" in rows["bz.zip", "x"][1]
    assert rows["no.zip", None][1]
    for name in ("t.tar", "g.tgz"):
        assert rows[name, "m0"] == (files["m0"], None)
        assert any(error for (n, _), (_, error) in rows.items() if n == name)
    assert not any(n == "empty.zip" for n, _ in rows)


def test_members_of_one_name_and_long_names(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for raw in (b"first", b"second"):
            info = tarfile.TarInfo("x" * 300)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    rows = archives.member_contents(archives.archive_index(spark, str(tmp_path))).collect()
    assert sorted(bytes(r.content) for r in rows) == [b"first", b"second"]
    assert {r.member for r in rows} == {"x" * 300}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_arrays_in_row_ranges(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    arrays = {"emb": rng.normal(size=(300, 7)).astype(np.float32), "cube": rng.integers(0, 9, (40, 2, 3)), "ids": np.array([f"ü{i}" for i in range(50)]), "raw": np.array([b"ab", b"c"]), "flag": np.array([True, False]), "one": np.float64(2.5), "none": np.zeros((0, 4)), "columns": np.asfortranarray(rng.normal(size=(30, 3)))}
    save(tmp_path / "s.npz", **arrays)
    rows = archives.array_rows(archives.array_index(spark, str(tmp_path)), split_bytes=1000).withColumn("task", F.spark_partition_id()).collect()
    assert {r.error for r in rows} == {None}
    for name, a in arrays.items():
        own = sorted((r for r in rows if r.array == name), key=lambda r: r.row)
        a = np.atleast_1d(a)
        assert [r.row for r in own] == list(range(len(a)))
        if a.dtype.kind in "US":
            assert [r.text for r in own] == a.astype(str).tolist()
        else:
            assert [r["values"] for r in own] == a.reshape(len(a), int(np.prod(a.shape[1:]))).astype(float).tolist()
    if save is np.savez:
        assert len({r.task for r in rows if r.array == "emb"}) > 1


def test_array_faults(spark, tmp_path):
    np.savez(tmp_path / "p.npz", bad=np.array([{"a": 1}], dtype=object), good=np.arange(3))
    (tmp_path / "q.npz").write_bytes(b"PK")
    with zipfile.ZipFile(tmp_path / "r.npz", "w") as z:
        z.writestr("x.npy", b"nothing")
    rows = archives.array_rows(archives.array_index(spark, str(tmp_path))).collect()
    errors = {(r.path.rpartition("/")[2], r.array): r.error for r in rows if r.error}
    assert set(errors) == {("p.npz", "bad"), ("q.npz", None), ("r.npz", "x")}
    assert "pickled" in errors["p.npz", "bad"]
    assert [r["values"] for r in sorted((r for r in rows if r.array == "good"), key=lambda r: r.row)] == [[0.0], [1.0], [2.0]]


def test_no_archives(spark, tmp_path):
    assert archives.archive_index(spark, str(tmp_path)).collect() == []
    assert archives.member_contents(archives.archive_index(spark, str(tmp_path))).collect() == []
    assert archives.array_rows(archives.array_index(spark, str(tmp_path))).collect() == []
