"""Archives and array files as tables of members and rows that many tasks read.

Reading goes in two steps. ``spark.read.format("archive_index")`` and ``"array_index"`` are
Python data sources with one partition per file: a task reads the central directory of a
zip file, or walks the headers of a tar file, or the headers of the arrays in an array
archive, and returns one row per member or array with its place in the file; contents are not
read. ``member_contents`` and ``array_rows`` deal these places out by ranges of about
``SPLIT_BYTES`` of the file, so that a large archive is read by many tasks, each by
seeking to its own members or rows. A task holds one member, or one chunk of rows, at a time.

What cannot be sought is read in order by one task per file (gzipped tars) or per array
(compressed ones), in the same bounded pieces. Files are opened through ``pyarrow.fs``, so
they may lie in any store that it knows; Spark lists them.

A file or member that cannot be read is a row with its error, and the others of the file are
still read. Empty archives have no rows. Pickled arrays and encrypted members are refused
with an error. Members of one name are all returned, each with its own place.
"""

from __future__ import annotations

import ast
import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of an archive that a task reads, and bytes that are read or returned at once.
SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 8 << 20

MEMBER = "path string, member string, offset long, packed long, size long, crc long, kind string, error string"
ARRAY = "path string, array string, offset long, dtype string, shape array<long>, by_columns boolean, stored boolean, packed long, error string"
ROWS = "path string, array string, row long, text string, values array<double>, error string"
CONTENT = "path string, member string, offset long, size long, content binary, error string"
FAILURES = (OSError, ValueError, EOFError, KeyError, NotImplementedError, RuntimeError, MemoryError, struct.error, zlib.error, tarfile.TarError, zipfile.BadZipFile)


def open_file(path: str):
    """A file of any store that pyarrow knows, opened for seeking."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    store, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def listed(root: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Paths and sizes of the files under ``root``, whose contents are not read."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    store, inner = pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root)
    scheme = root.partition("://")[0] + "://" if "://" in root else ""
    found = store.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
    return sorted((scheme + i.path, i.size) for i in found if i.is_file and i.path.lower().endswith(suffixes))


def zip_members(f) -> Iterator[tuple]:
    """member, offset of its local header, packed and full size, checksum, kind, error."""
    with zipfile.ZipFile(f) as z:
        for m in z.infolist():
            if not m.is_dir():
                kind = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflated"}.get(m.compress_type)
                wrong = "encrypted" if m.flag_bits & 1 else None if kind else f"compression {m.compress_type} is not known"
                yield m.filename, m.header_offset, m.compress_size, m.file_size, m.CRC, kind or "other", wrong


def tar_members(f, gzipped: bool) -> Iterator[tuple]:
    """As ``zip_members``; a gzipped file's places are those of its unzipped contents."""
    whole = gzip.GzipFile(fileobj=f) if gzipped else f
    with tarfile.open(fileobj=whole, mode="r:") as t:
        while (m := t.next()) is not None:
            t.members = []  # else every header would be kept
            if m.isfile():
                yield m.name, m.offset_data, m.size, m.size, None, "stream" if gzipped else "plain", None
        # a damaged header reads like the end
        whole.seek(t.offset)
        if (last := whole.read(tarfile.BLOCKSIZE)) and last != tarfile.NUL * tarfile.BLOCKSIZE:
            raise tarfile.ReadError("no header and no end behind a member")


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _IndexReader(DataSourceReader):
    """Deals the files under the path to partitions of about SPLIT_BYTES, a larger file to one of its own."""

    def __init__(self, options, suffixes: str, of_file):
        self.root, self.of_file = options["path"], of_file
        self.suffixes = tuple(options.get("suffixes", suffixes).split(","))

    def partitions(self):
        out: list[list[str]] = [[]]
        full = 0
        for path, size in listed(self.root, self.suffixes):
            if out[-1] and full + size > SPLIT_BYTES:
                out.append([])
                full = 0
            out[-1].append(path)
            full += size
        return [_Paths(p) for p in out]

    def read(self, partition):
        for path in partition.paths:
            yield from self.of_file(path)


def _members_of(path: str) -> Iterator[tuple]:
    try:
        with open_file(path) as f:
            name = path.lower()
            members = zip_members(f) if name.endswith((".zip", ".npz")) else tar_members(f, name.endswith((".gz", ".tgz")))
            for m in members:
                yield (path, *m)
    except FAILURES as e:  # what came before the fault is kept
        yield path, None, None, None, None, None, None, said(e)


class ArchiveIndex(DataSource):
    """Members of the zip and tar files under a path, with their places."""

    @classmethod
    def name(cls) -> str:
        return "archive_index"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema):
        return _IndexReader(self.options, ".zip,.tar,.tar.gz,.tgz", _members_of)


def data_start(f, offset: int) -> int:
    """Where the data of a zip member begins: behind its local header."""
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the directory has one")
    name, extra = struct.unpack("<HH", head[26:30])
    return offset + 30 + name + extra


def inflated(f, start: int, packed: int, deflated: bool) -> Iterator[bytes]:
    """The bytes of a zip member, in pieces."""
    f.seek(start)
    unpack = zlib.decompressobj(-15) if deflated else None
    while packed:
        raw = f.read(min(packed, CHUNK_BYTES))
        if not raw:
            raise EOFError("the file ends within a member")
        packed -= len(raw)
        while unpack and raw:
            yield unpack.decompress(raw, CHUNK_BYTES)
            raw = unpack.unconsumed_tail
        if not unpack:
            yield raw
    if unpack:
        yield unpack.flush()


class _Pieces(io.RawIOBase):
    """A file over an iterator of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, b""

    def read(self, n: int = -1) -> bytes:
        out, have = [], 0
        while have < n:
            if not self.left:
                self.left = next((p for p in self.pieces if p), b"")
                if not self.left:
                    break
            take, self.left = self.left[: n - have], self.left[n - have :]
            out.append(take)
            have += len(take)
        return b"".join(out)


def array_header(f) -> tuple[int, str, tuple[int, ...], bool]:
    """Bytes, type, shape and order of the header that an array file begins with."""
    magic = f.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    width = 2 if magic[6] == 1 else 4
    (size,) = struct.unpack("<H" if width == 2 else "<I", f.read(width))
    fields = ast.literal_eval(f.read(size).decode("latin-1" if magic[6] < 3 else "utf-8"))
    if not isinstance(fields["descr"], str):
        raise ValueError("arrays of records are not read")
    if np.dtype(fields["descr"]).hasobject:
        raise ValueError("pickled arrays are refused")
    return 8 + width + size, fields["descr"], tuple(fields["shape"]), bool(fields["fortran_order"])


def _arrays_of(path: str) -> Iterator[tuple]:
    try:
        with open_file(path) as f:
            for member, offset, packed, _, crc, kind, wrong in list(zip_members(f)):
                name = member.removesuffix(".npy")
                try:
                    if wrong:
                        raise ValueError(wrong)
                    start = data_start(f, offset)
                    size, dtype, shape, by_columns = array_header(_Pieces(inflated(f, start, packed, kind == "deflated")))
                    yield path, name, start + size if kind == "stored" else start, dtype, list(shape), by_columns and len(shape) > 1, kind == "stored", packed, None
                except FAILURES as e:
                    yield path, name, None, None, None, None, None, None, said(e)
    except FAILURES as e:
        yield path, None, None, None, None, None, None, None, said(e)


class ArrayIndex(DataSource):
    """Arrays of the array archives under a path, with types, shapes and places."""

    @classmethod
    def name(cls) -> str:
        return "array_index"

    def schema(self) -> str:
        return ARRAY

    def reader(self, schema):
        return _IndexReader(self.options, ".npz", _arrays_of)


def _index(spark: SparkSession, source: type[DataSource], root: str, suffixes: tuple[str, ...] | None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    return (reader.option("suffixes", ",".join(suffixes)) if suffixes else reader).load(root)


def archive_index(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """MEMBER rows of the archives under ``root``."""
    return _index(spark, ArchiveIndex, root, suffixes)


def array_index(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """ARRAY rows of the array archives under ``root``."""
    return _index(spark, ArrayIndex, root, suffixes)


def _dealt(places: DataFrame, parts: int, *key: str) -> DataFrame:
    """Places of one key in one of ``parts`` tasks, in the order of the file."""
    return places.repartition(parts, *key).sortWithinPartitions(*key, "offset")


class _Files:
    """The file that a task reads at present; the next path closes it."""

    def __init__(self):
        self.path, self.file, self.stream = None, None, None

    def of(self, path: str):
        if path != self.path:
            self.close()
            self.path, self.file = path, open_file(path)
        return self.file

    def unzipped(self, path: str, offset: int):
        """The gzipped file's contents from ``offset``; reading goes on where it was left, or begins anew."""
        f = self.of(path)
        if self.stream is None or self.stream.tell() > offset:
            f.seek(0)
            self.stream = gzip.GzipFile(fileobj=f)
        self.stream.seek(offset)
        return self.stream

    def close(self):
        if self.file is not None:
            self.file.close()
        self.path = self.file = self.stream = None


def _content(files: _Files, m: dict) -> bytes:
    if m["kind"] == "stream":
        out = files.unzipped(m["path"], m["offset"]).read(m["size"])
    elif m["kind"] == "plain":
        f = files.of(m["path"])
        f.seek(m["offset"])
        out = f.read(m["size"])
    else:
        f = files.of(m["path"])
        out = b"".join(inflated(f, data_start(f, m["offset"]), m["packed"], m["kind"] == "deflated"))
        if zlib.crc32(out) != m["crc"]:
            raise ValueError("the checksum differs from the directory's")
    if len(out) != m["size"]:
        raise EOFError("the file ends within a member")
    return out


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
    files, rows, held = _Files(), [], 0
    for batch in batches:
        for m in batch.to_pylist():
            content, wrong = None, m["error"]
            if wrong is None:
                try:
                    content = _content(files, m)
                except FAILURES as e:
                    wrong = said(e)
                    files.close()
            rows.append({"path": m["path"], "member": m["member"], "offset": m["offset"], "size": m["size"], "content": content, "error": wrong})
            held += len(content or b"")
            if held >= CHUNK_BYTES or len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
    files.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def member_contents(index: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """CONTENT rows of the members in ``index``, which may be filtered first; ranges of ``split_bytes`` of a file are tasks of their own."""
    # the ranges are counted, not the rows: a task for each, whatever the members' number
    part: Column = F.when(F.col("kind") == "stream", F.lit(0)).otherwise(F.floor(F.coalesce("offset", F.lit(0)) / split_bytes)).alias("part")
    places = index.select("*", part)
    parts = places.select("path", "part").distinct().count()
    return _dealt(places, max(1, parts), "path", "part").drop("part").mapInArrow(_read_members, CONTENT)


def _row_bytes(dtype: str, shape: list[int]) -> int:
    return int(np.dtype(dtype).itemsize * np.prod(shape[1:], dtype=np.int64))


def _as_rows(a: np.ndarray, path: str, name: str, first: int) -> pa.RecordBatch:
    n = len(a)
    text = a.dtype.kind in "US"
    flat = a.reshape(n, -1)
    if a.dtype.kind == "S":
        flat = np.char.decode(flat, "utf-8")
    strings = pa.array([str(x) for x in flat[:, 0]], pa.string()) if text else pa.nulls(n, pa.string())
    width = flat.shape[1]
    values = pa.nulls(n, pa.list_(pa.float64())) if text else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(flat.astype(np.float64).ravel()))
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(np.arange(first, first + n)), strings, values, pa.nulls(n, pa.string())], ROW_NAMES)


ROW_NAMES = ["path", "array", "row", "text", "values", "error"]


def _read_array(files: _Files, m: dict) -> Iterator[pa.RecordBatch]:
    dtype, shape = np.dtype(m["dtype"]), m["shape"] or [1]
    f, width = files.of(m["path"]), _row_bytes(m["dtype"], shape)
    first, many = m["first"], m["many"]
    if m["stored"]:
        f.seek(m["offset"] + first * width)
        source = f
    else:
        source = _Pieces(inflated(f, m["offset"], m["packed"], True))
        array_header(source)
    if m["by_columns"]:  # rows lie apart: the array is read whole
        a = np.frombuffer(_exactly(source, shape[0] * width), dtype=dtype).reshape(shape, order="F")
        yield from (_as_rows(a[k : k + 4096], m["path"], m["array"], k) for k in range(0, shape[0], 4096))
        return
    step = max(1, CHUNK_BYTES // max(1, width))
    for k in range(first, first + many, step):
        n = min(step, first + many - k)
        yield _as_rows(np.frombuffer(_exactly(source, n * width), dtype=dtype).reshape(n, *shape[1:]), m["path"], m["array"], k)


def _exactly(source, size: int) -> bytes:
    raw = source.read(size)
    if len(raw) < size:
        raise EOFError("the file ends within an array")
    return raw


def _read_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = _Files()
    for batch in batches:
        for m in batch.to_pylist():
            wrong = m["error"]
            if wrong is None:
                try:
                    yield from _read_array(files, m)
                except FAILURES as e:
                    wrong = said(e)
                    files.close()
            if wrong is not None:
                yield pa.RecordBatch.from_arrays([pa.array([m["path"]]), pa.array([m["array"]], pa.string()), pa.array([m.get("first")], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.float64())), pa.array([wrong])], ROW_NAMES)
    files.close()


def array_rows(index: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ROWS rows of the arrays in ``index``, which may be filtered first: numbers as values, text as text.

    Ranges of about ``split_bytes`` of a stored array are tasks of their own; an error row names
    the first row of the range that could not be read.
    """
    rows = F.coalesce(F.try_element_at("shape", F.lit(1)), F.lit(1))
    inner = F.aggregate(F.slice(F.coalesce("shape", F.array(F.lit(1).cast("long"))), 2, 2**31 - 1), F.lit(1).cast("long"), lambda n, x: n * x)
    width = F.greatest(F.lit(1), inner * F.coalesce(F.regexp_extract("dtype", "([0-9]+)$", 1).try_cast("long"), F.lit(8)) * F.when(F.col("dtype").contains("U"), 4).otherwise(1))
    whole = F.col("error").isNotNull() | ~F.coalesce("stored", F.lit(False)) | F.coalesce("by_columns", F.lit(False))
    step = F.when(whole, F.greatest(F.lit(1), rows)).otherwise(F.greatest(F.lit(1), F.floor(split_bytes / width)))
    places = index.withColumn("step", step.cast("long")).withColumn("rows", rows)
    places = places.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("rows") - 1), F.col("step"))).alias("first"))
    places = places.withColumn("many", F.least("step", F.col("rows") - F.col("first")))
    parts = places.count()
    return _dealt(places, max(1, min(parts, 1 << 14)), "path", "array", "first").drop("step", "rows").mapInArrow(_read_arrays, ROWS)
