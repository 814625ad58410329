"""ZIP archives of any size by byte ranges: directories first, then groups of members.

A directory is read from an archive's end, so no task ever holds an archive. Members are dealt out in groups of
neighbouring bytes; a task seeks to each of its members and unpacks it in pieces, so it never holds a whole member
either. Paths are URIs of any store that Arrow's file systems open.
"""

from __future__ import annotations

import bz2
import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from plumbline.sources.archives import BROKEN

GROUP_BYTES = 64 << 20
PIECE_BYTES = 8 << 20
# fixed values of the format: how members are packed, the flag of encryption, the local header's length and the place of its two lengths
STORED, DEFLATED, BZIPPED, LZMA = 0, 8, 12, 14
ENCRYPTED, HEADER, LENGTHS = 1, 30, 26

DIRECTORY = "path string, name string, is_dir boolean, mode int, size long, method int, flags int, crc long, start long, packed long, problem string"


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class _Range(io.RawIOBase):
    """A store's file for readers of the standard library, which expect OSError for a place before the start."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.tell(), io.SEEK_END: self.size}[whence]
        if at < 0:
            raise OSError("before the start")
        return self.file.seek(at)

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def open_range(path: str) -> io.BufferedReader:
    store, inner = store_of(path)
    return io.BufferedReader(_Range(store.open_input_file(inner)), 1 << 16)


def archive_directories(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """A row per member: ``path, name, is_dir, mode, size`` and where and how it is packed.

    An archive that does not open or holds nothing has one row with ``problem``. Names are those of the directory, NUL included. Repeated paths repeat their rows; null paths have none.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DIRECTORY.split(", ")]
        types = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
        kinds = [types[f.split()[1]] for f in DIRECTORY.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open_range(path) as file, zipfile.ZipFile(file) as archive:
                        rows = [(path, m.orig_filename, m.is_dir(), m.external_attr >> 16, m.file_size, m.compress_type, m.flag_bits, m.CRC, m.header_offset,
                                 m.compress_size, None) for m in archive.infolist()]
                except BROKEN:
                    rows = [(path, *[None] * 9, "broken_archive")]
                yield batch_of(rows or [(path, *[None] * 9, "empty_archive")])

    return archives.select(F.col(path_col).cast("string").alias("path")).where("path IS NOT NULL").mapInArrow(read, DIRECTORY)


def unpacked(file: io.BufferedReader, start: int, packed: int, method: int, flags: int, size: int, crc: int,
             piece_bytes: int = PIECE_BYTES) -> Iterator[bytes]:
    """The bytes of one member in pieces; raises one of ``BROKEN`` if they are not what the directory says."""
    if flags & ENCRYPTED:
        raise RuntimeError("encrypted")
    unpack = {STORED: None, DEFLATED: lambda: zlib.decompressobj(-zlib.MAX_WBITS), BZIPPED: bz2.BZ2Decompressor, LZMA: zipfile.LZMADecompressor}
    if method not in unpack:
        raise NotImplementedError(f"method {method}")
    state = unpack[method]() if unpack[method] else None
    file.seek(start)
    header = file.read(HEADER)
    if len(header) < HEADER or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no local header")
    file.seek(start + HEADER + sum(struct.unpack_from("<HH", header, LENGTHS)))
    got, check, left = 0, 0, packed
    while left > 0:
        raw = file.read(min(left, piece_bytes))
        if not raw:
            raise EOFError("cut off")
        left -= len(raw)
        for piece in _pieces(state, method, raw, piece_bytes):
            got += len(piece)
            if got > size:
                raise zipfile.BadZipFile("longer than said")
            check = zlib.crc32(piece, check)
            yield piece
    if method == DEFLATED and (rest := state.flush()):
        got, check = got + len(rest), zlib.crc32(rest, check)
        yield rest
    if got != size or check != crc:
        raise zipfile.BadZipFile("size or checksum")


def _pieces(state, method: int, raw: bytes, piece_bytes: int) -> Iterator[bytes]:
    if state is None:
        yield raw
    elif method == DEFLATED:
        while raw:
            piece = state.decompress(raw, piece_bytes)
            raw = state.unconsumed_tail
            if piece:
                yield piece
    else:
        yield state.decompress(raw)


def member_groups(members: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Members dealt out by archive and stretch of ``group_bytes``, in the order of their bytes; no directories, no problems.

    Rows say nothing of the bytes behind them, so the number of partitions is set from the sum of those: one for each ``group_bytes``.
    """
    files = members.where("problem IS NULL AND NOT is_dir")
    packed = files.agg(F.sum("packed")).first()[0] or 0
    return (files.withColumn("__group", F.floor(F.col("start") / group_bytes))
            .repartition(1 + packed // group_bytes, "path", "__group").sortWithinPartitions("path", "start").drop("__group"))


def expand_members(members: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``path, name, size, sha256, problem`` of every file; ``problem`` is ``broken_member`` where it does not unpack, and null hashes go with it."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file, member in _members(batches):
            digest, problem = hashlib.sha256(), None
            try:
                if file is None:
                    raise OSError(path)
                for piece in unpacked(file, *member[1:]):
                    digest.update(piece)
            except BROKEN:
                problem = "broken_member"
            yield pa.RecordBatch.from_pydict({"path": [path], "name": [member[0]], "size": pa.array([member[5]], pa.int64()),
                                              "sha256": pa.array([None if problem else digest.hexdigest()], pa.string()), "problem": pa.array([problem], pa.string())})

    return member_groups(members, group_bytes).select(*PLACE).mapInArrow(read, "path string, name string, size long, sha256 string, problem string")


def member_pieces(members: DataFrame, group_bytes: int = GROUP_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path, name, piece, content`` of every file that unpacks whole, in pieces of about ``piece_bytes``; an empty file has one empty piece.

    A member is read twice, first to see that it is sound, so that no piece of a broken one comes out.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, file, member in _members(batches):
            try:
                if file is None:
                    raise OSError(path)
                for _ in unpacked(file, *member[1:], piece_bytes):
                    pass
            except BROKEN:
                continue
            k = -1
            for k, piece in enumerate(unpacked(file, *member[1:], piece_bytes)):
                yield pa.RecordBatch.from_pydict({"path": [path], "name": [member[0]], "piece": pa.array([k], pa.int64()), "content": pa.array([piece], pa.binary())})
            if k < 0:
                yield pa.RecordBatch.from_pydict({"path": [path], "name": [member[0]], "piece": pa.array([0], pa.int64()), "content": pa.array([b""], pa.binary())})

    return member_groups(members, group_bytes).select(*PLACE).mapInArrow(read, "path string, name string, piece long, content binary")


PLACE = ("path", "name", "start", "packed", "method", "flags", "size", "crc")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedReader | None, tuple]]:
    """The members of a task, with their archive open; None where it does not open."""
    current, file = None, None
    try:
        for batch in batches:
            for path, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if path != current:
                    if file is not None:
                        file.close()
                    current, file = path, None
                    try:
                        file = open_range(path)
                    except BROKEN:
                        pass
                yield path, file, tuple(member)
    finally:
        if file is not None:
            file.close()


def check_archive_files(members: DataFrame, expanded: DataFrame) -> DataFrame:
    """Findings of :func:`archive_directories` and :func:`expand_members`: archives that do not open or are empty, members that do not unpack."""
    whole = members.where("problem IS NOT NULL").select(F.col("problem").alias("rule"), F.col("path").alias("entity_id"), F.lit(None).cast("string").alias("detail"))
    return whole.unionByName(expanded.where("problem IS NOT NULL").select(F.col("problem").alias("rule"), F.col("path").alias("entity_id"), F.col("name").alias("detail")))
