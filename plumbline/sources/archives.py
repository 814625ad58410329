"""ZIP archives: member listing and per-member content with hashes."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.session import BATCH_BYTES, BATCH_ROWS, small_batches

BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, NotImplementedError, OSError, RuntimeError, ValueError, zlib.error)


def scan_archive_members(archives: DataFrame, key: str = "archive_id") -> DataFrame:
    """Members of ZIP bytes: ``name, is_dir, mode, size``.  Only the directory is read.

    Archives that do not open or are empty have no rows here; :func:`check_archives` names them.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    with zipfile.ZipFile(io.BytesIO(r.content)) as archive:
                        listed = archive.infolist()
                except BROKEN:
                    continue
                yield pd.DataFrame(
                    [(getattr(r, key), m.orig_filename, m.is_dir(), m.external_attr >> 16, m.file_size) for m in listed],
                    columns=[key, "name", "is_dir", "mode", "size"])

    small_batches(archives.sparkSession)
    kind = archives.schema[key].dataType.simpleString()
    return archives.select(key, "content").mapInPandas(rows, f"{key} {kind}, name string, is_dir boolean, mode int, size long")


def expand_archive(archives: DataFrame, key: str = "archive_id") -> DataFrame:
    """File members with their bytes and SHA-256, handed on in batches of about ``BATCH_BYTES``.

    Names are those of the listing, NUL included.  Members that do not unpack have no row; :func:`check_archives` names them.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                for m, data, problem in _members(r.content):
                    if problem is None and not m.is_dir():
                        held.append((getattr(r, key), m.orig_filename, data))
                        size += len(data)
                        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                            yield pd.DataFrame(held, columns=[key, "name", "content"])
                            held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=[key, "name", "content"])

    small_batches(archives.sparkSession)
    kind = archives.schema[key].dataType.simpleString()
    out = archives.select(key, "content").mapInPandas(rows, f"{key} {kind}, name string, content binary")
    return out.withColumn("sha256", F.sha2("content", 256))


def _members(content: bytes) -> Iterator[tuple[zipfile.ZipInfo | None, bytes | None, str | None]]:
    """Members with their bytes, or with what is wrong with them or the archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            if not archive.infolist():
                yield None, None, "empty_archive"
            for m in archive.infolist():
                try:
                    yield m, b"" if m.is_dir() else archive.read(m), None
                except BROKEN:
                    yield m, None, "broken_member"
    except BROKEN:
        yield None, None, "broken_archive"


def check_archives(archives: DataFrame, key: str = "archive_id") -> DataFrame:
    """Findings: archives that do not open, hold nothing, or have members that do not unpack."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                bad = [(problem, str(getattr(r, key)), m.orig_filename if m else None) for m, _, problem in _members(r.content) if problem]
                yield pd.DataFrame(bad, columns=["rule", "entity_id", "detail"])

    small_batches(archives.sparkSession)
    return archives.select(key, "content").mapInPandas(rows, "rule string, entity_id string, detail string")


def archive_manifest(members: DataFrame, key: str = "archive_id") -> DataFrame:
    """Files with hashes and every directory they imply, as ``path, is_dir, sha256``. Members are read once; repeated files keep their rows."""
    parts = F.split("name", "/")
    row = lambda path, is_dir, sha256: F.struct(path.alias("path"), F.lit(is_dir).alias("is_dir"), sha256.alias("sha256"))
    ends = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    folders = F.transform(ends, lambda i: row(F.array_join(F.slice(parts, 1, i), "/"), True, F.lit(None).cast("string")))
    rows = members.select(key, F.explode(F.concat(F.array(row(F.col("name"), False, F.col("sha256"))), folders)).alias("row"))
    counted = rows.groupBy(key, "row").agg(F.count("*").cast("int").alias("n"))
    times = F.when(F.col("row.is_dir"), 1).otherwise(F.col("n"))
    return counted.select(key, "row", F.explode(F.sequence(F.lit(1), times))).select(key, "row.*")
