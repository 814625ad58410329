"""What the training-data operators share: reading tables, cutting lineage, local names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.session import BATCH_BYTES, BATCH_ROWS, fresh_path, small_batches  # noqa: F401  (operators take them from here)

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: no lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys fall in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def share_of(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return (F.pmod(F.xxhash64(key.cast("string"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30)))


SLICE_CHARS = 1_000_000


def slices(batch: pa.RecordBatch, text: pa.Array | None = None, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows of an Arrow batch in slices of about ``size`` bytes of the text (column 1 if not given), a row at least; whole texts always."""
    lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in (batch.column(1) if text is None else text)]
    ends = np.cumsum([0, *lengths])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def with_features(docs: DataFrame, text_col: str, names: tuple[str, ...], compute, keep: tuple[Column, ...] = ()) -> DataFrame:
    """``row`` (each input row whole, as a struct), the columns in ``keep``, and a list of numbers for each of ``names``.

    ``compute(text, row)`` gives the lists of one row, from its whole text (null: empty). Rows stay as they are, so names cannot clash
    and nothing is joined back.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keep)
    floats = pa.list_(pa.float64())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(0).field(at)):
                texts = part.column(0).field(at).to_pylist()
                kept = zip(*(c.to_pylist() for c in part.columns[1:])) if len(part.columns) > 1 else [()] * len(texts)
                lists = [compute("" if t is None else str(t), k) for t, k in zip(texts, kept)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[k] for x in lists], floats) for k in range(len(names)))],
                                                 [*part.schema.names, *names])

    return rows.mapInArrow(run, schema)
