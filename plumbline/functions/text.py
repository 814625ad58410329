"""Text forms: capture ids, numbers to fifteen digits, canonical JSON."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F, types

# fixed values: characters that JSON escapes by letter
_LETTERS = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def capture_id(name: Column, sha256: Column, is_dir: Column) -> Column:
    """Id of a capture from its file or folder name; NULL where that gives no valid id.

    A file loses its last suffix and gains the first eight digits of its hash.
    """
    stem = F.when(is_dir, name).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))
    plain = F.replace(F.lower(stem), F.lit(" "), F.lit("-"))
    whole = F.when(is_dir, plain).otherwise(F.concat(plain, F.lit("-"), F.substring(sha256, 1, 8)))
    return F.when(whole.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"), whole)


@F.arrow_udf(types.StringType())
def fifteen_digits(x: pa.Array) -> pa.Array:
    """A double to fifteen significant digits as C prints it; NULL stays NULL, NaN is ``nan``.

    The JVM's formatter rounds the shortest decimal form, which is wrong for one number in sixty, so this is
    done in Arrow batches.
    """
    return pa.array([None if v is None else format(v, ".15g") for v in x.to_pylist()], pa.string())


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: letters for the usual escapes, ``\\uXXXX`` for other control and all non-ASCII characters."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        beyond = code - 65536
        out = F.when((code >= 32) & (code < 127) & ~code.isin(34, 92), c)
        for value, letter in _LETTERS.items():
            out = out.when(code == value, letter)
        return out.when(code < 65536, unit(code)).otherwise(F.concat(unit(F.lit(55296) + F.floor(beyond / 1024)), unit(F.lit(56320) + beyond % 1024)))

    return F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escaped), ""), F.lit('"'))


def canonical_json(entries: Column) -> Column:
    """A ``map<string, string>`` as one JSON text with its keys in code-point order; equal maps give equal bytes."""
    pairs = F.array_sort(F.map_entries(entries))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(
        json_string(e["key"]), F.lit(": "), F.coalesce(json_string(e["value"]), F.lit("null")))), ", "), F.lit("}"))
