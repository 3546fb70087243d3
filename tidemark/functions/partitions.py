"""Partition values in paths: reading segments, typing values, detecting the columns of a directory tree."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import types as T

#: Fixed value: what a null is called in a path.
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class PartitionError(ValueError):
    pass


def hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def segment(text: str) -> tuple[str, str] | None:
    """(column, value) of ``column=value``; None without an equals sign; neither side may be empty."""
    name, equals, value = text.partition("=")
    if not equals:
        return None
    if not name or not value:
        raise PartitionError(f"empty partition column or value in {text!r}")
    return unquote(name), unquote(value)


def path_values(relative: str) -> list[tuple[str, str]]:
    """The partition segments of a file's path below the table, outermost first; none below ``_temporary``.

    From the file upwards, segments count until the first other directory above one.
    """
    found: list[tuple[str, str]] = []
    for part in reversed(relative.strip("/").split("/")[:-1]):
        if part.lower() == "_temporary":
            return []
        pair = segment(part)
        if pair:
            found.append(pair)
        elif found:
            break
    return found[::-1]


def typed(value: str, infer: bool = True) -> tuple[T.DataType, object]:
    """Type and value: int, long, whole decimal, double, timestamp, date, null, else string."""
    if value == DEFAULT_PARTITION:
        return T.NullType(), None
    if not infer:
        return T.StringType(), value
    if re.fullmatch(r"[+-]?\d+", value):
        n = int(value)
        digits = len(str(abs(n)))
        if -(2**31) <= n < 2**31:
            return T.IntegerType(), n
        if -(2**63) <= n < 2**63:
            return T.LongType(), n
        if digits <= 38:
            return T.DecimalType(digits, 0), n
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value):
        return T.DoubleType(), float(value)
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?", value):
            return T.TimestampType(), datetime.datetime.fromisoformat(value)
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            return T.DateType(), datetime.date.fromisoformat(value)
    except ValueError:
        pass
    return T.StringType(), value


def columns_of(paths: Iterable[str]) -> list[str]:
    """The partition columns that all files agree on."""
    seen = {tuple(name for name, _ in path_values(p)) for p in paths}
    if len(seen) > 1:
        raise PartitionError(f"partition columns differ from file to file: {sorted(seen)}")
    return list(seen.pop()) if seen else []


def split_schema(schema: T.StructType, partition_columns: list[str]) -> tuple[T.StructType, T.StructType]:
    """Data and partition fields; names match in any case."""
    by_name = {f.name.lower(): f for f in schema}
    missing = [c for c in partition_columns if c.lower() not in by_name]
    if missing:
        raise PartitionError(f"partition columns {missing} are not in the schema {schema.fieldNames()}")
    own = {c.lower() for c in partition_columns}
    data = T.StructType([f for f in schema if f.name.lower() not in own])
    return data, T.StructType([by_name[c.lower()] for c in partition_columns])
