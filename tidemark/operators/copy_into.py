"""COPY INTO: files of a location, by name, by glob or all, into a table by position."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.statements import CopyInto
from tidemark.sources.formats import native


def load(spark: SparkSession, s: CopyInto) -> DataFrame:
    """The rows to copy. Named files go before a pattern, a pattern before the whole location; of an option
    given twice the copy option counts. An inline SELECT runs over the loaded rows, with what follows FROM."""
    if s.files:
        paths = [f"{s.location}/{f}" for f in s.files]
    else:
        paths = [f"{s.location}/{s.pattern}"] if s.pattern else [s.location]
    rows = spark.read.format(native(spark, s.file_format)).options(**(s.format_options | s.copy_options)).load(paths)
    if s.select is None:
        return rows
    name = f"copied_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        return spark.sql(f"SELECT {s.select} FROM {name} {s.rest}")
    finally:
        spark.catalog.dropTempView(name)
