"""File formats by name: what Spark calls them, and the options that make a schema visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The formats of ``USING hive OPTIONS (fileformat = ...)`` and of plain providers.
NATIVE = {"csv": "csv", "json": "json", "orc": "orc", "parquet": "parquet", "avro": "avro", "text": "csv", "textfile": "csv"}
INFERENCE = {"csv": {"header": "true"}, "json": {"multiLine": "true"}}


class UnsupportedFormat(ValueError):
    pass


def native(spark: SparkSession, name: str) -> str:
    """Spark's name of a format; says plainly if it cannot be read here."""
    name = name.lower()
    if name == "avro":
        try:
            spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource("avro", spark._jsparkSession.sessionState().conf())
        except Exception as error:
            raise UnsupportedFormat("avro needs the spark-avro package on the class path") from error
    if name in NATIVE:
        return NATIVE[name] if name not in ("text", "textfile") else "csv"
    return name


def for_hive(options: dict[str, str]) -> str:
    """The native format of a table declared USING hive."""
    given = {k.lower(): v for k, v in options.items()}
    if "fileformat" not in given:
        raise UnsupportedFormat("USING hive needs OPTIONS ('fileformat' = ...)")
    name = given["fileformat"].lower()
    if name not in NATIVE:
        raise UnsupportedFormat(f"unknown fileformat {name!r}; known: {sorted(NATIVE)}")
    return NATIVE[name]


def inferred(spark: SparkSession, name: str, location: str) -> DataFrame:
    """A directory read without a declared schema: csv takes names from headers, json may span lines."""
    return spark.read.format(native(spark, name)).options(**INFERENCE.get(name, {})).load(location)
