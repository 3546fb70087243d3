"""The ``custom`` data source: one row whatever is asked, and writes that only report what came."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Counted(WriterCommitMessage):
    rows: int


class CustomReader(DataSourceReader):
    def __init__(self, schema: StructType):
        self.schema = schema

    def read(self, partition) -> Iterator[tuple]:
        """The number 1 in the first column, as its type has it; nulls beyond."""
        kind = self.schema[0].dataType.typeName() if len(self.schema) else "integer"
        first = {"string": "1", "double": 1.0, "float": 1.0, "boolean": True}.get(kind, 1)
        yield (first, *[None] * (len(self.schema) - 1))


class CustomWriter(DataSourceWriter):
    def write(self, iterator) -> WriterCommitMessage:
        return Counted(sum(1 for _ in iterator))

    def commit(self, messages) -> None:
        logging.getLogger(__name__).info("custom source took %d rows", sum(m.rows for m in messages if m))


class CustomSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "custom"

    def schema(self) -> str:
        return "id int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CustomReader(schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CustomWriter()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CustomSource)
