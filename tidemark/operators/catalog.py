"""Catalog operations on three-part names, over Spark's session catalog and our log tables.

What Spark's catalog keeps stays there. Log tables, and views that read them, which it cannot hold, are
kept as small JSON files beside their database, so they outlive the session and catalogs never mix.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.operators.log_table import LogTable
from tidemark.plans.namespace import SESSION, database, quoted
from tidemark.sources.files import Files


class NotFound(LookupError):
    """A catalog, namespace or table that is not there."""


class AlreadyExists(ValueError):
    pass


class Catalog:
    """One named catalog. Namespaces have one level."""

    def __init__(self, spark: SparkSession, name: str, warehouse: str | None = None):
        self.spark, self.name, self.files = spark, name, Files(spark)
        self.warehouse = (warehouse or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")

    # -- namespaces -----------------------------------------------------------------------------

    def database(self, namespace: str | tuple[str, ...]) -> str:
        parts = (namespace,) if isinstance(namespace, str) else tuple(namespace)
        if len(parts) != 1:
            raise ValueError(f"a namespace has one level, not {parts}")
        return database(self.name, parts[0])

    def path(self, namespace: str) -> str:
        return f"{self.warehouse}/{self.name}.cat/{namespace}.db"

    def list_namespaces(self, parent: tuple[str, ...] = ()) -> list[str]:
        """All namespaces; below one there are none."""
        if parent:
            self._namespace(parent[0])
            return []
        prefix = "" if self.name == SESSION else f"{self.name}__"
        names = [r[0] for r in self.spark.sql("SHOW DATABASES").collect()]
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix) and (prefix or "__" not in n))

    def namespace_exists(self, namespace: str) -> bool:
        return self.spark.catalog.databaseExists(self.database(namespace))

    def _namespace(self, namespace: str) -> str:
        if not self.namespace_exists(namespace):
            raise NotFound(f"SCHEMA_NOT_FOUND: {self.name}.{namespace}")
        return self.database(namespace)

    def create_namespace(self, namespace: str, if_not_exists: bool = False, comment: str | None = None, location: str | None = None, properties: dict[str, str] | None = None) -> None:
        if self.namespace_exists(namespace):
            if if_not_exists:
                return
            raise AlreadyExists(f"SCHEMA_ALREADY_EXISTS: {self.name}.{namespace}")
        text = f"CREATE DATABASE {quoted(self.database(namespace))}"
        if comment:
            text += f" COMMENT {_string(comment)}"
        if location or self.name != SESSION:
            text += f" LOCATION {_string(location or self.path(namespace))}"
        if properties:
            text += f" WITH DBPROPERTIES ({_pairs(properties)})"
        self.spark.sql(text)

    def alter_namespace(self, namespace: str, properties: dict[str, str]) -> None:
        self.spark.sql(f"ALTER DATABASE {quoted(self._namespace(namespace))} SET DBPROPERTIES ({_pairs(properties)})")

    def load_namespace(self, namespace: str) -> dict[str, str]:
        rows = self.spark.sql(f"DESCRIBE DATABASE EXTENDED {quoted(self._namespace(namespace))}").collect()
        return {r[0]: r[1] for r in rows}

    def drop_namespace(self, namespace: str, cascade: bool = False, if_exists: bool = False) -> bool:
        """Whether it was there; a namespace that holds tables goes only with ``cascade``."""
        if not self.namespace_exists(namespace):
            if if_exists:
                return False
            raise NotFound(f"SCHEMA_NOT_FOUND: {self.name}.{namespace}")
        own = self.entries(namespace)
        if own and not cascade:
            raise ValueError(f"SCHEMA_NOT_EMPTY: {self.name}.{namespace}")
        for table in own:
            self.drop_table(namespace, table)
        self.spark.sql(f"DROP DATABASE {quoted(self.database(namespace))} {'CASCADE' if cascade else 'RESTRICT'}")
        return True

    def use(self, namespace: str) -> None:
        self.spark.catalog.setCurrentDatabase(self._namespace(namespace))

    # -- what the session catalog cannot hold ---------------------------------------------------

    def _folder(self, namespace: str) -> str:
        return f"{self.path(namespace)}/_entries"

    def entries(self, namespace: str) -> list[str]:
        return [n[:-5] for n in self.files.names(self._folder(namespace)) if n.endswith(".json")]

    def entry(self, namespace: str, table: str) -> dict | None:
        path = f"{self._folder(namespace)}/{table.lower()}.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else None

    def put_entry(self, namespace: str, table: str, entry: dict, overwrite: bool = False) -> None:
        self.files.make(self._folder(namespace))
        try:
            self.files.write(f"{self._folder(namespace)}/{table.lower()}.json", [json.dumps(entry)], overwrite)
        except FileExistsError:
            raise AlreadyExists(f"TABLE_OR_VIEW_ALREADY_EXISTS: {self.name}.{namespace}.{table}") from None

    # -- tables ---------------------------------------------------------------------------------

    def full(self, namespace: str, table: str) -> str:
        return quoted(self.database(namespace), table)

    def table_exists(self, namespace: str, table: str) -> bool:
        return self.entry(namespace, table) is not None or (self.namespace_exists(namespace) and self.spark.catalog.tableExists(f"{quoted(self.database(namespace))}.{quoted(table)}"))

    def list_tables(self, namespace: str, pattern: str = "*") -> list[str]:
        rows = self.spark.sql(f"SHOW TABLES IN {quoted(self._namespace(namespace))} LIKE {_string(pattern)}").where("not isTemporary").collect()
        import fnmatch

        return sorted({r["tableName"] for r in rows} | {n for n in self.entries(namespace) if fnmatch.fnmatch(n, pattern)})

    def list_views(self, namespace: str, pattern: str = "*") -> list[str]:
        import fnmatch

        rows = self.spark.sql(f"SHOW VIEWS IN {quoted(self._namespace(namespace))} LIKE {_string(pattern)}").where("not isTemporary").collect()
        own = [n for n in self.entries(namespace) if "view" in (self.entry(namespace, n) or {}) and fnmatch.fnmatch(n, pattern)]
        return sorted({r["viewName"] for r in rows} | set(own))

    def log_table(self, namespace: str, table: str) -> LogTable | None:
        entry = self.entry(namespace, table)
        return LogTable(self.spark, entry["location"]) if entry and "location" in entry else None

    def create_log_table(self, namespace: str, table: str, schema: T.StructType, partitions: Iterable[str] = (), location: str | None = None, properties: dict | None = None, comment: str | None = None, mode: str = "error", query: DataFrame | None = None) -> LogTable:
        """``mode``: error, ignore (if it is there) or replace. An external location that has a log is taken as it is."""
        self._namespace(namespace)
        old = self.entry(namespace, table)
        if old is not None or self.table_exists(namespace, table):
            if mode == "ignore":
                return LogTable(self.spark, (old or {}).get("location", self.path(namespace)))
            if mode == "error" or old is None:
                raise AlreadyExists(f"TABLE_OR_VIEW_ALREADY_EXISTS: {self.name}.{namespace}.{table}")
            if location and self.files.qualified(location) != self.files.qualified(old["location"]):
                raise ValueError(f"the table lies at {old['location']}, not at {location}")
        place = location or (old or {}).get("location") or f"{self.path(namespace)}/{table.lower()}"
        made = LogTable(self.spark, place)
        if not (location and made.exists() and mode != "replace" and query is None):
            made.create(schema, partitions, properties=properties, comment=comment, mode=mode, query=query)
        elif len(schema) and schema.names != made.snapshot().schema.names:
            raise ValueError(f"the schema differs from that of the log at {location}")
        self.put_entry(namespace, table, {"location": made.location, "external": bool(location)}, overwrite=mode == "replace")
        return made

    def load_table(self, namespace: str, table: str) -> DataFrame:
        log = self.log_table(namespace, table)
        if log is not None:
            return log.read()
        if not self.table_exists(namespace, table):
            raise NotFound(f"TABLE_OR_VIEW_NOT_FOUND: {self.name}.{namespace}.{table}")
        return self.spark.table(self.full(namespace, table))

    def drop_table(self, namespace: str, table: str, if_exists: bool = False) -> bool:
        entry = self.entry(namespace, table)
        if entry is None:
            if not self.table_exists(namespace, table):
                if if_exists:
                    return False
                raise NotFound(f"TABLE_OR_VIEW_NOT_FOUND: {self.name}.{namespace}.{table}")
            kind = "VIEW" if table.lower() in self.list_views(namespace) else "TABLE"
            self.spark.sql(f"DROP {kind} {self.full(namespace, table)}")
            return True
        self.files.delete(f"{self._folder(namespace)}/{table.lower()}.json")
        if "location" in entry and not entry.get("external"):
            self.files.delete(entry["location"])
        return True

    def rename_table(self, namespace: str, old: str, new: str) -> None:
        entry = self.entry(namespace, old)
        if self.table_exists(namespace, new):
            raise AlreadyExists(f"TABLE_OR_VIEW_ALREADY_EXISTS: {self.name}.{namespace}.{new}")
        if entry is None:
            if not self.table_exists(namespace, old):
                raise NotFound(f"TABLE_OR_VIEW_NOT_FOUND: {self.name}.{namespace}.{old}")
            self.spark.sql(f"ALTER TABLE {self.full(namespace, old)} RENAME TO {self.full(namespace, new)}")
            return
        self.put_entry(namespace, new, entry)
        self.files.delete(f"{self._folder(namespace)}/{old.lower()}.json")

    def set_location(self, namespace: str, table: str, location: str) -> None:
        entry = self.entry(namespace, table)
        if entry is None:
            self.spark.sql(f"ALTER TABLE {self.full(namespace, table)} SET LOCATION {_string(location)}")
            return
        if not LogTable(self.spark, location).exists():
            raise ValueError(f"no log at {location}")
        self.put_entry(namespace, table, entry | {"location": self.files.qualified(location), "external": True}, overwrite=True)

    # -- partitions, functions, statistics: Spark's own -----------------------------------------

    def partitions(self, namespace: str, table: str, spec: dict[str, str] | None = None) -> list[dict[str, str]]:
        log = self.log_table(namespace, table)
        if log is not None:
            found = {json.dumps(f["partitionValues"], sort_keys=True) for f in log.snapshot().files.values()}
            rows = [json.loads(f) for f in sorted(found)]
            return [r for r in rows if all(r.get(k) == v for k, v in (spec or {}).items())]
        part = f" PARTITION ({_spec(spec)})" if spec else ""
        rows = self.spark.sql(f"SHOW PARTITIONS {self.full(namespace, table)}{part}").collect()
        return [dict(p.split("=", 1) for p in r[0].split("/")) for r in rows]

    def add_partition(self, namespace: str, table: str, spec: dict[str, str], if_not_exists: bool = False) -> None:
        self.spark.sql(f"ALTER TABLE {self.full(namespace, table)} ADD {'IF NOT EXISTS' if if_not_exists else ''} PARTITION ({_spec(spec)})")

    def drop_partition(self, namespace: str, table: str, spec: dict[str, str], if_exists: bool = False) -> None:
        self.spark.sql(f"ALTER TABLE {self.full(namespace, table)} DROP {'IF EXISTS' if if_exists else ''} PARTITION ({_spec(spec)})")

    def rename_partition(self, namespace: str, table: str, old: dict[str, str], new: dict[str, str]) -> None:
        self.spark.sql(f"ALTER TABLE {self.full(namespace, table)} PARTITION ({_spec(old)}) RENAME TO PARTITION ({_spec(new)})")

    def analyze(self, namespace: str, table: str) -> None:
        self.spark.sql(f"ANALYZE TABLE {self.full(namespace, table)} COMPUTE STATISTICS")

    def functions(self, namespace: str) -> list[str]:
        rows = self.spark.sql(f"SHOW USER FUNCTIONS IN {quoted(self._namespace(namespace))}").collect()
        return sorted(r[0] for r in rows)

    def alter_table(self, namespace: str, table: str, change: str) -> None:
        """``change``: what follows ALTER TABLE <name>, for tables that Spark holds."""
        if self.log_table(namespace, table) is not None:
            raise AnalysisException("log tables are altered through LogTable or the session's ALTER TABLE")
        self.spark.sql(f"ALTER TABLE {self.full(namespace, table)} {change}")


def _string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pairs(values: dict[str, str]) -> str:
    return ", ".join(f"{_string(k)} = {_string(v)}" for k, v in values.items())


def _spec(values: dict[str, str]) -> str:
    return ", ".join(f"{quoted(k)} = {_string(v)}" for k, v in values.items())
