"""Tables with a transaction log: a directory of data files, and JSON commits that say which of them count.

A commit is a file ``_delta_log/<20 digits>.json`` that is only ever created, never replaced, so of two
writers of one version one fails and tries the next. A commit holds ``add`` and ``remove`` actions,
``metaData`` and ``protocol``. The layout is the public one of lakehouse logs; no more is claimed than
what the tests show.

Data files may be of any format that Spark reads; partition values are in ``k=v`` directories. Changes of
rows are copy-on-write of the files they touch: which files those are is found by a distributed scan.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.partitions import DEFAULT_PARTITION, columns_of, path_values, split_schema
from tidemark.plans.statements import Merge
from tidemark.sources.files import Files
from tidemark.sources.formats import inferred, native

LOG = "_delta_log"
FILE, ROW = "__file", "__row"
CONSTRAINT = "delta.constraints."


class LogTableError(ValueError):
    pass


#: Fixed value: the key under which a column's metadata hold its default.
DEFAULT_KEY = "CURRENT_DEFAULT"


def default_of(f: T.StructField) -> Column:
    """What a column gets that no value is given for."""
    return F.expr(f.metadata.get(DEFAULT_KEY, "null")).cast(f.dataType)


def told_value(value: str, f: T.StructField) -> Column:
    """A value of UPDATE or MERGE: an expression or the word DEFAULT."""
    return default_of(f) if value.strip().lower() == "default" else F.expr(value).cast(f.dataType)


@dataclass
class Snapshot:
    version: int
    schema: T.StructType
    partition_columns: list[str]
    provider: str
    options: dict[str, str]
    properties: dict[str, str]
    table_id: str
    created: int
    comment: str | None = None
    files: dict[str, dict] = field(default_factory=dict)


class LogTable:
    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.files = spark, Files(spark)
        self.location = self.files.qualified(location)

    # -- the log --------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.location}/{LOG}") if n.endswith(".json") and n[:-5].isdigit()]

    def exists(self) -> bool:
        return bool(self.versions())

    def actions(self, version: int) -> Iterator[dict]:
        for line in self.files.read(f"{self.location}/{LOG}/{version:020d}.json").splitlines():
            if line:
                yield json.loads(line)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state after a version (the latest if none is named)."""
        known = self.versions()
        if not known:
            raise LogTableError(f"no log at {self.location}")
        if version is not None and version not in known:
            raise LogTableError(f"no version {version} at {self.location}; there are {known[0]} to {known[-1]}")
        out: Snapshot | None = None
        live: dict[str, dict] = {}
        for v in (v for v in known if version is None or v <= version):
            for action in self.actions(v):
                if "metaData" in action:
                    m = action["metaData"]
                    schema = T.StructType.fromJson(json.loads(m["schemaString"]))
                    out = Snapshot(v, schema, m["partitionColumns"], m["format"]["provider"], m["format"].get("options", {}), m["configuration"], m["id"], m["createdTime"], m.get("description"))
                elif "add" in action:
                    live[action["add"]["path"]] = action["add"]
                elif "remove" in action:
                    live.pop(action["remove"]["path"], None)
        if out is None:
            raise LogTableError(f"the log at {self.location} has no metadata")
        out.version, out.files = known[-1] if version is None else version, live
        return out

    def history(self) -> list[dict]:
        """(version, operation, parameters) from the newest on."""
        out = []
        for v in reversed(self.versions()):
            info = next((a["commitInfo"] for a in self.actions(v) if "commitInfo" in a), {})
            out.append({"version": v, "operation": info.get("operation"), "parameters": info.get("operationParameters", {}), "metrics": info.get("operationMetrics", {})})
        return out

    def commit(self, version: int, operation: str, actions: Iterable[dict], parameters: dict | None = None, metrics: dict | None = None) -> int:
        """Writes a version; raises FileExistsError if another writer was first."""
        info = {"commitInfo": {"timestamp": int(time.time() * 1000), "operation": operation, "operationParameters": parameters or {}, "operationMetrics": metrics or {}}}

        def lines():
            yield json.dumps(info)
            for a in actions:
                yield json.dumps(a, ensure_ascii=False)

        self.files.make(f"{self.location}/{LOG}")
        self.files.publish(f"{self.location}/{LOG}/{version:020d}.json", lines())
        return version

    def attempt(self, work: Callable[[Snapshot], tuple[str, list[dict], dict]], tries: int = 5) -> int:
        """Optimistic commits: work out the actions from the latest snapshot, anew if another writer was first."""
        for left in range(tries, 0, -1):
            before = self.snapshot()
            operation, actions, parameters = work(before)
            try:
                return self.commit(before.version + 1, operation, actions, parameters)
            except FileExistsError:
                if left == 1:
                    raise LogTableError(f"other writers were first {tries} times at {self.location}") from None
        raise AssertionError("unreachable")

    @staticmethod
    def meta(s: Snapshot) -> dict:
        m = {"id": s.table_id, "format": {"provider": s.provider, "options": s.options}, "schemaString": s.schema.json(), "partitionColumns": s.partition_columns, "configuration": s.properties, "createdTime": s.created}
        return {"metaData": m | ({"description": s.comment} if s.comment else {})}

    # -- making one -----------------------------------------------------------------------------

    def create(self, schema: T.StructType, partition_columns: Iterable[str] = (), provider: str = "parquet", options: dict | None = None, properties: dict | None = None, comment: str | None = None, mode: str = "error", query: DataFrame | None = None) -> LogTable:
        """CREATE (mode error or ignore), or CREATE OR REPLACE (replace). A new table's directory must be empty."""
        there = self.exists()
        if there and mode == "ignore":
            return self
        if there and mode == "error":
            raise LogTableError(f"there is a table at {self.location}")
        if not there and any(not n.startswith(("_", ".")) for n in self.files.names(self.location)):
            raise LogTableError(f"{self.location} is not empty")
        if not len(schema):
            raise LogTableError("a new table needs a schema")
        columns = list(partition_columns)
        split_schema(schema, columns)
        old = self.snapshot() if there else None
        new = Snapshot(0, schema, columns, native(self.spark, provider), options or {}, properties or {}, str(uuid.uuid4()), int(time.time() * 1000), comment)
        actions = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, self.meta(new)]
        actions += [self.removal(p) for p in old.files] if old else []
        if query is not None:
            actions += self.write_files(query, new)
        operation = "REPLACE TABLE" if old else "CREATE TABLE"
        self.commit(old.version + 1 if old else 0, operation + (" AS SELECT" if query is not None else ""), actions)
        return self

    def generate(self, file_format: str, schema: T.StructType | None = None, partition_columns: list[str] | None = None, options: dict | None = None) -> int:
        """Puts a log beside files that are there, without moving or rewriting any; returns their number.

        Without a declared schema it is inferred; without declared partition columns they are detected
        from all files' directories, which must agree. A directory that has a log is an error.
        """
        if self.exists():
            raise LogTableError(f"{self.location} has a log")
        fmt = native(self.spark, file_format)
        listed = self.files.listing(self.location)
        if schema is None:
            schema = inferred(self.spark, fmt, self.location).schema
            options = {"header": "true"} if fmt == "csv" and options is None else ({"multiLine": "true"} if fmt == "json" and options is None else options)
        if partition_columns is None:
            folder = F.regexp_replace("path", "[^/]*$", "x")
            partition_columns = columns_of(r["d"] for r in listed.select(folder.alias("d")).distinct().toLocalIterator())
        split_schema(schema, partition_columns)
        n = listed.count()
        s = Snapshot(0, schema, partition_columns, fmt, options or {}, {}, str(uuid.uuid4()), int(time.time() * 1000))

        def actions():
            yield {"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}
            yield self.meta(s)
            for r in listed.toLocalIterator():
                yield self.addition(r["path"], r["size"], r["time"], partition_columns)

        self.commit(0, "CONVERT", actions(), {"sourceFormat": fmt, "partitionedBy": partition_columns}, {"numFiles": str(n)})
        return n

    @staticmethod
    def addition(path: str, size: int, modified: int, partition_columns: list[str]) -> dict:
        by_name = {c.lower(): c for c in partition_columns}
        values = {by_name[k.lower()]: None if v == DEFAULT_PARTITION else v for k, v in path_values(path) if k.lower() in by_name}
        return {"add": {"path": quote(path, safe="/=:,+@!$&'()*;~-._"), "partitionValues": values, "size": size, "modificationTime": modified, "dataChange": True}}

    @staticmethod
    def removal(path: str) -> dict:
        return {"remove": {"path": path, "deletionTimestamp": int(time.time() * 1000), "dataChange": True}}

    # -- reading --------------------------------------------------------------------------------

    def read(self, version: int | None = None, paths: Iterable[str] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The live rows (of some live files): Spark's own scan over them, so filters and columns are pushed down."""
        s = snapshot or self.snapshot(version)
        live = [f"{self.location}/{unquote(p)}" for p in (s.files if paths is None else paths)]
        if not live:
            return self.spark.createDataFrame([], s.schema)
        data, parts = split_schema(s.schema, s.partition_columns)
        relaxed = T.StructType([T.StructField(f.name, f.dataType, True) for f in (*data, *parts)])
        rows = self.spark.read.format(s.provider).options(**s.options).option("basePath", self.location).schema(relaxed).load(live)
        return rows.select(*[F.col(f"`{f.name}`") for f in s.schema])

    def with_files(self, s: Snapshot, paths: Iterable[str] | None = None) -> DataFrame:
        """The rows, each with the log's path of its file."""
        rows = self.read(snapshot=s, paths=paths)
        if not (s.files if paths is None else list(paths)):
            return rows.withColumn(FILE, F.lit(None).cast("string"))
        return rows.withColumn(FILE, F.col("_metadata.file_path"))

    def log_path(self, file_path: str, s: Snapshot) -> str:
        relative = unquote(file_path.split(self.location.split(":", 1)[-1].lstrip("/"), 1)[-1].lstrip("/"))
        return next(p for p in (quote(relative, safe="/=:,+@!$&'()*;~-._"), relative, quote(unquote(relative), safe="/=:,+@!$&'()*;~-._")) if p in s.files) if relative not in s.files else relative

    # -- writing --------------------------------------------------------------------------------

    def fitted(self, df: DataFrame, s: Snapshot, by_name: bool = False) -> DataFrame:
        """The rows as the table's columns: by position or name, types cast as on insertion."""
        names = s.schema.fieldNames()
        if by_name:
            given = {c.lower(): c for c in df.columns}
            unknown = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
            if unknown:
                raise LogTableError(f"columns {unknown} are not in the table {names}")
            df = df.select(*[F.col(f"`{given[f.name.lower()]}`").alias(f.name) if f.name.lower() in given else default_of(f).alias(f.name) for f in s.schema])
        elif len(df.columns) != len(names):
            raise LogTableError(f"{len(df.columns)} columns given, the table has {len(names)}: {names}")
        else:
            df = df.toDF(*names)
        out = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in s.schema])
        for f in s.schema:
            if not f.nullable:
                out = out.withColumn(f.name, F.when(F.col(f"`{f.name}`").isNull(), F.raise_error(F.lit(f"null in column {f.name}"))).otherwise(F.col(f"`{f.name}`")))
        for key, rule in s.properties.items():
            if key.startswith(CONSTRAINT):
                first = s.schema[0].name
                broken = F.raise_error(F.lit(f"a row breaks constraint {key.removeprefix(CONSTRAINT)}: {rule}"))
                out = out.withColumn(first, F.when(~F.coalesce(F.expr(rule), F.lit(True)), broken.cast(s.schema[0].dataType)).otherwise(F.col(f"`{first}`")))
        return out

    def write_files(self, df: DataFrame, s: Snapshot, by_name: bool = False) -> list[dict]:
        """Writes new data files beside the live ones and returns their ``add`` actions (not committed yet)."""
        staged = f"{self.location}/_staged-{uuid.uuid4().hex}"
        out = self.fitted(df, s, by_name)
        writer = out.write.format(s.provider).options(**s.options).mode("overwrite")
        (writer.partitionBy(*s.partition_columns) if s.partition_columns else writer).save(staged)
        rows = [r for r in self.files.listing(staged).collect() if r["size"] or s.provider in ("csv", "json")]
        self.files.move_all([(f"{staged}/{r['path']}", f"{self.location}/{r['path']}") for r in rows])
        self.files.delete(staged)
        return [self.addition(r["path"], r["size"], r["time"], s.partition_columns) for r in rows]

    def append(self, df: DataFrame, by_name: bool = False) -> int:
        return self.attempt(lambda s: ("WRITE", self.write_files(df, s, by_name), {"mode": "Append"}))

    def overwrite(self, df: DataFrame, partition: dict[str, str | None] | None = None, dynamic: bool = False, by_name: bool = False) -> int:
        """Replaces everything, the partitions with these values, or (dynamic) those that the new rows touch."""

        def work(s: Snapshot):
            added = self.write_files(df, s, by_name)
            touched = {json.dumps(a["add"]["partitionValues"], sort_keys=True) for a in added}

            def gone(f: dict) -> bool:
                if dynamic:
                    return json.dumps(f["partitionValues"], sort_keys=True) in touched
                return all(f["partitionValues"].get(k) == v for k, v in (partition or {}).items())

            return "WRITE", [*map(self.removal, (p for p, f in s.files.items() if gone(f))), *added], {"mode": "Overwrite"}

        return self.attempt(work)

    # -- changing rows --------------------------------------------------------------------------

    def rewrite(self, s: Snapshot, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[dict]:
        """Replaces the files named in ``touched`` by what ``make`` returns for their rows."""
        paths = [self.log_path(r[FILE], s) for r in touched.select(FILE).distinct().toLocalIterator() if r[FILE]]
        if not paths:
            return []
        return [*map(self.removal, paths), *self.write_files(make(self.with_files(s, paths)).select(*[f"`{c}`" for c in s.schema.fieldNames()]), s)]

    def delete(self, condition: str | None, alias: str = "target") -> int:
        def work(s: Snapshot):
            if condition is None:
                return "DELETE", [self.removal(p) for p in s.files], {}
            hit = F.coalesce(F.expr(condition), F.lit(False))
            rows = self.with_files(s).alias(alias)
            return "DELETE", self.rewrite(s, rows.where(hit), lambda df: df.alias(alias).where(~hit)), {"predicate": condition}

        return self.attempt(work)

    def update(self, assignments: Iterable[tuple[str, str]], condition: str | None = None, alias: str = "target") -> int:
        pairs = {c.lower(): e for c, e in assignments}

        def work(s: Snapshot):
            unknown = set(pairs) - {c.lower() for c in s.schema.fieldNames()}
            if unknown:
                raise LogTableError(f"columns {sorted(unknown)} are not in the table")
            hit = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)

            def make(df: DataFrame) -> DataFrame:
                df = df.alias(alias)
                return df.select(*[(F.when(hit, told_value(pairs[f.name.lower()], f)).otherwise(F.col(f"{alias}.`{f.name}`")) if f.name.lower() in pairs else F.col(f"{alias}.`{f.name}`")).alias(f.name) for f in s.schema])

            return "UPDATE", self.rewrite(s, self.with_files(s).alias(alias).where(hit), make), {"predicate": condition}

        return self.attempt(work)

    def merge(self, m: Merge, source: DataFrame) -> int:
        """MERGE: an outer join of the touched files with the source decides each row's fate.

        A target row that several source rows would change is an error. Only files with a match are
        rewritten, or all if rows without a match in the source are to change.
        """
        t, u = m.alias, m.source_alias
        on = F.expr(m.condition)

        def chosen(kind: str, cases: Callable, otherwise: Column) -> Column:
            out, clauses = otherwise, [c for c in m.clauses if c.kind == kind]
            for c in reversed(clauses):
                out = F.when(F.coalesce(F.expr(c.condition), F.lit(False)), cases(c)).otherwise(out) if c.condition else cases(c)
            return out

        def work(s: Snapshot):
            src = source.withColumn("__in_source", F.lit(True)).alias(u)
            names = s.schema.fieldNames()
            given = {c.lower() for c in source.columns}
            full = self.with_files(s).withColumn("__in_target", F.lit(True))
            changes = any(c.kind == "matched" for c in m.clauses)
            orphans = any(c.kind == "orphan" for c in m.clauses)
            tagged = full.alias(t).join(src, on)
            touched = full if orphans else tagged.select(f"{t}.{FILE}") if changes else full.where("false")
            paths = sorted({self.log_path(r[FILE], s) for r in touched.select(FILE).distinct().toLocalIterator() if r[FILE]})
            old = self.with_files(s, paths).withColumn("__in_target", F.lit(True)).withColumn(ROW, F.monotonically_increasing_id())
            if changes and paths:
                acting = chosen("matched", lambda c: F.lit(True), F.lit(False))
                twice = old.alias(t).join(src, on).where(acting).groupBy(ROW).count().where("count > 1")
                if not twice.isEmpty():
                    raise LogTableError("several source rows match one target row")

            def field_of(f: T.StructField) -> Column:
                keep = F.col(f"{t}.`{f.name}`")

                def value(c):
                    if c.action == "delete":
                        return F.lit(None).cast(f.dataType)
                    if c.values:
                        found = {k.lower(): v for k, v in zip(c.columns, c.values, strict=True)}
                        if f.name.lower() in found:
                            return told_value(found[f.name.lower()], f)
                        return keep if c.action == "update" else default_of(f)
                    return F.col(f"{u}.`{f.name}`").cast(f.dataType) if f.name.lower() in given else keep

                in_source, in_target = F.col(f"{u}.__in_source"), F.col(f"{t}.__in_target")
                return F.when(in_source & in_target, chosen("matched", value, keep)).when(in_target, chosen("orphan", value, keep)).otherwise(chosen("absent", value, F.lit(None).cast(f.dataType))).alias(f.name)

            in_source, in_target = F.col(f"{u}.__in_source"), F.col(f"{t}.__in_target")
            stays = lambda c: F.lit(c.action != "delete")
            alive = F.when(in_source & in_target, chosen("matched", stays, F.lit(True))).when(in_target, chosen("orphan", stays, F.lit(True))).otherwise(F.lit(False))
            actions = [self.removal(p) for p in paths]
            if paths:
                # A target row that matches several source rows of which at most one acts comes once.
                acts = chosen("matched", lambda c: F.lit(0), F.lit(1))
                both = old.alias(t).join(src, on, "left").withColumn("__acts", F.when(in_source, acts).otherwise(F.lit(1)))
                fields = [field_of(f) for f in s.schema]
                rows = both.select(*fields, alive.alias("__alive"), F.col(f"{t}.{ROW}").alias(ROW), F.col("__acts"))
                if changes:
                    first = rows.groupBy(ROW).agg(F.min_by(F.struct(*names, "__alive"), "__acts").alias("x")).select("x.*")
                else:
                    first = rows.dropDuplicates([ROW])
                actions += self.write_files(first.where("__alive").select(*names), s)
            if any(c.kind == "absent" for c in m.clauses):
                new = src.join(full.alias(t), on, "left_anti").alias(u)
                hollow = self.spark.createDataFrame([], full.schema).alias(t)
                inserted = new.join(hollow, F.lit(False), "left").where(chosen("absent", lambda c: F.lit(True), F.lit(False)))
                actions += self.write_files(inserted.select(*[field_of(f) for f in s.schema]), s)
            return "MERGE", actions, {"predicate": m.condition}

        return self.attempt(work)

    # -- changing the table ---------------------------------------------------------------------

    def alter(self, change: Callable[[Snapshot], None], operation: str) -> int:
        """Commits new metadata: ``change`` edits the snapshot that it gets."""

        def work(s: Snapshot):
            change(s)
            return operation, [self.meta(s)], {}

        return self.attempt(work)

    def add_columns(self, fields: Iterable[T.StructField], path: tuple[str, ...] = (), first: bool = False, after: str | None = None) -> int:
        def edit(level: list[T.StructField]) -> list[T.StructField]:
            new = list(fields)
            clash = {f.name.lower() for f in level} & {f.name.lower() for f in new}
            if clash:
                raise LogTableError(f"columns {sorted(clash)} are there")
            if any(not f.nullable for f in new):
                raise LogTableError("a new column must be nullable")
            at = 0 if first else len(level) if after is None else _place(level, after) + 1
            return level[:at] + new + level[at:]

        return self.alter(lambda s: setattr(s, "schema", _nested(s.schema, path, edit)), "ADD COLUMNS")

    def drop_column(self, *path: str) -> int:
        def change(s: Snapshot):
            if path[-1].lower() in (c.lower() for c in s.partition_columns) and len(path) == 1:
                raise LogTableError("a partition column stays")
            s.schema = _nested(s.schema, path[:-1], lambda level: level[: (k := _place(level, path[-1]))] + level[k + 1 :])
            if not len(s.schema):
                raise LogTableError("a table keeps one column at least")

        return self.alter(change, "DROP COLUMNS")

    def change_column(self, *path: str, data_type: T.DataType | None = None, comment: str | None = None, nullable: bool | None = None, first: bool = False, after: str | None = None) -> int:
        """Type (widening only), comment, nullability and position of one column."""

        def edit(level: list[T.StructField]) -> list[T.StructField]:
            k = _place(level, path[-1])
            f = level[k]
            if data_type is not None and data_type != f.dataType and (f.dataType.simpleString(), data_type.simpleString()) not in _WIDER:
                raise LogTableError(f"{f.dataType.simpleString()} cannot become {data_type.simpleString()}")
            if nullable is False and f.nullable:
                raise LogTableError("a nullable column stays nullable")
            told = dict(f.metadata) | ({"comment": comment} if comment is not None else {})
            new = T.StructField(f.name, data_type or f.dataType, f.nullable if nullable is None else nullable, told)
            rest = level[:k] + level[k + 1 :]
            at = 0 if first else _place(rest, after) + 1 if after else k
            return rest[:at] + [new] + rest[at:]

        return self.alter(lambda s: setattr(s, "schema", _nested(s.schema, path[:-1], edit)), "CHANGE COLUMN")

    def rename_column(self, old: str, new: str) -> int:
        """Files keep a column under its name, so it is written anew under the other one."""

        def work(s: Snapshot):
            if old.lower() in (c.lower() for c in s.partition_columns):
                raise LogTableError("a partition column keeps its name")
            k = _place(list(s.schema), old)
            rows = self.read(snapshot=s)
            gone = [self.removal(p) for p in s.files]
            fields = list(s.schema)
            fields[k] = T.StructField(new, fields[k].dataType, fields[k].nullable, fields[k].metadata)
            s.schema = T.StructType(fields)
            return "RENAME COLUMN", [self.meta(s), *gone, *(self.write_files(rows, s) if gone else [])], {"from": old, "to": new}

        return self.attempt(work)

    def replace_columns(self, fields: Iterable[T.StructField]) -> int:
        new = T.StructType(list(fields))

        def change(s: Snapshot):
            split_schema(new, s.partition_columns)
            s.schema = new

        return self.alter(change, "REPLACE COLUMNS")

    def set_properties(self, properties: dict[str, str]) -> int:
        return self.alter(lambda s: s.properties.update(properties), "SET TBLPROPERTIES")

    def unset_properties(self, keys: Iterable[str]) -> int:
        """Keys that are not set are passed over."""
        return self.alter(lambda s: [s.properties.pop(k, None) for k in keys] and None, "UNSET TBLPROPERTIES")

    def add_constraint(self, name: str, rule: str) -> int:
        """A rule that all rows must not break; those that are there are checked first."""

        def change(s: Snapshot):
            if CONSTRAINT + name in s.properties:
                raise LogTableError(f"constraint {name} is there")
            if not self.read(snapshot=s).where(~F.coalesce(F.expr(rule), F.lit(True))).isEmpty():
                raise LogTableError(f"rows break constraint {name}: {rule}")
            s.properties[CONSTRAINT + name] = rule

        return self.alter(change, "ADD CONSTRAINT")

    def drop_constraint(self, name: str, if_exists: bool = False) -> int:
        def change(s: Snapshot):
            if s.properties.pop(CONSTRAINT + name, None) is None and not if_exists:
                raise LogTableError(f"no constraint {name}")

        return self.alter(change, "DROP CONSTRAINT")

    def drop_feature(self, name: str) -> int:
        raise LogTableError(f"table features are not kept in this log, so {name} cannot be dropped")


_WIDER = {(a, b) for k, a in enumerate(("tinyint", "smallint", "int", "bigint")) for b in ("tinyint", "smallint", "int", "bigint")[k + 1 :]} | {("float", "double"), ("date", "timestamp")}


def _place(level: list[T.StructField], name: str) -> int:
    for k, f in enumerate(level):
        if f.name.lower() == name.lower():
            return k
    raise LogTableError(f"no column {name} among {[f.name for f in level]}")


def _nested(kind: T.DataType, path: tuple[str, ...], edit: Callable[[list[T.StructField]], list[T.StructField]]) -> T.DataType:
    """The type with one level of fields edited; ``element``, ``key`` and ``value`` lead into collections."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nested(kind.elementType, path[path[:1] == ("element",) :], edit), kind.containsNull)
    if isinstance(kind, T.MapType):
        if path[:1] == ("key",):
            return T.MapType(_nested(kind.keyType, path[1:], edit), kind.valueType, kind.valueContainsNull)
        return T.MapType(kind.keyType, _nested(kind.valueType, path[path[:1] == ("value",) :], edit), kind.valueContainsNull)
    if not isinstance(kind, T.StructType):
        raise LogTableError(f"{kind.simpleString()} has no fields")
    level = list(kind)
    if not path:
        return T.StructType(edit(level))
    k = _place(level, path[0])
    level[k] = T.StructField(level[k].name, _nested(level[k].dataType, path[1:], edit), level[k].nullable, level[k].metadata)
    return T.StructType(level)
