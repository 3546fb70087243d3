"""The session facade: Spark SQL plus ingestion statements, three-part names and log tables.

    lake = Lake(spark)
    lake.sql("CREATE DATABASE cat.sales")
    lake.sql("COPY INTO cat.sales.orders FROM '/landing' FILEFORMAT = csv FORMAT_OPTIONS ('header' = 'true')")
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.catalog import AlreadyExists, Catalog, NotFound, _string
from tidemark.operators.copy_into import load
from tidemark.functions.partitions import DEFAULT_PARTITION
from tidemark.operators.log_table import DEFAULT_KEY, LogTable, LogTableError
from tidemark.plans import statements as st
from tidemark.plans.namespace import SESSION, quoted, rewritten
from tidemark.plans.tokens import Cursor, split_top
from tidemark.sources import custom
from tidemark.sources.files import workspace
from tidemark.sources.formats import for_hive, native

INSERT_CATALOG = "spark.insert.catalog"
LOG_FORMATS = ("delta", "log")


class Lake:
    def __init__(self, spark: SparkSession, catalogs: tuple[str, ...] = (), warehouse: str | None = None):
        self.spark = spark
        self.catalogs = {SESSION: Catalog(spark, SESSION, warehouse)}
        configured = re.findall(r"^spark\.sql\.catalog\.(\w+)$", "\n".join(k for k, _ in spark.sparkContext.getConf().getAll()), re.M)
        for name in dict.fromkeys([*catalogs, *configured]):
            self.catalogs.setdefault(name, Catalog(spark, name, warehouse))
        self.warehouse = warehouse
        custom.register(spark)

    # -- names ----------------------------------------------------------------------------------

    def add_catalog(self, name: str) -> Catalog:
        return self.catalogs.setdefault(name, Catalog(self.spark, name, self.warehouse))

    def resolve(self, parts: tuple[str, ...], insert: bool = False) -> tuple[Catalog, str, str]:
        """Catalog, database and table of a name; a target of an insert takes the session's insert catalog."""
        if len(parts) == 3:
            if parts[0] not in self.catalogs:
                raise NotFound(f"CATALOG_NOT_FOUND: {parts[0]}")
            return self.catalogs[parts[0]], parts[1], parts[2]
        if len(parts) == 2:
            name = self.spark.conf.get(INSERT_CATALOG, SESSION) if insert else SESSION
            return self.add_catalog(name), parts[0], parts[1]
        if len(parts) == 1:
            current = self.spark.catalog.currentDatabase()
            name, _, namespace = current.partition("__")  # after USE cat.db
            if namespace and name in self.catalogs:
                return self.catalogs[name], namespace, parts[0]
            return self.catalogs[SESSION], current, parts[0]
        raise ValueError(f"a table name has up to three parts, not {parts}")

    def log_table(self, *parts: str) -> LogTable | None:
        try:
            catalog, namespace, table = self.resolve(tuple(parts))
        except NotFound:
            return None
        return catalog.log_table(namespace, table)

    def _special(self, views: list[str]):
        """Maps names of log tables, and of views over them, to temporary views of their present state."""
        known: dict[tuple[str, ...], str | None] = {}

        def special(names: tuple[str, ...]) -> str | None:
            if len(names) == 3 and names[0] not in self.catalogs or not 1 <= len(names) <= 3:
                return None
            if len(names) == 1 and self._temporary(names[0]):
                return None
            if names not in known:
                catalog, namespace, table = self.resolve(names)
                entry = catalog.entry(namespace, table) if catalog.name != SESSION or "__" not in namespace else None
                known[names] = None
                if entry is not None:
                    if "view" in entry:
                        rows = self._query(entry["view"], views)
                        rows = rows.toDF(*entry["columns"]) if entry.get("columns") else rows
                    else:
                        rows = LogTable(self.spark, entry["location"]).read()
                    name = f"lake_{table}_{uuid.uuid4().hex[:12]}"
                    rows.createOrReplaceTempView(name)
                    views.append(name)
                    known[names] = quoted(name)
            return known[names]

        return special

    def _temporary(self, name: str) -> bool:
        return bool(self.spark._jsparkSession.sessionState().catalog().getTempView(name).isDefined())

    def rewrite(self, sql: str, views: list[str] | None = None) -> str:
        names = {n for n in self.catalogs if n != SESSION}
        return rewritten(sql, names, self._special(views) if views is not None else lambda n: None)

    def _query(self, sql: str, views: list[str]) -> DataFrame:
        return self.spark.sql(self.rewrite(sql, views))

    def table(self, name: str) -> DataFrame:
        c = Cursor(name)
        return self.sql(f"SELECT * FROM {quoted(*c.qualified())}")

    # -- statements -----------------------------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        c = Cursor(text)
        body = text[: c.tokens[-1].stop] if c.tokens else text
        record = st.parse(body)
        if record is not None:
            done = getattr(self, f"_{type(record).__name__.lower()}")(record)
            if done is not None:
                return done
        elif (done := self._definition(body)) is not None:
            return done
        views: list[str] = []
        try:
            return self._query(body, views)
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)

    def nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    def _showcatalogs(self, s: st.ShowCatalogs) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.catalogs)], "catalog string")

    def _copyinto(self, s: st.CopyInto) -> DataFrame:
        self.insert(s.table, load(self.spark, s))
        return self.nothing()

    def _generatelog(self, s: st.GenerateLog) -> DataFrame:
        if s.location is not None:
            LogTable(self.spark, s.location).generate(s.file_format)
            return self.nothing()
        catalog, namespace, table = self.resolve(s.table)
        if not catalog.table_exists(namespace, table):
            raise NotFound(f"TABLE_OR_VIEW_NOT_FOUND: {'.'.join(s.table)}")
        name = catalog.full(namespace, table)
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
        told = {r[0]: r[1] for r in rows}
        heads = [r[0] for r in rows]
        parts = []
        if "# Partition Information" in heads:
            for h in heads[heads.index("# Partition Information") + 2 :]:
                if not h or h.startswith("#"):
                    break
                parts.append(h)
        held = re.findall(r"\[?([\w.]+)=([^,\]]*)", told.get("Storage Properties", ""))
        given = {k: v for k, v in held if k not in ("serialization.format", "path") and "*" not in v}
        LogTable(self.spark, told["Location"]).generate(s.file_format, self.spark.table(name).schema, parts, given)
        return self.nothing()

    def insert(self, table: tuple[str, ...], rows: DataFrame, overwrite: bool = False) -> None:
        catalog, namespace, name = self.resolve(table, insert=True)
        log = catalog.log_table(namespace, name)
        if log is not None:
            (log.overwrite if overwrite else log.append)(rows)
        else:
            rows.write.insertInto(catalog.full(namespace, name), overwrite=overwrite)

    def save_as_table(self, rows: DataFrame, name: str, provider: str = "parquet", mode: str = "errorifexists", partitions: tuple[str, ...] = (), options: dict[str, str] | None = None) -> None:
        """A DataFrame as a table: mode is errorifexists, ignore, append or overwrite (which replaces the table)."""
        parts = Cursor(name).qualified()
        catalog, namespace, table = self.resolve(parts)
        there = catalog.table_exists(namespace, table)
        if there and mode == "ignore":
            return
        if there and mode == "append":
            self.insert((catalog.name, namespace, table), rows)
        elif there and mode != "overwrite":
            raise AlreadyExists(f"TABLE_OR_VIEW_ALREADY_EXISTS: {name}")
        elif provider in LOG_FORMATS:
            schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in rows.schema])
            catalog.create_log_table(namespace, table, schema, partitions, mode="replace" if there else "error", query=rows)
        else:
            writer = rows.write.format(native(self.spark, provider)).options(**(options or {})).mode(mode)
            (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(catalog.full(namespace, table))

    def _insert(self, s: st.Insert) -> DataFrame | None:
        catalog, namespace, name = self.resolve(s.table, insert=True)
        log = catalog.log_table(namespace, name)
        if log is None:
            if len(s.table) == 2 and catalog.name != SESSION:
                self.spark.sql(self._spark_insert(s, catalog.full(namespace, name)))
                return self.nothing()
            return None
        if s.if_not_exists:
            raise LogTableError("IF NOT EXISTS is not for inserts into log tables")
        snapshot, views = log.snapshot(), []
        try:
            rows = self._query(s.query, views)
            fixed = {k: v for k, v in s.partition if v is not None}
            names = snapshot.schema.fieldNames()
            by_name = {n.lower(): n for n in names}
            unknown = [k for k, _ in s.partition if k.lower() not in {c.lower() for c in snapshot.partition_columns}]
            if unknown:
                raise LogTableError(f"{unknown} are not partition columns of {snapshot.partition_columns}")
            both = {k.lower() for k in fixed} & {c.lower() for c in s.columns}
            if both:
                raise LogTableError(f"columns {sorted(both)} have a partition value and are listed too")
            if s.columns and not s.by_name:
                if len(rows.columns) != len(s.columns):
                    raise LogTableError(f"{len(rows.columns)} columns given for {s.columns}")
                rows = rows.toDF(*s.columns)
            elif not s.by_name and fixed:
                rows = rows.toDF(*[n for n in names if n.lower() not in {k.lower() for k in fixed}])
            rows = rows.select("*", *[F.expr(v).cast(snapshot.schema[by_name[k.lower()]].dataType).alias(by_name[k.lower()]) for k, v in fixed.items()])
            named = bool(s.columns or s.by_name or fixed)
            if not s.overwrite:
                log.append(rows, named)
            elif self.spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "dynamic" and snapshot.partition_columns:
                log.overwrite(rows, dynamic=True, by_name=named)
            else:
                values = {by_name[k.lower()]: self.spark.range(1).select(F.expr(v).cast("string")).first()[0] for k, v in fixed.items()}
                log.overwrite(rows, values, by_name=named)
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)
        return self.nothing()

    def _spark_insert(self, s: st.Insert, full: str) -> str:
        part = f" PARTITION ({', '.join(quoted(k) + (f' = {v}' if v is not None else '') for k, v in s.partition)})" if s.partition else ""
        columns = f" ({', '.join(map(quoted, s.columns))})" if s.columns else ""
        way = "OVERWRITE TABLE" if s.overwrite else "INTO"
        return f"INSERT {way} {full}{part}{' IF NOT EXISTS' if s.if_not_exists else ''}{' BY NAME' if s.by_name else ''}{columns} {self.rewrite(s.query)}"

    def _needed(self, table: tuple[str, ...]) -> LogTable:
        log = self.log_table(*table)
        if log is None:
            raise LogTableError(f"only log tables change rows, {'.'.join(table)} is none")
        return log

    def _merge(self, s: st.Merge) -> DataFrame:
        views: list[str] = []
        try:
            source = self._query(f"SELECT * FROM {s.source}", views)
            self._needed(s.table).merge(s, source)
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)
        return self.nothing()

    def _update(self, s: st.Update) -> DataFrame:
        self._needed(s.table).update(s.assignments, s.condition, s.alias)
        return self.nothing()

    def _delete(self, s: st.Delete) -> DataFrame:
        self._needed(s.table).delete(s.condition, s.alias)
        return self.nothing()

    # -- definitions ----------------------------------------------------------------------------

    def _definition(self, text: str) -> DataFrame | None:
        c = Cursor(text)
        if c.take("create"):
            replace = c.take("or", "replace")
            if c.take("table"):
                return self._create_table(text, c, replace)
            if c.take("view"):
                return self._create_view(text, c, replace)
            if c.take("database") or c.take("schema") or c.take("namespace"):
                return self._create_database(c)
            if c.take("catalog"):
                self.add_catalog(c.identifier())
                return self.nothing()
        elif c.take("drop"):
            if c.take("table") or c.take("view"):
                return self._drop(c)
            if c.take("database") or c.take("schema") or c.take("namespace"):
                there = c.take("if", "exists")
                name = c.qualified()
                if len(name) == 2 and name[0] in self.catalogs:
                    self.catalogs[name[0]].drop_namespace(name[1], c.take("cascade"), there)
                    return self.nothing()
        elif c.take("alter", "table"):
            return self._alter(c)
        elif c.take("show"):
            if (c.take("databases") or c.take("schemas") or c.take("namespaces")) and (c.take("in") or c.take("from")):
                name = c.identifier()
                if name in self.catalogs:
                    return self.spark.createDataFrame([(n,) for n in self.catalogs[name].list_namespaces()], "namespace string")
            elif c.take("partitions"):
                parts = c.qualified()
                log = self.log_table(*parts)
                if log is not None:
                    catalog, namespace, table = self.resolve(parts)
                    if not log.snapshot().partition_columns:
                        raise LogTableError(f"{'.'.join(parts)} has no partitions")
                    told = [("/".join(f"{k}={DEFAULT_PARTITION if v is None else v}" for k, v in p.items()),) for p in catalog.partitions(namespace, table)]
                    return self.spark.createDataFrame(told, "partition string")
            elif c.take("tables") and (c.take("in") or c.take("from")):
                name = c.qualified()
                if len(name) == 2 and name[0] in self.catalogs:
                    return self.spark.createDataFrame([(name[1], t) for t in self.catalogs[name[0]].list_tables(name[1])], "namespace string, tableName string")
        elif c.take("describe", "history") or c.take("desc", "history"):
            log = self._needed(c.qualified())
            return self.spark.createDataFrame([(h["version"], h["operation"]) for h in log.history()], "version long, operation string")
        return None

    def _create_database(self, c: Cursor) -> DataFrame | None:
        missing = c.take("if", "not", "exists")
        name = c.qualified()
        if len(name) > 2:
            raise ValueError(f"a namespace has one level, not {name[1:]}")
        if len(name) == 1 or name[0] not in self.catalogs:
            return None
        comment = location = properties = None
        while not c.end:
            if c.take("comment"):
                comment = c.string()
            elif c.take("location"):
                location = c.string()
            else:
                c.need("with")
                c.take("dbproperties") or c.take("properties")
                properties = st.options(c)
        self.catalogs[name[0]].create_namespace(name[1], missing, comment, location, properties)
        return self.nothing()

    def _create_table(self, text: str, c: Cursor, replace: bool) -> DataFrame | None:
        missing = c.take("if", "not", "exists")
        parts = c.qualified()
        columns = ""
        if c.sign("("):
            columns = c.until()
            c.need_sign(")")
        provider, opts, properties, partitions, location, comment, query = None, {}, {}, [], None, None, None
        while not c.end:
            if c.take("using"):
                provider = c.identifier().lower()
            elif c.take("options"):
                opts = st.options(c)
            elif c.take("tblproperties"):
                properties = st.options(c)
            elif c.take("partitioned", "by"):
                c.need_sign("(")
                partitions = [p.strip("` ") for p in split_top(c.until())]
                c.need_sign(")")
            elif c.take("location"):
                location = c.string()
            elif c.take("comment"):
                comment = c.string()
            elif c.looks("select") or c.looks("with") or c.take("as"):
                query = text[c.peek().start :]
                break
            else:
                return None
        catalog, namespace, table = self.resolve(parts)
        if provider not in (*LOG_FORMATS, "hive", "avro") and not replace:
            return None
        if provider in LOG_FORMATS:
            views: list[str] = []
            rows = self._query(query, views) if query else None
            schema = rows.schema if rows is not None else self._columns(columns) if columns else T.StructType([])
            if rows is not None:
                schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])
            catalog.create_log_table(namespace, table, schema, partitions, location, properties, comment, "replace" if replace else "ignore" if missing else "error", rows)
            return self.nothing()
        kind = for_hive(opts) if provider == "hive" else native(self.spark, provider or self.spark.conf.get("spark.sql.sources.default"))
        if replace and query and catalog.table_exists(namespace, table):  # the query may read what it replaces
            staged = workspace(self.spark, "replace")
            self._query(query, []).write.parquet(staged)
            query = f"SELECT * FROM parquet.{quoted(staged)}"
        if replace:
            catalog.drop_table(namespace, table, if_exists=True)
        own = {k: v for k, v in opts.items() if k.lower() != "fileformat"}
        pairs = lambda d: ", ".join(f"{_string(k)} = {_string(v)}" for k, v in d.items())
        self.spark.sql(
            f"CREATE TABLE {'IF NOT EXISTS ' if missing else ''}{catalog.full(namespace, table)} {f'({columns})' if columns else ''} USING {kind}"
            + (f" OPTIONS ({pairs(own)})" if own else "")
            + (f" PARTITIONED BY ({', '.join(map(quoted, partitions))})" if partitions else "")
            + (f" LOCATION {_string(location)}" if location else "")
            + (f" COMMENT {_string(comment)}" if comment else "")
            + (f" TBLPROPERTIES ({pairs(properties)})" if properties else "")
            + (f" AS {self.rewrite(query)}" if query else "")
        )
        return self.nothing()

    def _columns(self, text: str) -> T.StructType:
        """Column definitions of a log table; a DEFAULT is kept in the column's metadata."""
        out = []
        for part in _definitions(text):
            c = Cursor(part)
            at = k = None
            while not c.end:
                t = c.next()
                if t.is_word("default") and at is None:
                    at, k = t.start, t.stop
                elif at is not None and t.is_word("comment"):
                    break
            else:
                t = None
            rest = part[t.start :] if t is not None and at is not None else ""
            f = self.spark.createDataFrame([], f"{part[:at]} {rest}" if at is not None else part).schema[0]
            given = part[k : len(part) - len(rest)].strip() if at is not None else None
            out.append(T.StructField(f.name, f.dataType, f.nullable, dict(f.metadata) | ({DEFAULT_KEY: given} if given else {})))
        return T.StructType(out)

    def _add_columns(self, log: LogTable, text: str) -> None:
        """``path type [DEFAULT ..] [COMMENT ..] [FIRST | AFTER column]`` for each; a path may lead into structs."""
        for part in _definitions(text):
            c = Cursor(part)
            path = c.qualified()
            rest, first, after = part[c.peek().start :], False, None
            told = Cursor(rest).tokens
            if told[-1].is_word("first"):
                first, rest = True, rest[: told[-1].start]
            elif len(told) > 2 and told[-2].is_word("after"):
                after, rest = told[-1].name, rest[: told[-2].start]
            log.add_columns(list(self._columns(f"{quoted(path[-1])} {rest}")), path[:-1], first, after)

    def _create_view(self, text: str, c: Cursor, replace: bool) -> DataFrame | None:
        """A view over log tables is kept by its text and follows them; any other is Spark's own."""
        missing = c.take("if", "not", "exists")
        parts = c.qualified()
        names = []
        if c.sign("("):
            names = [Cursor(p).identifier() for p in split_top(c.until())]
            c.need_sign(")")
        c.until("as")
        c.need("as")
        query = text[c.peek().start :]
        views: list[str] = []
        try:
            self.rewrite(query, views)
            if not views:
                return None
            catalog, namespace, table = self.resolve(parts)
            if catalog.table_exists(namespace, table) and not replace:
                if missing:
                    return self.nothing()
                raise AlreadyExists(f"TABLE_OR_VIEW_ALREADY_EXISTS: {'.'.join(parts)}")
            rows = self._query(query, views)
            if names and len(names) != len(rows.columns):
                raise AnalysisException(f"{len(names)} names for {len(rows.columns)} columns")
            catalog.put_entry(namespace, table, {"view": query, "columns": names}, overwrite=replace)
        finally:
            for v in views:
                self.spark.catalog.dropTempView(v)
        return self.nothing()

    def _drop(self, c: Cursor) -> DataFrame | None:
        there = c.take("if", "exists")
        parts = c.qualified()
        catalog, namespace, table = self.resolve(parts)
        if catalog.entry(namespace, table) is None:
            return None
        catalog.drop_table(namespace, table, there)
        return self.nothing()

    def _alter(self, c: Cursor) -> DataFrame | None:
        parts = c.qualified()
        log = self.log_table(*parts)
        if log is None:
            return None
        catalog, namespace, table = self.resolve(parts)
        fields = lambda text: list(self.spark.createDataFrame([], text).schema)
        if c.take("rename", "to"):
            catalog.rename_table(namespace, table, c.qualified()[-1])
        elif c.take("rename", "column"):
            old = c.identifier()
            c.need("to")
            log.rename_column(old, c.identifier())
        elif c.take("add", "columns") or c.take("add", "column"):
            bracket = c.sign("(")
            self._add_columns(log, c.until())
            if bracket:
                c.need_sign(")")
        elif c.take("replace", "columns"):
            c.need_sign("(")
            log.replace_columns(fields(c.until()))
            c.need_sign(")")
        elif c.take("drop", "columns") or c.take("drop", "column"):
            bracket = c.sign("(")
            for name in split_top(c.until()):
                log.drop_column(*Cursor(name).qualified())
            if bracket:
                c.need_sign(")")
        elif c.take("alter", "column") or c.take("change", "column"):
            path = c.qualified()
            if c.take("type"):
                log.change_column(*path, data_type=fields(f"x {c.until()}")[0].dataType)
            elif c.take("comment"):
                log.change_column(*path, comment=c.string())
            elif c.take("drop", "not", "null"):
                log.change_column(*path, nullable=True)
            elif c.take("first"):
                log.change_column(*path, first=True)
            else:
                c.need("after")
                log.change_column(*path, after=c.identifier())
        elif c.take("set", "tblproperties"):
            log.set_properties(st.options(c))
        elif c.take("unset", "tblproperties"):
            c.take("if", "exists")
            c.need_sign("(")
            log.unset_properties([Cursor(p).string() for p in split_top(c.until())])
        elif c.take("set", "location"):
            catalog.set_location(namespace, table, c.string())
        elif c.take("add", "constraint"):
            name = c.identifier()
            c.need("check")
            c.need_sign("(")
            log.add_constraint(name, c.until())
            c.need_sign(")")
        elif c.take("drop", "constraint"):
            there = c.take("if", "exists")
            log.drop_constraint(c.identifier(), there)
        elif c.take("drop", "feature"):
            log.drop_feature(c.identifier())
        else:
            raise c.fail("a change of the table")
        return self.nothing()


def _definitions(text: str) -> list[str]:
    """Column definitions, split at the commas outside brackets of either kind."""
    out, depth, at = [], 0, 0
    for t in Cursor(text).tokens:
        if t.kind == "sign":
            depth += sum((c in "(<") - (c in ")>") for c in t.text)
            if t.text == "," and depth == 0:
                out.append(text[at : t.start].strip())
                at = t.stop
    return [*out, text[at:].strip()]
