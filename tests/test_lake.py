"""Ingestion, three-part names, views, log tables and the custom source, as the demo scenarios use them."""

import itertools

import pytest
from pyspark.errors import AnalysisException

from tidemark.functions.partitions import PartitionError
from tidemark.operators.catalog import AlreadyExists, NotFound
from tidemark.operators.log_table import LogTable, LogTableError
from tidemark.session import Lake
from tidemark.sources.formats import UnsupportedFormat

_n = itertools.count()


@pytest.fixture()
def lake(spark):
    return Lake(spark, ("cat", "other"))


@pytest.fixture()
def db(lake):
    name = f"d{next(_n)}"
    lake.sql(f"create database cat.{name}")
    yield f"cat.{name}"
    lake.sql(f"drop database if exists cat.{name} cascade")
    lake.spark.conf.unset("spark.insert.catalog")


@pytest.fixture()
def landing(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("id,name\n1,Ann\n2,Bob\n")
    (tmp_path / "in/2.csv").write_text("id,name\n3,Cleo\n4,Dan\n")
    return str(tmp_path / "in")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


FOUR = [("1", "Ann"), ("2", "Bob"), ("3", "Cleo"), ("4", "Dan")]


class TestCopy:
    def make(self, lake, db, fmt="parquet"):
        lake.sql(f"create table {db}.t (id string, name string) using {fmt}")

    def test_with_header(self, lake, db, landing):
        self.make(lake, db)
        out = lake.sql(f"COPY INTO {db}.t FROM '{landing}' FILEFORMAT = csv FORMAT_OPTIONS ('header' = 'true', 'delimiter' = ',')")
        assert out.columns == [] and out.count() == 0
        assert rows(lake.table(f"{db}.t")) == FOUR

    def test_without_options_headers_are_rows(self, lake, db, landing):
        self.make(lake, db)
        lake.sql(f"copy into {db}.t from '{landing}' fileformat = csv files = ('1.csv', '2.csv')")
        assert lake.table(f"{db}.t").count() == 6

    def test_files_go_before_pattern_and_repeats_add_rows(self, lake, db, landing):
        self.make(lake, db)
        for _ in range(2):
            lake.sql(f"copy into {db}.t from '{landing}' fileformat = csv pattern = '2*' files = ('1.csv') format_options ('header' = 'true')")
        assert rows(lake.table(f"{db}.t")) == sorted(FOUR[:2] * 2)

    def test_pattern_is_a_glob(self, lake, db, landing):
        self.make(lake, db)
        lake.sql(f"copy into {db}.t from '{landing}' fileformat = csv pattern = '[2-9].csv' format_options ('header' = 'false') copy_options ('header' = 'true')")
        assert rows(lake.table(f"{db}.t")) == FOUR[2:]

    def test_select(self, lake, db, landing):
        self.make(lake, db)
        for _ in range(2):
            lake.sql(f"copy into {db}.t from {{ select upper(name), id FROM '{landing}' where id > 2 }} fileformat = csv format_options ('header' = 'true');")
        assert rows(lake.table(f"{db}.t")) == [("CLEO", "3"), ("CLEO", "3"), ("DAN", "4"), ("DAN", "4")]

    def test_two_part_target_takes_the_insert_catalog(self, lake, db, landing):
        self.make(lake, db)
        lake.spark.conf.set("spark.insert.catalog", "cat")
        lake.sql(f"copy into {db.split('.')[1]}.t from '{landing}' fileformat = csv format_options ('header' = 'true')")
        lake.sql(f"insert into {db.split('.')[1]}.t values ('5', 'Eve')")
        assert rows(lake.table(f"{db}.t")) == [*FOUR, ("5", "Eve")]

    def test_into_a_log_table(self, lake, db, landing):
        self.make(lake, db, "delta")
        lake.sql(f"copy into {db}.t from '{landing}' fileformat = csv format_options ('header' = 'true')")
        assert rows(lake.table(f"{db}.t")) == FOUR

    def test_avro_says_what_is_missing(self, lake, db, landing):
        self.make(lake, db)
        with pytest.raises(UnsupportedFormat, match="avro"):
            lake.sql(f"copy into {db}.t from '{landing}' fileformat = avro")


class TestTables:
    @pytest.mark.parametrize("using", ["csv options ('header' = 'true')", "json", "orc", "parquet", "delta", "hive options ('fileformat' = 'csv')", "hive options ('fileformat' = 'orc')"])
    def test_round_trip_and_view(self, lake, db, using):
        lake.sql(f"create table {db}.t (col1 string) using {using}")
        lake.sql(f"insert into {db}.t values ('new_value')")
        assert rows(lake.sql(f"select * from {db}.t")) == [("new_value",)]
        lake.sql(f"create view {db}.v (c) as select col1 from {db}.t")
        assert lake.table(f"{db}.v").columns == ["c"]
        lake.sql(f"insert into {db}.t values ('b')")
        assert rows(lake.sql(f"select upper(c) u from {db}.v where c like 'n%'")) == [("NEW_VALUE",)]
        assert lake.sql(f"select count(*) n from {db}.v").first()[0] == 2

    def test_hive_needs_a_known_format(self, lake, db):
        with pytest.raises(UnsupportedFormat):
            lake.sql(f"create table {db}.t (a int) using hive")
        with pytest.raises(UnsupportedFormat):
            lake.sql(f"create table {db}.t (a int) using hive options ('fileformat' = 'nope')")

    def test_overwrite_and_static_partition(self, lake, db):
        lake.sql(f"create table {db}.t (a int, p string) using parquet partitioned by (p)")
        lake.sql(f"insert into {db}.t values (1, 'x'), (2, 'y')")
        lake.sql(f"insert into {db}.t partition (p = 'z') select 3")
        lake.sql(f"insert overwrite {db}.t partition (p = 'x') select 9")
        assert rows(lake.table(f"{db}.t")) == [(2, "y"), (3, "z"), (9, "x")]

    def test_ctas_keeps_partitions(self, lake, db):
        lake.sql(f"create table {db}.t using orc partitioned by (p) as select id, id % 2 p from range(4)")
        assert lake.catalogs["cat"].partitions(db.split(".")[1], "t") == [{"p": "0"}, {"p": "1"}]

    def test_errors_are_named(self, lake, db):
        with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_NOT_FOUND"):
            lake.table(f"{db}.none")
        lake.sql(f"create table {db}.t (a int) using parquet")
        lake.sql(f"create view {db}.v as select a from {db}.t")
        with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_ALREADY_EXISTS"):
            lake.sql(f"create view {db}.v as select a from {db}.t")
        lake.sql(f"create or replace view {db}.v as select a + 1 as b from {db}.t")
        assert lake.table(f"{db}.v").columns == ["b"]

    def test_two_catalogs_do_not_share(self, lake, db):
        name = db.split(".")[1]
        lake.sql(f"create database other.{name}")
        lake.sql(f"create table {db}.t using delta as select 1 a")
        lake.sql(f"create table other.{name}.t using parquet as select 2 a")
        assert rows(lake.sql(f"select x.a, y.a from {db}.t x, other.{name}.t y")) == [(1, 2)]
        lake.sql(f"drop database other.{name} cascade")
        assert rows(lake.table(f"{db}.t")) == [(1,)]

    def test_alias_and_column_are_no_table(self, lake, db):
        name = db.split(".")[1]
        lake.sql("create database if not exists o")
        try:
            lake.sql("create table o.id using delta as select 7 as x")
            lake.sql(f"create table {db}.t using delta as select 1 as id, 'a' as v")
            assert rows(lake.sql(f"select o.id from {db}.t o where o.id = 1")) == [(1,)]
            assert rows(lake.sql(f"select t.id, {db}.t.v from {db}.t where {db}.t.id > 0")) == [(1, "a")]
            assert rows(lake.sql("select id.x from o.id")) == [(7,)]
            lake.sql(f"use {db}")
            assert rows(lake.sql("select t.id from t")) == [(1,)]
            assert rows(lake.sql("with t as (select 5 as id) select * from t")) == [(5,)]
            lake.sql("use o")
            assert rows(lake.sql(f"select x, t.v from id, {db}.t")) == [(7, "a")]
        finally:
            lake.sql("use default")
            lake.catalogs["spark_catalog"].drop_namespace("o", cascade=True)
        assert name

    def test_names_in_subqueries_and_ctes(self, lake, db):
        lake.sql(f"create table {db}.t using delta as select id from range(5)")
        q = f"with w as (select id from {db}.t where id > (select min(id) from {db}.t)) select count(*) n from w where exists (select 1 from {db}.t t where t.id = w.id)"
        assert lake.sql(q).first()[0] == 4


    @pytest.mark.parametrize("provider", ["parquet", "csv", "delta"])
    def test_save_as_table(self, lake, db, provider):
        df = lake.spark.range(3).selectExpr("id", "id % 2 as p")
        for mode in ("errorifexists", "append", "ignore"):
            lake.save_as_table(df, f"{db}.t", provider, mode, ("p",))
        assert lake.table(f"{db}.t").count() == 6
        with pytest.raises(Exception, match="ALREADY_EXISTS"):
            lake.save_as_table(df, f"{db}.t", provider)
        lake.save_as_table(df, f"{db}.t", provider, "overwrite")
        assert lake.table(f"{db}.t").count() == 3

    def test_replacement_may_read_what_it_replaces(self, lake, db):
        lake.sql(f"create table {db}.t using parquet as select 1 a")
        lake.sql(f"create or replace table {db}.t using orc as select a + 1 as a from {db}.t")
        assert rows(lake.table(f"{db}.t")) == [(2,)]


class TestCatalog:
    def test_namespaces(self, lake, db):
        cat, name = lake.catalogs["cat"], db.split(".")[1]
        assert name in cat.list_namespaces() and cat.list_namespaces((name,)) == []
        assert cat.load_namespace(name)["Location"].endswith(f"cat.cat/{name}.db")
        with pytest.raises(AlreadyExists):
            cat.create_namespace(name)
        with pytest.raises(NotFound):
            cat.list_namespaces(("nope",))
        with pytest.raises(ValueError, match="one level"):
            lake.sql("create database cat.a.b")
        lake.sql(f"create table {db}.t (a int) using delta")
        with pytest.raises(ValueError, match="SCHEMA_NOT_EMPTY"):
            lake.sql(f"drop database {db}")
        assert ("cat",) in rows(lake.sql("show catalogs"))

    def test_tables(self, lake, db):
        cat, name = lake.catalogs["cat"], db.split(".")[1]
        lake.sql(f"create table {db}.a using parquet as select 1 x")
        lake.sql(f"create table {db}.b using delta as select 1 x")
        lake.sql(f"create view {db}.v as select x from {db}.a")
        lake.sql(f"create view {db}.w as select x from {db}.b")
        assert cat.list_tables(name) == ["a", "b", "v", "w"] and cat.list_views(name) == ["v", "w"]
        assert rows(lake.sql(f"show tables in {db}")) == [(name, t) for t in "abvw"]
        cat.rename_table(name, "b", "c")
        assert cat.table_exists(name, "c") and not cat.table_exists(name, "b")
        assert cat.drop_table(name, "c") and not cat.drop_table(name, "c", if_exists=True)
        with pytest.raises(NotFound):
            cat.drop_table(name, "c")
        assert Lake(lake.spark, ("cat",)).catalogs["cat"].list_views(name) == ["v", "w"]

    def test_partitions(self, lake, db):
        cat, name = lake.catalogs["cat"], db.split(".")[1]
        lake.sql(f"create table {db}.t (a int, p string) using parquet partitioned by (p)")
        cat.add_partition(name, "t", {"p": "x"})
        cat.rename_partition(name, "t", {"p": "x"}, {"p": "y"})
        assert cat.partitions(name, "t") == [{"p": "y"}]
        cat.drop_partition(name, "t", {"p": "y"})
        assert cat.partitions(name, "t") == []


class TestGenerate:
    @pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
    def test_location_in_place(self, spark, lake, tmp_path, fmt):
        path = str(tmp_path / "t")
        spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, name string").write.format(fmt).options(header="true").partitionBy("name").save(path)
        lake.sql(f"GENERATE DELTALOG FOR LOCATION '{path}' USING {fmt}")
        t = LogTable(spark, path)
        s = t.snapshot()
        assert (s.provider, s.partition_columns, len(s.files)) == (fmt, ["name"], 3)
        assert sorted(str(f["partitionValues"]["name"]) for f in s.files.values()) == ["None", "a", "b"]
        assert rows(t.read().select("id", "name")) == [("1", "a"), ("2", "b"), ("3", None)]
        assert t.history()[0]["metrics"] == {"numFiles": "3"}
        with pytest.raises(LogTableError, match="has a log"):
            t.generate(fmt)

    def test_table_with_its_schema(self, spark, lake, db, tmp_path):
        path = str(tmp_path / "t")
        lake.sql(f"create table {db}.t (id int, p int) using csv options ('header' = 'true') partitioned by (p) location '{path}'")
        lake.sql(f"insert into {db}.t values (1, 7), (2, 8)")
        lake.sql(f"generate deltalog for table {db}.t using csv")
        t = LogTable(spark, path)
        assert t.snapshot().schema.simpleString() == "struct<id:int,p:int>" and rows(t.read()) == [(1, 7), (2, 8)]
        with pytest.raises(NotFound):
            lake.sql(f"generate deltalog for table {db}.none using csv")

    def test_directories_must_agree(self, spark, tmp_path):
        for d in ("a=1", "b=2"):
            spark.range(1).write.parquet(str(tmp_path / "t" / d))
        with pytest.raises((PartitionError, AnalysisException, Exception)):
            LogTable(spark, str(tmp_path / "t")).generate("parquet")


class TestLogTables:
    @pytest.fixture()
    def t(self, lake, db):
        lake.sql(f"create table {db}.t (id int, v string, p string) using delta partitioned by (p)")
        lake.sql(f"insert into {db}.t values (1, 'a', 'x'), (2, 'b', 'x'), (3, 'c', 'y'), (4, 'd', null)")
        return f"{db}.t"

    def test_time_travel_and_files_elsewhere(self, lake, t):
        log = lake.log_table(*t.split("."))
        lake.sql(f"insert into {t} (id, p) values (5, 'odd value/=')")
        assert rows(lake.sql(f"select id from {t} where p = 'odd value/='")) == [(5,)]
        assert log.read(1).count() == 4 and log.read().count() == 5
        lake.sql(f"delete from {t} where id = 5")
        assert rows(lake.sql(f"select id from {t}")) == [(1,), (2,), (3,), (4,)]

    def test_commits_are_seen_whole_or_not_at_all(self, lake, t, monkeypatch):
        log = lake.log_table(*t.split("."))
        folder = f"{log.location}/_delta_log"
        before = [n for n in log.files.names(folder) if not n.startswith(".")]

        def broken():
            yield {"remove": {"path": "x"}}
            raise RuntimeError("the writer dies")

        with pytest.raises(RuntimeError):
            log.commit(log.versions()[-1] + 1, "WRITE", broken())
        assert [n for n in log.files.names(folder) if not n.startswith(".")] == before
        with pytest.raises(FileExistsError):
            log.commit(log.versions()[-1], "WRITE", [])
        assert log.read().count() == 4

    def test_defaults(self, lake, db):
        lake.sql(f"create table {db}.d (id int, b int default 3 comment 'x, y', c string default 'a, b') using delta")
        lake.sql(f"insert into {db}.d (id) values (1)")
        lake.sql(f"insert into {db}.d values (2, 5, null)")
        assert rows(lake.table(f"{db}.d")) == [(1, 3, "a, b"), (2, 5, None)]
        lake.sql(f"update {db}.d set b = default where id = 2")
        lake.sql(f"merge into {db}.d t using (select 1 as id union all select 9) s on t.id = s.id when matched then update set c = default when not matched then insert (id, b) values (s.id, default)")
        assert rows(lake.table(f"{db}.d")) == [(1, 3, "a, b"), (2, 3, None), (9, 3, "a, b")]

    def test_columns_are_added_in_their_place(self, lake, db):
        lake.sql(f"create table {db}.n (id int, s struct<a: int, z: int>) using delta")
        lake.sql(f"alter table {db}.n add columns (q int after id, p string first, s.b int after a)")
        assert lake.table(f"{db}.n").schema.simpleString() == "struct<p:string,id:int,q:int,s:struct<a:int,b:int,z:int>>"

    def test_show_partitions(self, lake, t, db):
        assert rows(lake.sql(f"show partitions {t}")) == [("p=__HIVE_DEFAULT_PARTITION__",), ("p=x",), ("p=y",)]
        lake.sql(f"create table {db}.w (a int) using delta")
        with pytest.raises(LogTableError, match="no partitions"):
            lake.sql(f"show partitions {db}.w")

    def test_overwrites(self, lake, t):
        lake.sql(f"insert overwrite {t} partition (p = 'x') select 9, 'z'")
        assert rows(lake.sql(f"select id from {t}")) == [(3,), (4,), (9,)]
        lake.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            lake.sql(f"insert overwrite {t} values (8, 'y', 'y')")
        finally:
            lake.spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        assert rows(lake.sql(f"select id from {t}")) == [(4,), (8,), (9,)]
        lake.sql(f"insert overwrite {t} values (1, 'q', 'q')")
        assert rows(lake.sql(f"select id from {t}")) == [(1,)]
        with pytest.raises(LogTableError):
            lake.sql(f"insert into {t} partition (p = 'x') if not exists select 9, 'z'")
        with pytest.raises(LogTableError):
            lake.sql(f"insert into {t} partition (p = 'x') (id, p) select 9, 'z'")

    def test_update_and_delete_rewrite_touched_files_only(self, lake, t):
        log = lake.log_table(*t.split("."))
        before = set(log.snapshot().files)
        lake.sql(f"update {t} set v = concat(v, '!'), id = id * 10 where p = 'x' and id = 2")
        assert rows(lake.sql(f"select id, v from {t}")) == [(1, "a"), (20, "b!"), (3, "c"), (4, "d")]
        assert len(before & set(log.snapshot().files)) >= 2
        lake.sql(f"delete from {t} where p is null")
        lake.sql(f"delete from {t} where id > 100")
        assert rows(lake.sql(f"select id from {t}")) == [(1,), (20,), (3,)]
        lake.sql(f"delete from {t}")
        assert lake.table(t).count() == 0

    def test_merge(self, lake, t):
        lake.sql(f"merge into {t} t using (select * from values (1, 'A', 'x'), (2, 'del', 'x'), (7, 'new', 'n') s(id, v, p)) s on t.id = s.id when matched and s.v = 'del' then delete when matched then update set v = lower(s.v) || t.v when not matched and s.id > 5 then insert * when not matched by source and t.p = 'y' then update set v = 'orphan'")
        assert rows(lake.table(t)) == [(1, "aa", "x"), (3, "orphan", "y"), (4, "d", None), (7, "new", "n")]
        lake.sql(f"merge into {t} using (select 1 id, 'B' v, 'w' p) s on t.id = s.id when matched then update set *")
        assert (1, "B", "w") in rows(lake.table(t))
        lake.sql(f"merge into {t} using (select 50 id) s on t.id = s.id when not matched then insert (id, v) values (s.id, 'only')")
        assert (50, "only", None) in rows(lake.table(t))

    def test_merge_refuses_two_sources_for_one_row(self, lake, t):
        with pytest.raises(LogTableError, match="several"):
            lake.sql(f"merge into {t} t using (select 1 id, explode(array('a', 'b')) v) s on t.id = s.id when matched then update set v = s.v")
        lake.sql(f"merge into {t} t using (select 1 id, explode(array('u', 'b')) v) s on t.id = s.id when matched and s.v = 'u' then update set v = s.v")
        assert rows(lake.sql(f"select v from {t} where id = 1")) == [("u",)]

    def test_alter(self, lake, t):
        log = lake.log_table(*t.split("."))
        lake.sql(f"alter table {t} add columns (n int, s struct<a: int>)")
        lake.sql(f"insert into {t} values (9, 'n', 'x', 5, named_struct('a', 1))")
        assert rows(lake.sql(f"select n, s.a from {t} where id in (1, 9)")) == [(5, 1), (None, None)]
        lake.sql(f"alter table {t} alter column n type bigint")
        lake.sql(f"alter table {t} rename column v to w")
        assert rows(lake.sql(f"select w from {t} where id = 9")) == [("n",)]
        lake.sql(f"alter table {t} drop column s")
        lake.sql(f"alter table {t} alter column n first")
        lake.sql(f"alter table {t} alter column w comment 'words'")
        lake.sql(f"alter table {t} set tblproperties ('k' = 'v')")
        s = log.snapshot()
        assert s.schema.names == ["n", "id", "w", "p"] and s.properties == {"k": "v"} and s.schema["w"].metadata == {"comment": "words"}
        lake.sql(f"alter table {t} unset tblproperties if exists ('k', 'none')")
        lake.sql(f"alter table {t} add constraint positive check (id > 0)")
        with pytest.raises(Exception, match="positive"):
            lake.sql(f"insert into {t} values (1, -1, 'w', 'x')")
        with pytest.raises(LogTableError):
            lake.sql(f"alter table {t} add constraint small check (id < 3)")
        lake.sql(f"alter table {t} drop constraint positive")
        lake.sql(f"insert into {t} values (1, -1, 'w', 'x')")
        for bad in ("drop column p", "drop column none", "add columns (id int)", "alter column id type string", "drop feature x"):
            with pytest.raises(LogTableError):
                lake.sql(f"alter table {t} {bad}")
        log.add_columns([log.snapshot().schema["n"].__class__("m", log.snapshot().schema["n"].dataType)], after="id")
        lake.sql(f"alter table {t} replace columns (id int, p string, fresh string)")
        assert lake.table(t).columns == ["id", "p", "fresh"]

    def test_create_modes(self, lake, db, t, tmp_path):
        with pytest.raises(AlreadyExists):
            lake.sql(f"create table {t} (a int) using delta")
        lake.sql(f"create table if not exists {t} (a int) using delta")
        lake.sql(f"create or replace table {t} using delta as select 1 z")
        assert rows(lake.table(t)) == [(1,)] and lake.log_table(*t.split(".")).read(1).count() == 4
        with pytest.raises(LogTableError, match="schema"):
            lake.sql(f"create table {db}.e using delta")
        (tmp_path / "full").mkdir()
        (tmp_path / "full/x").write_text("x")
        with pytest.raises(LogTableError, match="empty"):
            lake.sql(f"create table {db}.e (a int) using delta location '{tmp_path}/full'")
        lake.sql(f"create table {db}.e (a int) using delta location '{tmp_path}/e'")
        lake.sql(f"insert into {db}.e values (4)")
        lake.sql(f"drop table {db}.e")
        lake.sql(f"create table {db}.e (a int) using delta location '{tmp_path}/e'")
        assert rows(lake.table(f"{db}.e")) == [(4,)]

    def test_only_one_writer_gets_a_version(self, lake, t):
        log = lake.log_table(*t.split("."))
        with pytest.raises(FileExistsError):
            log.commit(log.snapshot().version, "WRITE", [])

    def test_row_changes_need_a_log(self, lake, db):
        lake.sql(f"create table {db}.p (a int) using parquet")
        with pytest.raises(LogTableError, match="only log tables"):
            lake.sql(f"update {db}.p set a = 1")

    def test_filters_reach_the_scan(self, lake, t):
        plan = lake.sql(f"select id from {t} where p = 'x' and id > 1")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(p" in plan and "GreaterThan(id,1)" in plan


def test_custom_source(lake, db):
    lake.sql(f"create table {db}.c (id int) using custom")
    assert rows(lake.sql(f"select * from {db}.c where id = 1")) == [(1,)]
    lake.sql(f"insert into {db}.c values (5), (6)")
    assert rows(lake.table(f"{db}.c")) == [(1,)]
