"""One query for each statement and operator, with SQL that gives the same result."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import udfs
from tidemark.functions.partitions import typed
from tidemark.operators import joins
from tidemark.operators.log_table import LogTable, LogTableError
from tidemark.session import Lake
from tidemark.sources.files import workspace
from tidemark.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_numbers = itertools.count()


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


class Place:
    """The source tables as views, a folder for exports and a database of its own in catalog ``cat``."""

    def __init__(self, spark: SparkSession, sf_dir: str, database: bool = True):
        self.spark, self.sf_dir, self.dir = spark, sf_dir, workspace(spark, "query")
        self.lake = Lake(spark, ("cat",), warehouse=f"{self.dir}/warehouse")
        self.db = f"cat.q{next(_numbers)}_{uuid.uuid4().hex[:8]}"
        if database:
            self.lake.sql(f"create database {self.db}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str, df: DataFrame | None = None) -> str:
        temp = f"v_{name}_{uuid.uuid4().hex[:8]}"
        (self.read(name) if df is None else df).createOrReplaceTempView(temp)
        return temp

    def export(self, df: DataFrame, fmt: str, name: str = "export", parts: int | None = None, **options) -> str:
        path = f"{self.dir}/{name}"
        (df if parts is None else df.coalesce(parts)).write.format(fmt).options(**options).save(path)
        return path

    def sql(self, text: str) -> DataFrame:
        return self.lake.sql(text.replace("{db}", self.db))


ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


# -- COPY INTO ---------------------------------------------------------------------------------------


@query(f"SELECT {ORDER_COLUMNS} FROM orders")
def copy_into_csv(spark, sf_dir):
    p = Place(spark, sf_dir)
    path = p.export(p.read("orders"), "csv", header="true")
    p.sql(f"create table {{db}}.t ({ORDERS}) using parquet")
    p.sql(f"COPY INTO {{db}}.t FROM '{path}' FILEFORMAT = csv FORMAT_OPTIONS ('header' = 'true', 'inferSchema' = 'true')")
    return p.sql("select * from {db}.t")


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F'")
def copy_into_select(spark, sf_dir):
    p = Place(spark, sf_dir)
    path = p.export(p.read("orders"), "csv", header="true")
    p.sql("create table {db}.t (o_orderkey bigint, doubled double) using parquet")
    p.sql(f"copy into {{db}}.t from {{ select o_orderkey, o_totalprice * 2 from '{path}' where o_orderstatus = 'F' }} fileformat = csv format_options ('header' = 'true', 'inferSchema' = 'true')")
    return p.sql("select * from {db}.t")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 10")
def copy_into_files(spark, sf_dir):
    p = Place(spark, sf_dir)
    rows = p.read("customer").select("c_custkey", "c_name", "c_nationkey")
    path = p.export(rows.where("c_nationkey < 10").select("c_custkey", "c_name"), "json", "split/one")
    p.export(rows.where("c_nationkey >= 10").select("c_custkey", "c_name"), "json", "split/two")
    p.sql("create table {db}.t (c_custkey bigint, c_name string) using orc")
    p.sql(f"copy into {{db}}.t from '{path.removesuffix('/one')}' fileformat = json pattern = 't*' files = ('one')")
    return p.sql("select * from {db}.t")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey >= 10")
def copy_into_pattern(spark, sf_dir):
    p = Place(spark, sf_dir)
    rows = p.read("customer").select("c_custkey", "c_name", "c_nationkey")
    path = p.export(rows.where("c_nationkey < 10").select("c_custkey", "c_name"), "json", "split/one")
    p.export(rows.where("c_nationkey >= 10").select("c_custkey", "c_name"), "json", "split/two")
    p.sql("create table {db}.t (c_custkey bigint, c_name string) using parquet")
    p.sql(f"copy into {{db}}.t from '{path.removesuffix('/one')}' fileformat = json pattern = 'tw*'")
    return p.sql("select * from {db}.t")


def _copy(fmt: str, target: str):
    def run(spark, sf_dir):
        p = Place(spark, sf_dir)
        path = p.export(p.read("orders"), fmt)
        p.sql(f"create table {{db}}.t ({ORDERS}) using {target}")
        chosen = ", ".join(f"cast({c.split()[0]} as {c.split()[1]})" for c in ORDERS.split(", "))
        p.sql(f"copy into {{db}}.t from {{ select {chosen} from '{path}' }} fileformat = {fmt}")
        return p.sql("select * from {db}.t")

    run.__name__ = f"copy_into_{fmt}"
    return query(f"SELECT {ORDER_COLUMNS} FROM orders")(run)


copy_into_json, copy_into_orc, copy_into_parquet = _copy("json", "delta"), _copy("orc", "parquet"), _copy("parquet", "orc")


# -- tables, inserts, views, names -------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def insert_into(spark, sf_dir):
    p = Place(spark, sf_dir)
    n = p.view("nation")
    p.sql("create table {db}.t (n_nationkey int, n_name string, n_regionkey int) using json")
    p.sql(f"insert into {{db}}.t select * from {n}")
    p.sql(f"insert into {{db}}.t (n_regionkey, n_nationkey, n_name) select n_regionkey, n_nationkey + 100, upper(n_name) from {n} where n_regionkey = 1")
    return p.sql("select * from {db}.t")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def insert_overwrite(spark, sf_dir):
    p = Place(spark, sf_dir)
    n = p.view("nation")
    p.sql("create table {db}.t (n_nationkey int, n_name string) using csv options ('header' = 'true')")
    p.sql(f"insert into {{db}}.t select n_nationkey, n_name from {n}")
    p.sql(f"insert overwrite {{db}}.t select n_nationkey, n_name from {n} where n_regionkey = 2")
    return p.sql("select * from {db}.t")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT n_nationkey, 'new', 3 FROM nation WHERE n_regionkey = 0")
def insert_static_partition(spark, sf_dir):
    p = Place(spark, sf_dir)
    n = p.view("nation")
    p.sql("create table {db}.t (n_nationkey int, n_name string, n_regionkey int) using parquet partitioned by (n_regionkey)")
    p.sql(f"insert into {{db}}.t select * from {n}")
    p.sql(f"insert overwrite {{db}}.t partition (n_regionkey = 3) select n_nationkey, 'new' from {n} where n_regionkey = 0")
    return p.sql("select * from {db}.t")


def _ctas(fmt: str):
    def run(spark, sf_dir):
        p = Place(spark, sf_dir)
        c = p.view("customer")
        p.sql(f"create table {{db}}.t using {fmt} partitioned by (c_mktsegment) as select c_custkey, c_acctbal, c_mktsegment from {c}")
        return p.sql("select * from {db}.t where c_mktsegment <> 'BUILDING'")

    run.__name__ = f"ctas_{fmt}"
    return query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")(run)


ctas_parquet, ctas_orc, ctas_json, ctas_log = map(_ctas, ("parquet", "orc", "json", "delta"))


@query("SELECT r_regionkey, r_name FROM region")
def hive_csv_table(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql("create table {db}.t (r_regionkey int, r_name string) using hive options ('fileformat' = 'csv', 'header' = 'true')")
    p.sql(f"insert into {{db}}.t select * from {p.view('region')}")
    return p.sql("select * from {db}.t")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand")
def view_over_table(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using parquet as select * from {p.view('part')}")
    p.sql("create view {db}.v as select * from {db}.t where p_size > 10")
    return p.sql("select p_brand, count(*) as n from {db}.v group by p_brand")


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier")
def view_renamed_columns(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select s_suppkey, s_name from {p.view('supplier')}")
    p.sql("create view {db}.v (k, name) as select s_suppkey, s_name from {db}.t")
    return p.sql("select * from {db}.v")


@query("SELECT s_name FROM supplier WHERE s_acctbal > 0")
def view_projection(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using orc as select * from {p.view('supplier')}")
    p.sql("create view {db}.v as select s_name, s_acctbal from {db}.t")
    return p.sql("select s_name from {db}.v where s_acctbal > 0")


@query("SELECT n.n_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def three_part_join(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.customer using parquet as select * from {p.view('customer')}")
    p.sql(f"create table {{db}}.nation using delta as select * from {p.view('nation')}")
    return p.sql("select n.n_name, count(*) as customers from {db}.customer c join {db}.nation n on c.c_nationkey = n.n_nationkey group by n.n_name")


@query("SELECT * FROM (VALUES ('t', FALSE), ('v', TRUE)) AS x(name, is_view)")
def catalog_listing(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql("create table {db}.t (a int) using parquet")
    p.sql("create view {db}.v as select a from {db}.t")
    catalog, namespace = p.lake.catalogs["cat"], p.db.split(".")[1]
    views = catalog.list_views(namespace)
    return spark.createDataFrame([(t, t in views) for t in catalog.list_tables(namespace)], "name string, is_view boolean")


@query("SELECT 1 AS id")
def custom_source(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql("create table {db}.t (id int) using custom")
    p.sql("insert into {db}.t values (5)")
    return p.sql("select id from {db}.t")


# -- log tables --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity > 45")
def log_generate_scan(spark, sf_dir):
    p = Place(spark, sf_dir)
    path = p.export(p.read("lineitem"), "parquet")
    p.sql(f"GENERATE DELTALOG FOR LOCATION '{path}' USING parquet")
    p.sql(f"create table {{db}}.t using delta location '{path}'")
    return p.sql("select l_orderkey, l_linenumber, l_returnflag from {db}.t where l_quantity > 45")


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag")
def log_generate_partitioned(spark, sf_dir):
    p = Place(spark, sf_dir)
    path = f"{p.dir}/parts"
    p.read("lineitem").write.partitionBy("l_returnflag").orc(path)
    p.sql(f"generate deltalog for location '{path}' using orc")
    p.sql(f"create table {{db}}.t using delta location '{path}'")
    return p.sql("select l_returnflag, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from {db}.t where l_returnflag <> 'N' group by l_returnflag")


@query("SELECT DISTINCT l_returnflag AS flag FROM lineitem")
def log_partition_values(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta partitioned by (l_returnflag) as select l_orderkey, l_returnflag from {p.view('lineitem')}")
    found = p.lake.catalogs["cat"].partitions(p.db.split(".")[1], "t")
    return spark.createDataFrame([(f["l_returnflag"],) for f in found], "flag string")


@query("SELECT o_orderkey, o_orderpriority FROM orders UNION ALL SELECT -o_orderkey, 'again' FROM orders WHERE o_orderstatus = 'P'")
def log_append(spark, sf_dir):
    p = Place(spark, sf_dir)
    o = p.view("orders")
    p.sql(f"create table {{db}}.t using delta as select o_orderkey, o_orderpriority from {o}")
    p.sql(f"insert into {{db}}.t select -o_orderkey, 'again' from {o} where o_orderstatus = 'P'")
    return p.sql("select * from {db}.t")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -o_orderkey, 'P' FROM orders WHERE o_orderstatus = 'F'")
def log_overwrite_static(spark, sf_dir):
    p = Place(spark, sf_dir)
    o = p.view("orders")
    p.sql(f"create table {{db}}.t using delta partitioned by (o_orderstatus) as select o_orderkey, o_orderstatus from {o}")
    p.sql(f"insert overwrite {{db}}.t partition (o_orderstatus = 'P') select -o_orderkey from {o} where o_orderstatus = 'F'")
    return p.sql("select * from {db}.t")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT -o_orderkey, 'F' FROM orders WHERE o_orderstatus = 'F'")
def log_overwrite_dynamic(spark, sf_dir):
    p = Place(spark, sf_dir)
    o = p.view("orders")
    p.sql(f"create table {{db}}.t using delta partitioned by (o_orderstatus) as select o_orderkey, o_orderstatus from {o}")
    p.lake.log_table(*p.db.split("."), "t").overwrite(spark.sql(f"select -o_orderkey, o_orderstatus from {o} where o_orderstatus = 'F'"), dynamic=True)
    return p.sql("select * from {db}.t")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def log_update(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select c_custkey, c_acctbal from {p.view('customer')}")
    p.sql("update {db}.t set c_acctbal = 0 where c_acctbal < 0")
    return p.sql("select * from {db}.t")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal < 1000")
def log_delete(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select c_custkey, c_acctbal from {p.view('customer')}")
    p.sql("delete from {db}.t where c_acctbal < 1000")
    return p.sql("select * from {db}.t")


@query("""
    SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'merged' ELSE c_name END AS c_name FROM customer WHERE c_nationkey BETWEEN 2 AND 9 AND c_nationkey <> 4
    UNION ALL SELECT c_custkey + 1000000, 'added' FROM customer WHERE c_nationkey = 3""")
def merge_upsert(spark, sf_dir):
    p = Place(spark, sf_dir)
    c = p.view("customer")
    p.sql(f"create table {{db}}.t using delta as select c_custkey, c_name, c_nationkey from {c} where c_nationkey < 10")
    p.sql(
        f"merge into {{db}}.t as t using (select c_custkey k, c_nationkey n from {c} where c_nationkey in (3, 4) union all select c_custkey + 1000000, 3 from {c} where c_nationkey = 3) s on t.c_custkey = s.k "
        "when matched and s.n = 4 then delete when matched then update set c_name = 'merged' "
        "when not matched then insert (c_custkey, c_name, c_nationkey) values (s.k, 'added', s.n) when not matched by source and t.c_nationkey < 2 then delete"
    )
    return p.sql("select c_custkey, c_name from {db}.t")


@query("SELECT r_regionkey, r_name AS label, CAST(NULL AS INTEGER) AS added FROM region UNION ALL SELECT 99, 'late', 7")
def log_alter(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select * from {p.view('region')}")
    p.sql("alter table {db}.t rename column r_name to label")
    p.sql("alter table {db}.t add columns (added int)")
    p.sql("insert into {db}.t values (99, 'late', 7)")
    return p.sql("select * from {db}.t")


@query("SELECT 0 AS version, count(*) AS n FROM region UNION ALL SELECT 1, count(*) * 2 FROM region UNION ALL SELECT 2, 0")
def log_time_travel(spark, sf_dir):
    p = Place(spark, sf_dir)
    r = p.view("region")
    p.sql(f"create table {{db}}.t using delta as select * from {r}")
    p.sql(f"insert into {{db}}.t select * from {r}")
    p.sql("delete from {db}.t")
    log = p.lake.log_table(*p.db.split("."), "t")
    parts = [log.read(v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "n") for v in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('7', 'int'), ('3000000000', 'bigint'), ('1.5', 'double'), ('2024-02-03', 'date'), ('2024-02-03 04:05:06', 'timestamp'), ('x', 'string'), ('99999999999999999999', 'decimal(20,0)')) AS v(value, kind)")
def partition_inference(spark, sf_dir):
    values = ["7", "3000000000", "1.5", "2024-02-03", "2024-02-03 04:05:06", "x", "99999999999999999999"]
    return spark.createDataFrame([(v, typed(v)[0].simpleString()) for v in values], "value string, kind string")


# -- what Spark's engine resolves and runs ------------------------------------------------------------


def plain(name: str, sql: str, oracle: str | None = None) -> None:
    """A query through the facade over views of the tables; the same SQL is the oracle unless it is given."""

    def run(spark, sf_dir):
        p = Place(spark, sf_dir, database=False)
        text = sql
        for t in TABLES:
            if f"{{{t}}}" in sql:
                text = text.replace(f"{{{t}}}", p.view(t))
        return p.lake.sql(text)

    run.__name__ = name
    text = oracle or sql
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    query(text)(run)


plain("star_qualified", "select n.*, r.r_name from {nation} n join {region} r on n.n_regionkey = r.r_regionkey")
plain("star_struct", "select struct(r.*).r_name as name, hash(r.r_regionkey) is not null as hashed from {region} r", "select r_name as name, true as hashed from region")
plain("lateral_alias", "select o_orderkey, cast(o_totalprice * 100 as bigint) as cents, cents * 2 as doubled from {orders}", "select o_orderkey, cast(trunc(o_totalprice * 100) as bigint) as cents, cast(trunc(o_totalprice * 100) as bigint) * 2 as doubled from orders")
plain("aggregate_having", "select o_custkey, count(*) as n from {orders} group by o_custkey having count(*) > 12")
plain("correlated_exists", "select c_custkey from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")
plain("correlated_scalar", "select s_suppkey, (select count(*) from {customer} c where c.c_nationkey = s.s_nationkey) as n from {supplier} s")
plain("unpivot", "select n_nationkey, which, value from (select n_nationkey, n_regionkey, n_nationkey * 2 as twice from {nation}) unpivot (value for which in (n_regionkey, twice))", "select n_nationkey, 'n_regionkey' as which, n_regionkey as value from nation union all select n_nationkey, 'twice', n_nationkey * 2 from nation")
plain("lateral_explode", "select p_partkey, word from {part} lateral view explode(split(p_name, ' ')) w as word", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
plain("union_duplicate_columns", "select a, b from (select n_name as a, n_name as b from {nation} union all select r_name, r_name from {region})")
plain("order_by_hidden", "select c_name from {customer} order by c_acctbal desc, c_custkey limit 25")
plain("count_star", "select count(*) as n, count(distinct c_nationkey) as nations, count(case when c_acctbal < 0 then 1 end) as debtors from {customer}")
plain("nested_and_element", "select s.x as x, a[1] as second from (select named_struct('x', n_name) as s, array(n_nationkey, n_regionkey) as a from {nation})", "select n_name as x, n_regionkey as second from nation")
plain("higher_order", "select n_nationkey, aggregate(transform(sequence(1, n_regionkey + 1), x -> x * x), 0, (a, x) -> a + x) as squares from {nation}", "select n_nationkey, cast(list_sum(list_transform(range(1, n_regionkey + 2), lambda x: x * x)) as integer) as squares from nation")
plain("self_join", "select a.n_nationkey as a, b.n_nationkey as b from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
plain("join_left", "select c.c_custkey, o.o_orderkey from {customer} c left join {orders} o on c.c_custkey = o.o_custkey and o.o_totalprice > 300000")
plain("join_full", "select s.s_suppkey, c.c_custkey from {supplier} s full join {customer} c on s.s_suppkey = c.c_custkey")
plain("join_semi", "select c_custkey from {customer} left semi join {orders} on c_custkey = o_custkey", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
plain("join_anti", "select c_custkey from {customer} left anti join {orders} on c_custkey = o_custkey", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
plain("join_theta", "select a.r_name as a, b.r_name as b from {region} a join {region} b on a.r_regionkey < b.r_regionkey")
plain("grouping_rollup", "select l_returnflag, l_linestatus, grouping_id() as g, count(*) as n from {lineitem} group by rollup (l_returnflag, l_linestatus)", "select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as g, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
plain("grouping_cube", "select l_returnflag, l_linestatus, count(*) as n from {lineitem} group by cube (l_returnflag, l_linestatus)")
plain("grouping_sets", "select n_regionkey, n_name, count(*) as n from {nation} group by grouping sets ((n_regionkey), (n_name), ())")
plain("window_frames", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as last3, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from {orders}")
plain("window_rank", "select s_suppkey, rank() over (order by s_nationkey) as r, dense_rank() over (order by s_nationkey) as d, ntile(4) over (order by s_suppkey) as q from {supplier}")
plain("top_k", "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 10")
plain("set_operations", "(select c_nationkey as k from {customer} intersect select s_nationkey from {supplier}) union (select n_regionkey from {nation} except select s_nationkey from {supplier})")
plain("except_all", "select c_nationkey as k from {customer} except all select s_nationkey from {supplier}")
plain("string_functions", "select n_nationkey, upper(n_name) as u, length(n_name) as l, substring(n_name, 2, 3) as s, reverse(n_name) as r, concat_ws('-', n_name, 'x') as c, lpad(n_name, 12, '*') as p, replace(n_name, 'A', 'a') as t from {nation}")
plain("date_functions", "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, datediff(o_orderdate, date '2000-01-01') as d from {orders}", "select o_orderkey, cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast(date_diff('day', date '2000-01-01', cast(o_orderdate as date)) as integer) as d from orders")
plain("math_functions", "select p_partkey, abs(p_size - 25) as a, p_size % 7 as m, cast(floor(p_retailprice) as bigint) as f, greatest(p_size, 10) as g from {part}")
plain("json_functions", "select event_id, get_json_object(props, '$.k') as k from {events}", "select event_id, props ->> '$.k' as k from events")
plain("map_functions", "select r_regionkey, map_keys(map(r_name, r_regionkey))[0] as k, element_at(map(r_name, r_regionkey), r_name) as v from {region}", "select r_regionkey, r_name as k, r_regionkey as v from region")
plain("pricing_summary", "select l_returnflag, l_linestatus, cast(sum(l_quantity) as bigint) as quantity, count(*) as n, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents from {lineitem} where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus")
plain("default_names", "select current_database() is not null as d, current_date() = current_date as e, current_user() is not null as u", "select true as d, true as e, true as u")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def repartition_by_hidden(spark, sf_dir):
    p = Place(spark, sf_dir, database=False)
    return p.read("nation").repartition(3, "n_name").filter(F.col("n_name").isNotNull()).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, max(p.event_id) AS seen FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts = (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts) GROUP BY e.event_id")
def join_as_of(spark, sf_dir):
    e = Place(spark, sf_dir, database=False).read("events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["seen"], lambda t: F.date_trunc("day", t)).select("event_id", "seen")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 20 AND s_acctbal + 20")
def join_range(spark, sf_dir):
    p = Place(spark, sf_dir, database=False)
    ranges = p.read("supplier").select("s_suppkey", (F.col("s_acctbal") - 20).alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return joins.in_range(p.read("part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "low", "high", 50.0).select("p_partkey", "s_suppkey")


@query("SELECT n_nationkey, CAST(n_nationkey // 10 + n_nationkey % 10 AS BIGINT) AS digits FROM nation")
def udf_pandas(spark, sf_dir):
    n = Place(spark, sf_dir, database=False).read("nation")
    return n.select("n_nationkey", udfs.digit_sum(F.col("n_nationkey").cast("long")).alias("digits"))


@query("SELECT c_nationkey, count(*) AS n, max_by(c_name, c_custkey) AS last FROM customer GROUP BY c_nationkey")
def udf_grouped(spark, sf_dir):
    return udfs.running_per_group(Place(spark, sf_dir, database=False).read("customer"), "c_nationkey", "c_custkey", "c_name")


@query("SELECT k, count(c) AS n_left, count(s) AS n_right FROM (SELECT c_nationkey AS k, 1 AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, 1 FROM supplier) GROUP BY k")
def udf_cogrouped(spark, sf_dir):
    p = Place(spark, sf_dir, database=False)
    return udfs.cogrouped_counts(p.read("customer").withColumnRenamed("c_nationkey", "k"), p.read("supplier").withColumnRenamed("s_nationkey", "k"), "k")


@query("SELECT CAST(sum(length(p_name)) AS BIGINT) AS total FROM part")
def udf_batches(spark, sf_dir):
    return udfs.total_length(Place(spark, sf_dir, database=False).read("part"), "p_name")


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    stream = windows.events(spark, f"{sf_dir}/events.parquet").withColumn("start", F.date_trunc("day", "ts"))
    return windows.counted(stream, "stream-counts", ["event_type", "start"])


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return windows.drained(windows.tumbling(windows.events(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "stream-tumbling", "complete")


@query("SELECT event_type, t.start AS start, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) AS d FROM events) e, (VALUES (0), (1)) AS o(k), LATERAL (SELECT e.d - o.k * INTERVAL 1 DAY AS start) t GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    stream = windows.events(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.drained(windows.sliding(stream, "ts", "event_type"), "stream-sliding", "complete")


@query("SELECT event_type, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_type, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY event_type, s")
def stream_sessions(spark, sf_dir):
    stream = windows.events(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.drained(windows.sessions(stream, "ts", "event_type"), "stream-sessions", "complete")


@query("SELECT c_nationkey, CAST(sum(c_custkey * c_custkey % 9973) % 9973 AS BIGINT) AS c FROM customer GROUP BY c_nationkey")
def udaf_checksum(spark, sf_dir):
    return Place(spark, sf_dir, database=False).read("customer").groupBy("c_nationkey").agg(udfs.checksum("c_custkey").alias("c"))


@query("SELECT n_nationkey, CAST(i AS INTEGER) AS place, CAST(substr(CAST(n_nationkey AS VARCHAR), i, 1) AS INTEGER) AS digit FROM nation, generate_series(1, length(CAST(n_nationkey AS VARCHAR))) AS g(i)")
def udtf_digits(spark, sf_dir):
    p = Place(spark, sf_dir, database=False)
    spark.udtf.register("digits_of", udfs.Digits)
    return spark.sql(f"select n_nationkey, place, digit from {p.view('nation')}, lateral digits_of(n_nationkey)")


# -- the catalog --------------------------------------------------------------------------------------


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3")
def generate_for_table(spark, sf_dir):
    p = Place(spark, sf_dir)
    path = f"{p.dir}/t"
    p.sql(f"create table {{db}}.t (n_name string, n_regionkey int) using csv options ('header' = 'true') partitioned by (n_regionkey) location '{path}'")
    p.sql(f"insert into {{db}}.t select n_name, n_regionkey from {p.view('nation')}")
    p.sql("GENERATE DELTALOG FOR TABLE {db}.t USING csv")
    return LogTable(spark, path).read().where("n_regionkey < 3")


@query("SELECT * FROM (VALUES ('cat'), ('spark_catalog')) AS x(catalog)")
def show_catalogs(spark, sf_dir):
    return Place(spark, sf_dir, database=False).sql("SHOW CATALOGS;")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def temporary_view(spark, sf_dir):
    p = Place(spark, sf_dir, database=False)
    name = f"even_{uuid.uuid4().hex[:8]}"
    p.sql(f"create temporary view {name} as select n_nationkey from {p.view('nation')} where n_nationkey % 2 = 0")
    return p.sql(f"select * from {name}")


@query("SELECT * FROM (VALUES ('kept', TRUE, 'v')) AS x(namespace, there, property)")
def namespaces(spark, sf_dir):
    """Created, altered, listed, loaded and dropped ones."""
    p = Place(spark, sf_dir)
    cat, own = p.lake.catalogs["cat"], p.db.split(".")[1]
    p.sql("create database {db}_gone")
    cat.create_namespace(f"{own}_kept", properties={"k": "u"})
    cat.alter_namespace(f"{own}_kept", {"k": "v"})
    p.sql("drop database {db}_gone")
    told = "".join(cat.load_namespace(f"{own}_kept").values())
    listed = p.sql("show namespaces in cat").where(F.col("namespace").startswith(f"{own}_"))
    there = cat.namespace_exists(f"{own}_kept") and not cat.namespace_exists(f"{own}_gone")
    return listed.select(F.replace("namespace", F.lit(f"{own}_"), F.lit("")).alias("namespace"), F.lit(there).alias("there"), F.lit("v" if "(k,v)" in told else told).alias("property"))


@query("SELECT r_regionkey, r_name FROM region")
def table_renamed(spark, sf_dir):
    p = Place(spark, sf_dir)
    r = p.view("region")
    p.sql(f"create table {{db}}.a using delta as select * from {r}")
    p.sql(f"create table {{db}}.b using delta as select * from {r} where false")
    p.sql("drop table {db}.b")
    p.sql(f"alter table {{db}}.a rename to {p.db}.b")
    return p.sql("select * from {db}.b")


@query("SELECT count(*) AS n FROM supplier")
def registry_reopened(spark, sf_dir):
    """A log table is found by another session facade over the same warehouse."""
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select * from {p.view('supplier')}")
    return Lake(spark, ("cat",), warehouse=f"{p.dir}/warehouse").sql(f"select count(*) as n from {p.db}.t")


@query("SELECT n_nationkey AS id, n_name AS v FROM nation WHERE n_nationkey = 3")
def alias_is_no_table(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select n_nationkey as id, n_name as v from {p.view('nation')}")
    return p.sql("select o.id, o.v from {db}.t o where o.id = 3")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def one_part_name(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select * from {p.view('nation')}")
    before = spark.catalog.currentDatabase()
    p.sql("use {db}")
    try:
        return p.sql("select t.n_name from t where t.n_regionkey = 1")
    finally:
        spark.catalog.setCurrentDatabase(before)


# -- changes of log tables ----------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, 3 AS b, 'x' AS c FROM nation")
def column_default(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql("create table {db}.t (id int, b int default 3, c string default 'x') using delta")
    p.sql(f"insert into {{db}}.t (id, b) select n_nationkey, 9 from {p.view('nation')}")
    p.sql("update {db}.t set b = default")
    return p.sql("select * from {db}.t")


@query("SELECT 1 AS place, 'q' AS name UNION ALL SELECT 2, 'id' UNION ALL SELECT 3, 'p' UNION ALL SELECT 4, 's'")
def columns_in_place(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql("create table {db}.t (id int, s struct<a: int>) using delta")
    p.sql("alter table {db}.t add columns (p int after id, q string first, s.b int)")
    names = p.sql("select * from {db}.t").columns
    return spark.createDataFrame(list(enumerate(names, 1)), "place int, name string")


@query("SELECT DISTINCT 'n_regionkey=' || n_regionkey AS partition FROM nation")
def show_partitions(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta partitioned by (n_regionkey) as select n_name, n_regionkey from {p.view('nation')}")
    return p.sql("show partitions {db}.t")


@query("SELECT n_name, CAST(NULL AS BIGINT) AS extra FROM nation")
def log_columns_replaced(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql(f"create table {{db}}.t using delta as select n_nationkey, n_name, n_regionkey from {p.view('nation')}")
    p.sql("alter table {db}.t drop column n_regionkey")
    p.sql("alter table {db}.t replace columns (n_name string, extra bigint)")
    return p.sql("select * from {db}.t")


@query("SELECT * FROM (VALUES ('a', '1'), ('c', '3')) AS x(k, v)")
def log_properties(spark, sf_dir):
    p = Place(spark, sf_dir)
    p.sql("create table {db}.t (x int) using delta")
    p.sql("alter table {db}.t set tblproperties ('a' = '1', 'b' = '2', 'c' = '3')")
    p.sql("alter table {db}.t unset tblproperties ('b')")
    held = p.lake.log_table(*p.db.split("."), "t").snapshot().properties
    return spark.createDataFrame(sorted(held.items()), "k string, v string")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey > 3")
def log_constraint(spark, sf_dir):
    """Rows that break a rule are refused, those that do not are taken."""
    p = Place(spark, sf_dir)
    s = p.view("supplier")
    p.sql("create table {db}.t (s_suppkey bigint) using delta")
    p.sql("alter table {db}.t add constraint large check (s_suppkey > 3)")
    p.sql(f"insert into {{db}}.t select s_suppkey from {s} where s_suppkey > 3")
    try:
        p.sql(f"insert into {{db}}.t select s_suppkey from {s}")
    except Exception as e:  # noqa: BLE001
        if "breaks constraint" not in str(e):
            raise
    return p.sql("select * from {db}.t")


@query("SELECT r_regionkey FROM region WHERE r_regionkey > 2")
def log_location(spark, sf_dir):
    p = Place(spark, sf_dir)
    r = p.view("region")
    p.sql(f"create table {{db}}.a using delta as select r_regionkey from {r}")
    p.sql(f"create table {{db}}.b using delta as select r_regionkey from {r} where r_regionkey > 2")
    p.sql(f"alter table {{db}}.a set location '{p.lake.log_table(*p.db.split('.'), 'b').location}'")
    return p.sql("select * from {db}.a")


@query("SELECT n_name AS v FROM nation")
def log_replaced(spark, sf_dir):
    """IF NOT EXISTS leaves a table as it is, OR REPLACE does not."""
    p = Place(spark, sf_dir)
    n = p.view("nation")
    p.sql(f"create table {{db}}.t using delta as select n_nationkey as k from {n}")
    p.sql("create table if not exists {db}.t (other int) using delta")
    assert p.sql("select * from {db}.t").columns == ["k"]
    p.sql(f"create or replace table {{db}}.t using delta as select n_name as v from {n}")
    return p.sql("select * from {db}.t")


@query("SELECT CASE WHEN n_regionkey = 0 THEN NULL ELSE CAST(n_regionkey AS INTEGER) END AS p, count(*) AS n FROM nation GROUP BY 1")
def log_null_partition(spark, sf_dir):
    p = Place(spark, sf_dir)
    path = f"{p.dir}/t"
    p.read("nation").select("n_name", F.expr("nullif(n_regionkey, 0)").alias("p")).write.partitionBy("p").parquet(path)
    p.sql(f"generate deltalog for location '{path}' using parquet")
    return LogTable(spark, path).read().groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT 7 AS files, count(*) AS n FROM customer")
def log_file_count(spark, sf_dir):
    p = Place(spark, sf_dir)
    path = p.export(p.read("customer").repartition(7), "parquet")
    log = LogTable(spark, path)
    log.generate("parquet")
    return log.read().agg(F.lit(len(log.snapshot().files)).alias("files"), F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey + 10, r_name FROM region")
def save_as_table(spark, sf_dir):
    p = Place(spark, sf_dir)
    r = p.read("region")
    p.lake.save_as_table(r, f"{p.db}.t", "delta")
    p.lake.save_as_table(r.selectExpr("r_regionkey + 10", "r_name"), f"{p.db}.t", "delta", "append")
    p.lake.save_as_table(r, f"{p.db}.t", "delta", "ignore")
    return p.sql("select * from {db}.t")


@query("SELECT r_regionkey FROM region WHERE r_regionkey = 0")
def insert_if_not_exists_refused(spark, sf_dir):
    p = Place(spark, sf_dir)
    r = p.view("region")
    p.sql(f"create table {{db}}.t using delta partitioned by (r_regionkey) as select r_name, r_regionkey from {r} where r_regionkey = 0")
    try:
        p.sql(f"insert overwrite {{db}}.t partition (r_regionkey = 0) if not exists select 'x' from {r}")
    except LogTableError:
        return p.sql("select r_regionkey from {db}.t")
    raise AssertionError("it was not refused")


# -- names that a projection has left behind ----------------------------------------------------------

plain("aggregate_star", "select count(distinct *) as n from {nation}", "select count(*) as n from (select distinct * from nation)")
plain("case_insensitive", "select N_Name as n, T.n_NATIONKEY as k from {nation} t where N_REGIONKEY = 2", "select n_name as n, n_nationkey as k from nation where n_regionkey = 2")
plain("join_anti_rows", "select p_partkey from {part} left anti join (select * from {lineitem} where l_quantity > 45) l on p_partkey = l_partkey", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def filter_by_hidden(spark, sf_dir):
    n = Place(spark, sf_dir, database=False).read("nation")
    return n.select("n_name").filter(n["n_regionkey"] == 1)


@query("SELECT n_name FROM nation")
def repartition_by_missing(spark, sf_dir):
    n = Place(spark, sf_dir, database=False).read("nation")
    return n.select("n_name").repartition(3, n["n_regionkey"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to CSV, COPY INTO a table of catalog ``cat``, and totals by priority."""
    p = Place(spark, sf_dir)
    path = p.export(p.read("orders"), "csv", header="true")
    p.sql(f"create table {{db}}.orders ({ORDERS}) using parquet")
    p.sql(f"COPY INTO {{db}}.orders FROM '{path}' FILEFORMAT = csv FORMAT_OPTIONS ('header' = 'true', 'inferSchema' = 'true')")
    return p.sql("select o_orderpriority, count(*) as n, sum(cast(round(o_totalprice * 100) as bigint)) as cents from {db}.orders group by o_orderpriority")


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_orderpriority")
def copy_and_total(spark, sf_dir):
    return flagship(spark, sf_dir)
