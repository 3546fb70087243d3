"""The grammar of our own statements, rule by rule."""

import pytest

from tidemark.plans import statements as st
from tidemark.plans.namespace import rewritten
from tidemark.plans.tokens import SqlSyntaxError


def test_copy_needs_only_location_and_format():
    s = st.parse("copy into db.t from '/data/x y' fileformat = csv")
    assert s == st.CopyInto(("db", "t"), "/data/x y", "csv")


def test_copy_in_any_case_with_semicolon_and_free_space():
    assert st.parse("COPY\n INTO  db.t FROM '/p' FileFormat=PARQUET ;") == st.CopyInto(("db", "t"), "/p", "parquet")


def test_copy_with_all_clauses():
    s = st.parse("copy into c.d.t from '/p' fileformat = csv pattern = '*.csv' files = ('a.csv', 'b.csv') format_options ('header' = 'true', 'sep' = ' ', nested.key = 5) copy_options (force = true)")
    assert (s.pattern, s.files) == ("*.csv", ("a.csv", "b.csv"))
    assert s.format_options == {"header": "true", "sep": " ", "nested.key": "5"}
    assert s.copy_options == {"force": "true"}


def test_copy_select_may_hold_from_in_names_and_a_condition():
    s = st.parse("copy into d.t from { SELECT from_id, extract(year FROM ts) y FROM '/a b/c' WHERE x > 1 GROUP BY 1, 2 } fileformat = json")
    assert (s.select, s.location, s.rest) == ("from_id, extract(year FROM ts) y", "/a b/c", "WHERE x > 1 GROUP BY 1, 2")


@pytest.mark.parametrize("sql", ["copy into t from '/p' fileformat = csv", "copy into d.t from '/p'", "copy into d.t from p fileformat = csv", "copy into d.t from '/p' fileformat = csv files = ('a') pattern = 'b'", "generate deltalog for db.t using csv", "generate deltalog for location '/p'"])
def test_refused(sql):
    with pytest.raises(SqlSyntaxError):
        st.parse(sql)


def test_generate():
    assert st.parse("Generate DeltaLog for table a.b using ORC") == st.GenerateLog("orc", ("a", "b"))
    assert st.parse("generate deltalog for location '/p/q' using csv;") == st.GenerateLog("csv", None, "/p/q")


def test_names_with_dashes_and_quotes():
    assert st.parse("copy into my-db.`odd name` from '/p' fileformat = csv").table == ("my-db", "odd name")


def test_spark_statements_are_left_alone():
    assert st.parse("select 'copy into d.t' from x") is None
    assert st.parse("SHOW CATALOGS") == st.ShowCatalogs()


def test_merge_clauses():
    m = st.parse("merge into c.d.t as t using (select 1 id, 'x' v) s on t.id = s.id when matched and s.v = 'd' then delete when matched then update set t.v = s.v, n = n + 1 when not matched then insert (id, v) values (s.id, coalesce(s.v, '-')) when not matched by source then delete")
    assert [(k.kind, k.action, k.condition) for k in m.clauses] == [("matched", "delete", "s.v = 'd'"), ("matched", "update", None), ("absent", "insert", None), ("orphan", "delete", None)]
    assert m.clauses[1].columns == ("v", "n") and m.clauses[2].values == ("s.id", "coalesce(s.v, '-')")
    with pytest.raises(SqlSyntaxError):
        st.parse("merge into d.t using s on true when matched then insert *")


def test_names_are_rewritten_outside_strings_and_comments():
    sql = "select cat.db.t.c, 'cat.db.t' -- cat.db.t\nfrom cat.db.t join x.y /* cat.a.b */ on exists (select 1 from cat.e.f)"
    assert rewritten(sql, {"cat"}) == "select `cat__db`.t.c, 'cat.db.t' -- cat.db.t\nfrom `cat__db`.t join x.y /* cat.a.b */ on exists (select 1 from `cat__e`.f)"
