import datetime

import pytest
from pyspark.sql import types as T

from tidemark.functions.partitions import DEFAULT_PARTITION, PartitionError, columns_of, path_values, segment, split_schema, typed


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("7", T.IntegerType(), 7),
        ("3000000000", T.LongType(), 3000000000),
        ("99999999999999999999", T.DecimalType(20, 0), 99999999999999999999),
        ("1.5", T.DoubleType(), 1.5),
        ("2024-02-03 04:05:06", T.TimestampType(), datetime.datetime(2024, 2, 3, 4, 5, 6)),
        ("2024-02-03", T.DateType(), datetime.date(2024, 2, 3)),
        (DEFAULT_PARTITION, T.NullType(), None),
        ("2024-99-99", T.StringType(), "2024-99-99"),
        ("x", T.StringType(), "x"),
    ],
)
def test_typed(text, kind, value):
    assert typed(text) == (kind, value)


def test_typed_without_inference():
    assert typed("7", infer=False) == (T.StringType(), "7")


def test_segments():
    assert segment("a=b%2Fc") == ("a", "b/c")
    assert segment("plain") is None
    for bad in ("=x", "x="):
        with pytest.raises(PartitionError):
            segment(bad)


def test_paths():
    assert path_values("x/a=1/b=2/f.csv") == [("a", "1"), ("b", "2")]
    assert path_values("a=1/plain/b=2/f.csv") == [("b", "2")]
    assert path_values("a=1/_temporary/0/f.csv") == []
    assert columns_of(["a=1/f", "a=2/g"]) == ["a"]
    with pytest.raises(PartitionError):
        columns_of(["a=1/f", "b=2/g"])


def test_split_schema_ignores_case_and_names_what_is_missing():
    schema = T.StructType([T.StructField("A", T.IntegerType()), T.StructField("b", T.StringType())])
    data, parts = split_schema(schema, ["a"])
    assert (data.names, parts.names) == (["b"], ["A"])
    with pytest.raises(PartitionError):
        split_schema(schema, ["z"])
