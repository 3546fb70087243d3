"""Arrow-batched functions for what built-in functions cannot say, and grouped work in pandas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


@F.pandas_udf(LongType())
def digit_sum(values: pd.Series) -> pd.Series:
    """The sum of a whole number's decimal digits."""
    left, out = values.abs(), values * 0
    while (left > 0).any():
        out, left = out + left % 10, left // 10
    return out


def running_per_group(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, n, last): rows and last value by order of each group, in pandas; groups must fit a task's memory."""
    kind, value_kind = (df.schema[c].dataType.simpleString() for c in (group, value))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [len(pdf)], "last": [pdf[value].iloc[-1]]})

    return df.select(group, order, value).groupBy(group).applyInPandas(work, f"{group} {kind}, n long, last {value_kind}")


def cogrouped_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right): rows of each side by key, counted group by group."""
    kind = left.schema[key].dataType.simpleString()

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [(a if len(a) else b)[key].iloc[0]], "n_left": [len(a)], "n_right": [len(b)]})

    return left.select(key).groupBy(key).cogroup(right.select(key).groupBy(key)).applyInPandas(work, f"{key} {kind}, n_left long, n_right long")


def total_length(df: DataFrame, column: str) -> DataFrame:
    """One row a batch task with its total text length, by ``mapInPandas``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"total": [int(f[column].str.len().sum())]})

    return df.select(column).mapInPandas(work, "total long").groupBy().agg(F.sum("total").alias("total"))


@F.pandas_udf(LongType())
def checksum(values: pd.Series) -> int:
    """An aggregate: the sum of squares modulo 9973."""
    return int((values.astype("int64") ** 2 % 9973).sum() % 9973)


@F.udtf(returnType="place int, digit int")
class Digits:
    """A table function: the decimal digits of a whole number, from the left."""

    def eval(self, value: int):
        for place, digit in enumerate(str(abs(value)), 1):
            yield place, int(digit)
