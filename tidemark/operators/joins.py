"""Joins that Spark has no operator for, without pairing rows that cannot match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the right side's values at the latest time not after its own (null if there is none).

    Both sides go through one sort by key and time, and a window carries the last right row on; no pair
    of rows is ever made. At one time, right rows come first; of several, that with the greatest values counts.
    A null time is neither before nor after any other: such left rows get nulls, such right rows don't count.

    ``bucket`` is a function of the time that never falls, such as ``lambda t: F.date_trunc("day", t)``. With it the
    rows of a key are sorted bucket by bucket, in as many tasks: the last right row of each bucket is aggregated
    before it is shuffled, and a window over these few rows tells what a bucket starts with.
    """
    carried, right = F.struct(*values), right.where(F.col(time).isNotNull())
    nothing = F.lit(None).cast(right.select(carried.alias("x")).schema[0].dataType)
    part = (bucket(F.col(time)) if bucket else F.lit(0)).alias("bucket__")
    a = left.select(*by, time, part, F.struct(*left.columns).alias("row"), nothing.alias("seen"), F.lit(1).alias("side"))
    no_row = F.lit(None).cast(a.schema["row"].dataType).alias("row")
    rows = a.unionByName(right.select(*by, time, part, no_row, carried.alias("seen"), F.lit(0).alias("side")))
    keys = [*by, "bucket__"]
    if bucket:
        last = right.groupBy(*by, part).agg(F.max(F.struct(F.col(time).alias("t"), carried.alias("seen")))["seen"].alias("seen"))
        ends = a.select(*keys).distinct().select(*keys, nothing.alias("seen")).unionByName(last).groupBy(*keys).agg(F.max("seen").alias("seen"))
        before = Window.partitionBy(*by).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.select(*keys, F.last("seen", ignorenulls=True).over(before).alias("seen")).where("seen IS NOT NULL")
        no_time = F.lit(None).cast(a.schema[time].dataType).alias(time)
        rows = rows.unionByName(starts.select(*keys, no_time, no_row, "seen", F.lit(-1).alias("side")))
    order = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_first(), "side", "seen").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col(time).isNotNull(), F.last("seen", ignorenulls=True).over(order))
    both = rows.withColumn("seen", seen).where("side = 1")
    return both.select("row.*", *[F.col("seen")[v].alias(v) for v in values])


#: Of a range join: pairs to look at in a cell and in a task, rows of one side in a cell, rows of both sides in a task.
CELL_PAIRS, TASK_PAIRS, CELL_ROWS, TASK_ROWS = 1 << 18, 1 << 24, 1 << 16, 1 << 20


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges (low to high, both included) that hold them.

    Ranges are dealt to buckets of ``width``, which turns the inequality into an equality join that
    can be shuffled; a range costs a row for each bucket that it touches.

    Pairs grow with the product of both sides, however few buckets hold them. So the rows of each bucket are counted
    first, and a bucket of many pairs is dealt into a grid of cells: a point stands in one row of its grid, a range in
    one column, told by hashes of all that they hold, and each pair meets in one cell. There are as many tasks as the
    pairs ask for, so a task's share does not grow. Only the grids' sizes reach the driver, fewer than one for a
    thousand rows. Points (or ranges) that are equal in all columns share a row (or column).
    """
    p = points.withColumn("bucket__", F.floor(F.col(point) / width)).where("bucket__ IS NOT NULL")
    r = ranges.withColumn("bucket__", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    ones = p.select("bucket__", F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(r.select("bucket__", F.lit(0).alias("p"), F.lit(1).alias("r")))
    sums = ones.groupBy("bucket__").agg(F.sum("p").cast("double").alias("p"), F.sum("r").cast("double").alias("r"))

    def parts(own: str, other: str) -> Column:
        most = F.greatest(F.lit(CELL_PAIRS**0.5), CELL_PAIRS / F.greatest(F.col(other), F.lit(1.0)))
        return F.greatest(F.ceil(F.col(own) / F.least(most, F.lit(float(CELL_ROWS)))), F.lit(1))

    grids = sums.withColumns({"rows__": parts("p", "r"), "columns__": parts("r", "p")})
    total = grids.agg(
        F.sum(F.col("p") * F.col("r")).alias("pairs"),
        F.sum(F.col("p") * F.col("columns__") + F.col("r") * F.col("rows__")).alias("rows"),
        F.collect_list(F.when(F.col("rows__") * F.col("columns__") > 1, F.struct("bucket__", "rows__", "columns__"))).alias("large"),
    ).first()
    copying = 1 + int((total["rows"] or 0) / TASK_ROWS)
    tasks = copying + int((total["pairs"] or 0) / TASK_PAIRS)
    large = F.broadcast(points.sparkSession.createDataFrame(total["large"], "bucket__ long, rows__ long, columns__ long"))
    keys = ["bucket__", "rows__", "columns__"]

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        told = [f"`{f.name.replace('`', '``')}`" for f in side.schema if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind]
        place = F.when(F.col(own) > 1, F.pmod(F.xxhash64(*told), F.col(own))).otherwise(0)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1)) - 1))
        spread = side.repartition(copying) if copying > 1 else side
        return spread.join(large, "bucket__", "left").withColumns({own: place, other: every}).repartition(tasks, *keys)

    # Hashed are the ranges of a task's cells; a broadcast or a merge would hold or sort all that stand for one key.
    met = dealt(p, "rows__", "columns__").join(dealt(r, "columns__", "rows__").hint("shuffle_hash"), keys)
    return met.where(F.col(point).between(F.col(low), F.col(high))).drop(*keys)
