"""Window helpers over (ticker, date): the vocabulary of every feature.

Missing values are NULL, never NaN; divisions by zero are NULL.  All helpers share one partitioning and one order, so
Catalyst plans a single exchange and sort for any number of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date(*partition: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(partition or ("ticker",))).orderBy(order)


def by_series(*keys: str, order: str = "date") -> WindowSpec:
    """Rows of each series in order; without keys the whole frame is one series."""
    return Window.partitionBy(*keys).orderBy(order)


def trailing(k: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_date()).rowsBetween(-(k - 1), 0)


def running(w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_date()).rowsBetween(Window.unboundedPreceding, 0)


def roll(f: Callable[[Column], Column], x: Column | str, k: int, w: WindowSpec | None = None) -> Column:
    """``f`` over the last k rows, NULL unless all k values are there."""
    x = F.col(x) if isinstance(x, str) else x
    frame = trailing(k, w)
    return F.when(F.count(x).over(frame) == k, f(x).over(frame))


def ret(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """x / x n rows earlier - 1."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(x, F.lag(x, n).over(w or by_date())) - 1


def ffill(x: Column | str, w: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over(running(w))


def clean(x: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x), x)


def pct_rank(x: str, *partition: str) -> Column:
    """Average rank of the non-null values over their number; ties share their mean rank."""
    ordered = Window.partitionBy(*partition, F.col(x).isNull()).orderBy(x)
    peers = Window.partitionBy(*partition, x)
    place = F.rank().over(ordered) + (F.count(x).over(peers) - 1) / 2
    return F.when(F.col(x).isNotNull(), place / F.count(x).over(Window.partitionBy(*partition)))


def ewm_block(r: float) -> int:
    """Rows per block: inside one, powers of 1/r stay finite; over two, r vanishes in double precision."""
    need = math.ceil(19 * math.log(10) / -math.log(r) / 2)
    return max(need, min(1024, int(600 / -math.log(r))))


def with_ewm(df: DataFrame, out: dict[str, tuple[str, float, int]], partition: str = "ticker", order: str = "date") -> DataFrame:
    """Adds exponentially weighted means; ``out`` maps a new column to (source column, alpha, least non-null count).

    y_t = sum r^(t-i) x_i / sum r^(t-i) over the non-null x_i up to t, r = 1 - alpha, positions counted in rows.  Written
    with powers of 1/r this is a running sum, but the powers overflow on long series.  So rows are cut into blocks: the
    running sums start afresh in each block and the last two blocks' sums are carried over, decayed; what lies further
    back is below double precision.  Everything is a running window, linear in the rows whatever the length.
    """
    w, keep = by_date(partition, order=order), df.columns
    df = df.withColumn("_rn", F.row_number().over(w) - 1)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    for r, block in {1 - a: ewm_block(1 - a) for _, a, _ in out.values()}.items():
        tag = f"{round(r * 1e9)}"
        df = df.withColumn(f"_b{tag}", F.expr(f"_rn div {block}")).withColumn(f"_i{tag}", F.col("_rn") % block)
    parts = {}
    for x, alpha, _ in out.values():
        for kind in ("n", "d"):
            parts[f"_{kind}{x}_{round((1 - alpha) * 1e9)}"] = (x, 1 - alpha, kind)
    local, first, carried = {}, {}, {}
    for name, (x, r, kind) in parts.items():
        tag = f"{round(r * 1e9)}"
        i = F.col(f"_i{tag}")
        own = running(Window.partitionBy(partition, f"_b{tag}").orderBy(order))
        value = F.col(x) if kind == "n" else F.lit(1.0)
        grown = F.when(F.col(x).isNotNull(), value * F.pow(F.lit(1 / r), i.cast("double")))
        local[name] = F.coalesce(F.sum(grown).over(own), F.lit(0.0)) * F.pow(F.lit(r), i.cast("double"))
    df = df.withColumns(local)
    for name, (_, r, _) in parts.items():
        tag, block = f"{round(r * 1e9)}", ewm_block(r)
        ends = F.when(F.col(f"_i{tag}") == block - 1, F.col(name))
        first[f"{name}_1"] = F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(0.0))
    df = df.withColumns(first)
    for name, (_, r, _) in parts.items():
        tag, block = f"{round(r * 1e9)}", ewm_block(r)
        ends = F.when(F.col(f"_i{tag}") == block - 1, F.col(name) + F.lit(r**block) * F.col(f"{name}_1"))
        carried[f"{name}_2"] = F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit(0.0))
    df = df.withColumns(carried)
    made = {}
    for new, (x, alpha, least) in out.items():
        r = 1 - alpha
        tag = f"{round(r * 1e9)}"
        decay = F.pow(F.lit(r), F.col(f"_i{tag}") + 1.0)
        num, den = (F.col(f"_{k}{x}_{tag}") + decay * F.col(f"_{k}{x}_{tag}_2") for k in ("n", "d"))
        made[new] = F.when(F.count(x).over(running(w)) >= least, F.try_divide(num, den))
    return df.withColumns(made).select(*keep, *out)


def islands(df: DataFrame, value: str, *partition: str, order: str = "date") -> DataFrame:
    """Adds ``island``, the number of the run of equal values that a row is in."""
    w = Window.partitionBy(*partition).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(running(w))).drop("_changed")


def longest_run(df: DataFrame, flag: str, *partition: str, order: str = "date") -> DataFrame:
    """partition columns and ``longest``, the rows of the longest run of true flags (0 if there is none)."""
    runs = islands(df, flag, *partition, order=order).groupBy(*partition, "island").agg(F.count_if(flag).alias("n"))
    return runs.groupBy(*partition).agg(F.max("n").alias("longest"))
