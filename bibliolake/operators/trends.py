"""Counts over time: literature and keyword trends, grids and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_start, parse_date
from .metrics import by_month, by_year
from .selection import explode_attr

LAST_YEARS = 6
TREND_KEYWORDS = 8
AXIS_HEADROOM = 1.05


def running_total(df: DataFrame, value: str, order: str, keys: list[str], name: str) -> DataFrame:
    """Cumulative sum of an already aggregated frame, which holds at most one row
    per calendar period and key."""
    up_to_now = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(name, F.sum(value).over(up_to_now))


def literature_trend(df: DataFrame, period: str = "year", cumulative: bool = False) -> DataFrame:
    """Papers per year or month, with the running total on request."""
    if period == "year":
        counts = by_year(df, "papers", keep_null_group=False, name="papers")
    else:
        counts = by_month(df)
    if not cumulative:
        return counts
    return running_total(counts, "papers", period, [], "cumulative_papers").orderBy(period)


def recent_years(df: DataFrame, n: int = LAST_YEARS) -> DataFrame:
    """The last n years that occur."""
    years = df.select("year").dropna().distinct()
    return years.orderBy(F.desc("year")).limit(n)


def _array_of(df: DataFrame, column: str) -> Column:
    """All values of a small frame as one sorted array."""
    return df.agg(F.array_sort(F.collect_set(column))).scalar()


def _counted(df: DataFrame, month: bool, last_years: int) -> DataFrame:
    """Keyword counts per period over the recent years; undated rows under null."""
    # last_years rows, a fixed bound for the broadcast.
    recent = df.join(F.broadcast(recent_years(df, last_years)), "year", "left_semi")
    period = month_start(parse_date(F.col("publication_date"))) if month else F.col("year")
    rows = recent.select(period.alias("period"), "keywords")
    return explode_attr(rows, "keywords", ["period"]).groupBy("period", "keyword").agg(
        F.count("*").alias("value")
    )


def _top(counted: DataFrame, n: int) -> DataFrame:
    totals = counted.groupBy("keyword").agg(F.sum("value").alias("total"))
    return totals.orderBy(F.desc("total"), "keyword").limit(n).select("keyword")


def _trend(counted: DataFrame, top: DataFrame) -> DataFrame:
    # n rows, a fixed bound for the broadcast.
    kept = counted.join(F.broadcast(top), "keyword", "left_semi")
    return kept.filter(F.col("period").isNotNull()).select("period", "keyword", "value")


def keyword_trend(
    df: DataFrame, mode: str = "year", n: int = TREND_KEYWORDS, last_years: int = LAST_YEARS
) -> DataFrame:
    """The most frequent keywords of the recent years per ``"year"``, running
    over years (``"cumulative"``) or per ``"month"``. The ranking counts undated
    papers too, the monthly rows do not."""
    counted = _counted(df, mode == "month", last_years)
    trend = _trend(counted, _top(counted, n))
    if mode == "cumulative":
        trend = running_total(trend, "value", "period", ["keyword"], "value")
    return trend.orderBy("keyword", "period")


def fill_grid(
    trend: DataFrame, periods: Column, keywords: Column, carry_forward: bool = False
) -> DataFrame:
    """Every period with every keyword, 0 where the trend has no row; with
    ``carry_forward`` the last known value instead.

    Both sides are short arrays, so the grid comes from exploding them.
    """
    start = trend.sparkSession.range(1)
    grid = start.select(F.explode(periods).alias("period"), F.lit(keywords).alias("ks"))
    grid = grid.select("period", F.explode("ks").alias("keyword"))
    filled = grid.join(trend, ["period", "keyword"], "left")
    value = F.col("value")
    if carry_forward:
        order = Window.partitionBy("keyword").orderBy("period")
        value = F.last("value", ignorenulls=True).over(order)
    return filled.select("period", "keyword", F.coalesce(value, F.lit(0)).alias("value"))


def keyword_grid(
    df: DataFrame,
    mode: str = "year",
    n: int = TREND_KEYWORDS,
    last_years: int = LAST_YEARS,
    carry_forward: bool = False,
) -> DataFrame:
    """Keyword trend as a dense grid. Yearly grids hold all recent years,
    monthly ones the months that occur for a top keyword."""
    counted = _counted(df, mode == "month", last_years)
    top = _top(counted, n)
    trend = _trend(counted, top)
    if mode == "month":
        periods = _array_of(trend, "period")
    else:
        periods = _array_of(recent_years(df, last_years), "year")
    if mode == "cumulative":
        trend = running_total(trend, "value", "period", ["keyword"], "value")
    return fill_grid(trend, periods, _array_of(top, "keyword"), carry_forward)


def frame_intervals(grid: DataFrame) -> DataFrame:
    """The grid with the frames of an animation that show each row, ``first_frame`` to
    ``last_frame``: frame f holds all periods up to the f-th. As many rows as the grid
    has, where the frames themselves grow with the square of the periods."""
    # A grid has a few keywords and calendar periods, so it is ranked in one piece.
    first = F.dense_rank().over(Window.orderBy("period")) - 1
    ranked = grid.withColumn("first_frame", first)
    last = F.max("first_frame").over(Window.partitionBy())
    return ranked.withColumn("last_frame", last).select("period", "keyword", "value", "first_frame", "last_frame")


def frame(intervals: DataFrame, number: int) -> DataFrame:
    """One frame out of its intervals, none beyond the last."""
    shown = F.lit(number).between(F.col("first_frame"), F.col("last_frame"))
    return intervals.where(shown).select(F.lit(number).alias("frame"), "period", "keyword", "value")


def expand_frames(intervals: DataFrame) -> DataFrame:
    """All frames out of their intervals. Each row names the frames it belongs to, so no
    range join is needed."""
    spread = F.explode(F.sequence("first_frame", "last_frame")).alias("frame")
    return intervals.select(spread, "period", "keyword", "value")


def frames(grid: DataFrame) -> DataFrame:
    """Growing sequence for an animation: frame f holds all periods up to the f-th."""
    return expand_frames(frame_intervals(grid))


def axis_bound(grid: DataFrame) -> DataFrame:
    """Upper end of the value axis: five percent above the maximum, at least 1."""
    top = F.max("value") * F.lit(AXIS_HEADROOM)
    return grid.agg(F.greatest(F.lit(1.0), top).alias("upper"))
