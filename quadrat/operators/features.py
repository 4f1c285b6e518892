"""Derived columns, filters and row windows of a panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.numbers import add_one_ratio, finite, percent_change


def pair_features(df: DataFrame, a: str, b: str, prefix: str, labels: tuple[str, str] = ("0-5", "5-17")) -> DataFrame:
    """Total, two add-one ratios, larger group (ties to the second), and the ratio of the first to the second group."""
    if not {a, b} <= set(df.columns):
        return df
    total = F.col(a) + F.col(b)
    return df.withColumns(
        {
            f"{prefix}_total": total,
            f"{prefix}_a_ratio": add_one_ratio(F.col(a), total),
            f"{prefix}_b_ratio": add_one_ratio(F.col(b), total),
            f"{prefix}_dominant": F.when(F.col(a) > F.col(b), labels[0]).otherwise(labels[1]),
            f"{prefix}_dependency": add_one_ratio(F.col(a), F.col(b)),
        }
    )


def group_features(df: DataFrame, minors: Sequence[str], adults: Sequence[str], prefix: str) -> DataFrame:
    """Total, add-one share of the minors, add-one share of the adults."""
    if not {*minors, *adults} <= set(df.columns):
        return df
    add = lambda cols: reduce(Column.__add__, map(F.col, cols))
    total = add([*minors, *adults])
    return df.withColumns({f"{prefix}_total": total, f"{prefix}_minor_ratio": add_one_ratio(add(minors), total), f"{prefix}_adult_ratio": add_one_ratio(add(adults), total)})


def calendar_features(df: DataFrame, col: str = "date") -> DataFrame:
    if col not in df.columns:
        return df
    return df.withColumns(
        {
            "year": F.year(col), "month": F.month(col), "month_name": F.date_format(col, "MMMM"), "day_of_week": F.date_format(col, "EEEE"),
            "is_weekend": F.weekday(col) >= 5, "quarter": F.quarter(col), "day_of_year": F.dayofyear(col),
        }
    )


def clean_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN and infinities as 0."""
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in cols})


def composite_key(df: DataFrame, cols: Sequence[str], out: str = "key") -> DataFrame:
    return df.withColumn(out, F.concat_ws(" | ", *cols))


def split_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.split(key, r" \| ")[i] for i, c in enumerate(cols)})


def month_label(col: str) -> Column:
    return F.date_format(col, "yyyy-MM")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded. Four digits more come first, so that a mean on a tie does not go up or down with the
    order in which tasks were added up."""
    return df.select(*[F.round(F.round(c, digits + 4), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def normalise_by_group(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """The column over its largest value in the group; 0 where that is 0. The maxima are aggregated before the join."""
    most = df.groupBy(key).agg(F.max(col).alias("__m"))
    return df.join(most, key).withColumn(out, F.coalesce(F.try_divide(F.col(col).cast("double"), F.col("__m").cast("double")), F.lit(0.0))).drop("__m")


def common_dates(tables: Sequence[DataFrame], col: str = "date") -> DataFrame:
    return reduce(DataFrame.intersect, [t.select(col).where(F.col(col).isNotNull()).distinct() for t in tables])


def filter_dates(df: DataFrame, dates: DataFrame, col: str = "date") -> DataFrame:
    return df.join(dates, col, "left_semi")


def snapshot_dates(dates: DataFrame, rule: str = "first_of_month", col: str = "date", n: int = 4, fixed: Sequence[str] = ()) -> DataFrame:
    """``fixed`` dates, those on the first of a month, or the latter with the first ``n`` dates where there are none."""
    if rule == "fixed":
        return dates.where(F.col(col).isin([F.to_date(F.lit(d)) for d in fixed]))
    firsts = dates.where(F.dayofmonth(col) == 1)
    if rule == "first_of_month":
        return firsts
    any_first = dates.agg(F.count_if(F.dayofmonth(col) == 1).alias("__firsts"))  # one row
    return firsts.union(dates.orderBy(col).limit(n).crossJoin(any_first).where("__firsts = 0").drop("__firsts"))


def named_regions(df: DataFrame, col: str) -> DataFrame:
    """Trimmed, without null and blank."""
    return df.withColumn(col, F.trim(col)).where(F.col(col).isNotNull() & (F.col(col) != ""))


def search(df: DataFrame, text: str, cols: Sequence[str]) -> DataFrame:
    """Rows with the text in any of the columns, upper and lower case alike."""
    return df.where(reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in cols]))


def where_equal(df: DataFrame, **values) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(c) == v for c, v in values.items()], F.lit(True)))


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    medians = df.agg(*[F.median(c).alias(f"__{c}") for c in cols])  # one row
    return df.crossJoin(medians).withColumns({c: F.coalesce(c, f"__{c}") for c in cols}).select(*df.columns)


def add_group_totals(df: DataFrame, col: str, state: str = "state", district: str = "district") -> DataFrame:
    """State and district totals on every row. Both are aggregated first and joined back, so that a state which holds
    most of the rows is summed where they lie."""
    small = df.groupBy(state, district).agg(F.sum(col).alias("district_total"))
    large = small.groupBy(state).agg(F.sum("district_total").alias("state_total"))
    return df.join(small, [state, district], "left").join(large, state, "left")


def rank_in_state(df: DataFrame, col: str, state: str = "state", district: str = "district") -> DataFrame:
    """Dense rank of the district's total within its state, largest first, on every row."""
    small = df.groupBy(state, district).agg(F.sum(col).alias("__t"))
    ranked = small.withColumn("district_rank_in_state", F.dense_rank().over(Window.partitionBy(state).orderBy(F.desc("__t")))).drop("__t")
    return df.join(ranked, [state, district], "left")


def growth_features(df: DataFrame, col: str, keys: Sequence[str], order: Sequence[str], width: int = 7) -> DataFrame:
    """Row-to-row change and % change (0 on the first row), and mean and deviation of the last ``width`` rows.

    All four share one sort by the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = w.rowsBetween(-(width - 1), 0)
    before = F.lag(col).over(w)
    return df.withColumns(
        {
            "daily_change": F.coalesce(F.col(col) - before, F.lit(0)).cast("double"),
            "daily_pct_change": percent_change(F.col(col), before),
            f"{col}_{width}day_avg": F.avg(col).over(last),
            f"{col}_{width}day_std": F.coalesce(F.stddev_samp(col).over(last), F.lit(0.0)),
        }
    )


def rolling_days(df: DataFrame, col: str, keys: Sequence[str], date: str = "date", days: int = 7) -> DataFrame:
    """Mean of the last ``days`` calendar days."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-(days - 1), 0)
    return df.withColumn(f"{col}_{days}d_avg", F.avg(col).over(w))


def smooth(df: DataFrame, keys: Sequence[str], order: str, col: str, k: int = 7) -> DataFrame:
    """Centred mean of ``k`` rows, fewer at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k // 2), k // 2)
    return df.withColumn(f"{col}_smooth", F.avg(col).over(w))


def interpolate(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Linear between known rows, held at the ends, 0 for a key without any."""
    w = Window.partitionBy(key).orderBy(order)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__n", F.row_number().over(w))
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(c).alias("v")))
        a, b = F.last(known, ignorenulls=True).over(past), F.first(known, ignorenulls=True).over(future)
        df = df.withColumns({"__a": a, "__b": b})
        line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * F.try_divide((F.col("__n") - F.col("__a.n")).cast("double"), (F.col("__b.n") - F.col("__a.n")).cast("double"))
        df = df.withColumn(c, F.coalesce(c, line, "__a.v", "__b.v", F.lit(0.0))).drop("__a", "__b")
    return df.drop("__n")
