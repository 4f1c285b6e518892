"""Dense panels, windows of lags, splits and autocorrelation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.features import interpolate

STEPS = {"day": "1 day", "week": "7 days"}


def weekly_panel(df: DataFrame, region: str, sums: Sequence[str], means: Sequence[str], date: str = "date") -> DataFrame:
    """Sums and means by week (from Monday) and region."""
    week = F.to_date(F.date_trunc("week", date)).alias("week")
    return df.groupBy(week, region).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def dense_panel(df: DataFrame, time: str, node: str, step: str = "week") -> DataFrame:
    """Every node at every time between the first and the last; the grid is times by nodes, both few beside the facts."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    times = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {STEPS[step]}"))).alias(time))
    return times.crossJoin(df.select(node).distinct()).join(df, [time, node], "left")


def weekly_dense_panel(df: DataFrame, region: str, sums: Sequence[str], means: Sequence[str], date: str = "date") -> DataFrame:
    """Weekly panel without holes: counts 0, ratios interpolated."""
    grid = dense_panel(weekly_panel(df, region, sums, means, date), "week", region)
    return interpolate(grid.na.fill(0, subset=list(sums)), region, "week", means)


def daily_panel(tables: Mapping[str, DataFrame], region: str, cols: Mapping[str, Sequence[str]], date: str = "date") -> DataFrame:
    """Sums of several tables by day and region, each scaled to 0..1 over the whole panel; a constant column is 0."""
    parts = [df.groupBy(date, region).agg(*[F.sum(c).alias(f"{n}_{c}") for c in cols[n]]) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [date, region], "full")
    names = [c for c in out.columns if c not in (date, region)]
    out = out.na.fill(0, subset=names)
    ends = out.agg(*[f(c).alias(f"__{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])  # one row
    scaled = {c: F.coalesce(F.try_divide((F.col(c) - F.col(f"__lo_{c}")).cast("double"), (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double")), F.lit(0.0)) for c in names}
    return out.crossJoin(ends).withColumns(scaled).select(date, region, *names)


def coverage(panel: DataFrame, cols: Sequence[str], slots: int | None = None) -> DataFrame:
    """Share of slots of a panel with any value above 0; ``slots`` counts a grid that the panel does not spell out."""
    filled = F.count_if(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in cols]) > 0) if len(cols) > 1 else F.count_if(F.col(cols[0]) > 0)
    return panel.agg(filled.alias("filled"), (F.lit(slots).cast("long") if slots else F.count("*")).alias("slots")).withColumn("coverage", F.try_divide("filled", "slots"))


def sliding_sequences(df: DataFrame, node: str, t: str, col: str, t_in: int = 6, t_out: int = 1) -> DataFrame:
    """``(node, t, inputs, targets)``: ``t_in`` values from ``t`` on and the ``t_out`` that follow; whole ones only."""
    w = Window.partitionBy(node).orderBy(t)
    rows = df.select(node, t, F.collect_list(col).over(w.rowsBetween(0, t_in - 1)).alias("inputs"), F.collect_list(col).over(w.rowsBetween(t_in, t_in + t_out - 1)).alias("targets"))
    return rows.where((F.size("inputs") == t_in) & (F.size("targets") == t_out))


def chronological_split(df: DataFrame, t: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """train, val or test by the place of a row's time among all distinct times, cut at the rounded-down shares."""
    times = df.select(t).distinct()
    placed = times.withColumns({"__n": F.row_number().over(Window.orderBy(t)), "__all": F.count("*").over(Window.partitionBy(F.lit(0)))})
    first, second = F.floor(F.col("__all") * train), F.floor(F.col("__all") * (train + val))
    part = F.when(F.col("__n") <= first, "train").when(F.col("__n") <= second, "val").otherwise("test")
    return df.join(placed.select(t, part.alias("part")), t)


def change_from_first(df: DataFrame, region: str, step: str, col: str, top: int | None = None) -> DataFrame:
    """% change of each step from the region's first; with ``top`` for the regions with the largest means alone, ties by name."""
    if top is not None:
        df = df.join(df.groupBy(region).agg(F.avg(col).alias("__m")).orderBy(F.desc("__m"), region).limit(top).select(region), region, "left_semi")
    first = F.first(col).over(Window.partitionBy(region).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("change_pct", F.coalesce(F.try_divide((F.col(col) - first) * 100.0, first), F.lit(0.0)))


def acf(df: DataFrame, key: str, order: str, col: str, max_lag: int = 20) -> DataFrame:
    """Correlation of the series with itself ``lag`` steps on, each slice about its own mean, for lags 1 to
    min(max_lag, T/2 - 1), with the 95 % band; null where a slice is constant."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, F.row_number().over(w).alias("t"), F.col(col).cast("double").alias("v"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    lagged = rows.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).where(F.col("lag") <= F.floor(F.col("n") / 2) - 1)
    then = rows.select(key, F.col("t").alias("t2"), F.col("v").alias("v2"))
    pairs = lagged.withColumn("t2", F.col("t") + F.col("lag")).join(then, [key, "t2"])
    r = F.try_divide(F.covar_pop("v", "v2"), F.stddev_pop("v") * F.stddev_pop("v2"))
    return pairs.groupBy(key, "lag").agg(r.alias("acf"), (1.96 / F.sqrt(F.max("n"))).alias("band"))
