"""Aggregates, rankings and set operations behind the reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.numbers import percent_change


def outer_align(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of aggregates on their keys, numbers missing on a side as 0."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), tables).na.fill(0)


def inner_align(tables: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on)), tables)


def with_measure(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """A second measure beside the first where it is known; rows of the first alone stay, with nulls."""
    return df.join(other, list(on), "left")


def attach_labels(boundaries: DataFrame, labels: DataFrame, key: str = "region") -> DataFrame:
    """Every vertex with its region's labels; regions without any keep nulls."""
    return boundaries.join(labels, key, "left")


def lookup(df: DataFrame, mapping: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """The key by a mapping; unmapped keys stay."""
    return df.join(mapping.select(F.col(old).alias(key), F.col(new).alias("__new")), key, "left").withColumn(key, F.coalesce("__new", key)).select(*df.columns)


def align_to(df: DataFrame, domain: DataFrame, key: str, fill: float = 0.0) -> DataFrame:
    """One row for each member of the domain."""
    return domain.join(df, key, "left").na.fill(fill)


def summarise(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str] = {}, means: Mapping[str, str] = {}, distinct: Mapping[str, str] = {}) -> DataFrame:
    """Sums, means and distinct counts by keys; each mapping goes from new name to column."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()] + [F.avg(c).alias(n) for n, c in means.items()] + [F.countDistinct(c).alias(n) for n, c in distinct.items()]
    return df.groupBy(*keys).agg(*aggs)


def region_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{prefix}__{c}") for c in cols])


def region_profile_moments(df: DataFrame, key: str, cols: Sequence[str], mapping: DataFrame | None = None) -> DataFrame:
    """Mean and sample deviation by region; with a mapping the plain mean of the renamed regions' figures."""
    names = [f"{c}_{s}" for c in cols for s in ("mean", "std")]
    out = df.groupBy(key).agg(*[f(c).alias(f"{c}_{s}") for c in cols for s, f in (("mean", F.avg), ("std", F.stddev_samp))])
    if mapping is None:
        return out
    return lookup(out, mapping, key, "old", "new").groupBy(key).agg(*[F.avg(n).alias(n) for n in names])


def sum_all_numeric(df: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Sum of every numeric column that is neither key nor excluded."""
    numeric = [c for c, t in df.dtypes if (t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")) and c not in {*keys, *exclude}]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric])


def resummed(df: DataFrame, keys: Sequence[str], region: str, mapping: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sums by keys and region after renaming regions; added up before and after the rename."""
    first = df.groupBy(*keys, region).agg(*[F.sum(c).alias(c) for c in cols])
    return lookup(first, mapping, region, "old", "new").groupBy(*keys, region).agg(*[F.sum(c).alias(c) for c in cols])


def shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(group, total, share)`` of national totals."""
    totals = df.agg(*[F.sum(c).cast("double").alias(c) for c in cols])
    whole = reduce(Column.__add__, map(F.col, cols))
    long = totals.withColumn("__w", whole).unpivot("__w", list(cols), "group", "total")
    return long.select("group", "total", F.coalesce(F.try_divide("total", "__w"), F.lit(0.0)).alias("share"))


def pivot_mean(df: DataFrame, row: str, col: str, val: str, values: Sequence[str], n: int) -> DataFrame:
    """Means by row and column, the ``n`` rows with the largest mean over their columns first."""
    wide = df.groupBy(row).pivot(col, list(values)).agg(F.avg(val))
    cells = F.filter(F.array(*[F.col(f"`{v}`") for v in values]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), F.size(cells).cast("double"))
    return wide.withColumn("row_mean", mean).orderBy(F.desc("row_mean"), row).limit(n)


def pivot_sum(df: DataFrame, row: str, col: str, val: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).agg(F.sum(val)).na.fill(0)


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` for each unordered pair of columns, in one aggregate."""
    pairs = list(combinations_with_replacement(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def flag_above_median(df: DataFrame, col: str, out: str = "above_median") -> DataFrame:
    """Mean and median of the column on each row, and whether the row is above the median."""
    one = df.agg(F.avg(col).alias("mean_value"), F.median(col).alias("median_value"))  # one row
    return df.crossJoin(one).withColumn(out, F.col(col) > F.col("median_value"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal bins between the extremes, numbered from 1; the largest value falls in the last."""
    ends = df.agg(F.min(col).cast("double").alias("__lo"), F.max(col).cast("double").alias("__hi"))  # one row
    place = F.floor(F.coalesce(F.try_divide((F.col(col) - F.col("__lo")) * float(bins), F.col("__hi") - F.col("__lo")), F.lit(0.0))) + 1
    return df.where(F.col(col).isNotNull()).crossJoin(ends).groupBy(F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("rows"))


def bucketed(df: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """Counts in given half-open buckets."""
    label = reduce(lambda w, e: w.when(F.col(col) >= e[0], e[1]), [(e, i + 1) for i, e in reversed(list(enumerate(edges)))], F).otherwise(0)
    return df.groupBy(label.cast("int").alias("bucket")).agg(F.count("*").alias("rows"))


def kpi_leaders(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """For each measure the key with the largest and the smallest value, ties to the first key."""
    one = df.agg(*[x for c in cols for x in (F.min(F.struct((-F.col(c)).alias("v"), F.col(key).alias("k"))).alias(f"hi_{c}"), F.min(F.struct(F.col(c).alias("v"), F.col(key).alias("k"))).alias(f"lo_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"hi_{c}.k").alias("largest"), F.col(f"lo_{c}.k").alias("smallest")) for c in cols])
    return one.select(F.inline(rows))


def counts(df: DataFrame, distinct: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct])


def period_growth(df: DataFrame, key: str, period: str, col: str) -> DataFrame:
    """% change against the period before; the first period of a key goes."""
    w = Window.partitionBy(key).orderBy(period)
    before = F.lag(col).over(w)
    return df.withColumns({"previous": before, "growth": percent_change(F.col(col), before)}).where("previous IS NOT NULL").drop("previous")


def rank_by(df: DataFrame, col: str, key: str, out: str) -> DataFrame:
    """Place by the column, largest first, ties by key. Meant for aggregates: the order is total."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.desc(col), key)))


def performance_tiers(df: DataFrame, col: str, state: str = "state", key: str = "district") -> DataFrame:
    """National rank, rank in the state, percentile and tier of aggregated regions."""
    national, local = Window.orderBy(F.desc(col)), Window.partitionBy(state).orderBy(F.desc(col))
    share = F.percent_rank().over(Window.orderBy(col))
    tier = F.when(F.col("percentile") >= 0.9, "top").when(F.col("percentile") >= 0.5, "above average").when(F.col("percentile") >= 0.1, "below average").otherwise("bottom")
    return df.withColumns({"national_rank": F.rank().over(national), "state_rank": F.rank().over(local), "percentile": share}).withColumn("tier", tier)


def peers(df: DataFrame, state: str, district: str, col: str) -> DataFrame:
    """The other districts of the state, largest first."""
    return df.where((F.col("state") == state) & (F.col("district") != district)).orderBy(F.desc(col), "district")


def top_n(df: DataFrame, col: str, n: int, key: str, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.asc(col) if ascending else F.desc(col), key).limit(n)


def top_n_where(df: DataFrame, col: str, value: str, by: str, n: int, key: str, ascending: bool = False) -> DataFrame:
    """The ``n`` largest (or smallest) of the rows of one class, ties by key."""
    return top_n(df.where(F.col(col) == value), by, n, key, ascending)


def top_n_per(df: DataFrame, group: str, col: str, n: int, key: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(col), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample of ``n`` distinct keys: those with the smallest MD5 of ``seed:key``."""
    return df.select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)
