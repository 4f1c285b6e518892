"""Profiles, audits and repairs of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: type, nulls; and the table's rows and duplicate rows on each."""
    nulls = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = nulls.unpivot("rows", df.columns, "column", "nulls")
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    distinct = df.distinct().agg(F.count("*").alias("__d"))  # one row
    return long.crossJoin(distinct).select("column", F.element_at(kinds, F.col("column")).alias("type"), "nulls", "rows", (F.col("rows") - F.col("__d")).alias("duplicate_rows"))


def coerce_date(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """The column as a date; what is none becomes null."""
    return df.withColumn(col, F.try_to_date(col, fmt) if fmt else F.col(col).try_cast("date"))


def invalid_dates(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    parsed = F.try_to_date(col, fmt) if fmt else F.col(col).try_cast("date")
    return df.agg(F.count("*").alias("rows"), F.count_if(parsed.isNull()).alias("invalid"))


def dedup(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """All columns by default; give the keys to look past a surrogate id."""
    return df.dropDuplicates(list(keys)) if keys else df.dropDuplicates()


def handle_missing(df: DataFrame, strategy: str = "fill", protected: Sequence[str] = ()) -> DataFrame:
    """``drop`` rows with a null, or ``fill`` numbers with 0 and strings with "Unknown"; protected columns stay."""
    free = [f for f in df.schema if f.name not in protected]
    if strategy == "drop":
        return df.na.drop(subset=[f.name for f in free])
    return df.na.fill({f.name: 0 for f in free if isinstance(f.dataType, T.NumericType)} | {f.name: "Unknown" for f in free if isinstance(f.dataType, T.StringType)})


def date_completeness(df: DataFrame, col: str = "date") -> DataFrame:
    """First and last day, distinct days, expected days, missing days."""
    found = df.agg(F.min(col).alias("first"), F.max(col).alias("last"), F.countDistinct(col).alias("distinct_days"))
    expected = (F.datediff("last", "first") + 1).cast("long")
    return found.withColumns({"expected_days": expected, "missing_days": expected - F.col("distinct_days")})


def missing_dates(df: DataFrame, col: str = "date") -> DataFrame:
    """The days between the first and the last that no row has."""
    days = df.agg(F.explode(F.sequence(F.min(col), F.max(col))).alias(col))
    return days.join(df.select(col).distinct(), col, "left_anti")


def null_dates(tables: Mapping[str, DataFrame], col: str = "date") -> DataFrame:
    """Rows, and rows without a date, of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_if(F.col(col).isNull()).alias("null_dates"))
        out = one if out is None else out.unionByName(one)
    return out


def guard_counts(before: DataFrame, after: DataFrame) -> dict[str, int]:
    """Rows before, after and removed. Raises ``ValueError`` if a step has added rows."""
    a, b = before.count(), after.count()
    if b > a:
        raise ValueError(f"a cleaning step added rows: {a} before, {b} after")
    return {"before": a, "after": b, "removed": a - b}


def audit(tables: Mapping[str, DataFrame], state: str = "state", district: str = "district") -> DataFrame:
    """Rows, distinct states, distinct districts of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.countDistinct(state).alias("states"), F.countDistinct(state, district).alias("districts"))
        out = one if out is None else out.unionByName(one)
    return out


def names_in_several_states(tables: Sequence[DataFrame], state: str = "state", district: str = "district") -> DataFrame:
    """District names that more than one state has, with those states in order."""
    return all_pairs(tables, state, district).groupBy(district).agg(F.count("*").alias("states"), F.array_join(F.sort_array(F.collect_set(state)), ",").alias("found_in")).where("states > 1")


def all_pairs(tables: Sequence[DataFrame], state: str = "state", district: str = "district") -> DataFrame:
    """Distinct (state, district) over all tables."""
    out = None
    for df in tables:
        one = df.select(state, district).distinct()
        out = one if out is None else out.union(one)
    return out.distinct()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
