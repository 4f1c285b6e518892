"""Sources and sinks: CSV panels, reference lists, boundaries, matrices, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import text
from quadrat.functions.cut import cut

NAME_COLUMNS = ("DISTRICT", "district", "District", "DISTNAME", "dtname", "NAME_2")


def load_csv(spark: SparkSession, glob: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV files by glob: header, quoted fields, empty as null. Without a schema the types are inferred (extra pass)."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(glob)


def rows_by_file(df: DataFrame) -> DataFrame:
    """How many rows each file of a freshly read table gave."""
    return df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))


def validate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the names of those they break. A rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    tested = df.withColumn("broken_rules", broken)
    return tested.where(F.size("broken_rules") == 0).drop("broken_rules"), tested.where(F.size("broken_rules") > 0)


def panel_rules(counts: Sequence[str], keys: Sequence[str] = ("date", "state", "district"), pincode: str | None = "pincode") -> dict[str, Column]:
    """Not null, counts not negative, pincode of six characters."""
    rules = {f"{c} is given": F.col(c).isNotNull() for c in (*keys, *counts)} | {f"{c} >= 0": F.col(c) >= 0 for c in counts}
    return rules | ({f"{pincode} has 6 characters": F.length(pincode) == 6} if pincode else {})


def load_whole_files(spark: SparkSession, glob: str, schema: str, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """CSV files of which all rows meet all rules, and a report of all files.

    A file with a single row that breaks a rule, or that cannot be read by the schema, is set aside whole, as a failed load of it
    would be. Rows are counted where they are read, so a file of any size sends a few numbers; the bad files' names, and not
    their rows, are kept from the second reading. Files of no rows are in neither.

    Returns the rows of good files, with ``file``, and ``(file, rows, broken_rows, broken map<rule, rows>, accepted)``.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    rows = reader.schema(f"{schema}, _broken string").csv(glob).withColumn("file", F.col("_metadata.file_path"))
    all_rules = {"row is readable": F.col("_broken").isNull()} | dict(rules)
    breaks = {name: ~F.coalesce(rule, F.lit(False)) for name, rule in all_rules.items()}
    counted = [F.count_if(b).alias(f"__{i}") for i, b in enumerate(breaks.values())]
    by_file = rows.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(reduce(lambda a, b: a | b, breaks.values())).alias("broken_rows"), *counted)
    each = F.map_from_arrays(F.array(*map(F.lit, breaks)), F.array(*[F.col(f"__{i}") for i in range(len(breaks))]))
    report = cut(by_file.select("file", "rows", "broken_rows", F.map_filter(each, lambda _, n: n > 0).alias("broken"), (F.col("broken_rows") == 0).alias("accepted")))
    return rows.drop("_broken").join(report.where("NOT accepted").select("file"), "file", "left_anti"), report


def surrogate_id(df: DataFrame, out: str = "id") -> DataFrame:
    """A row id that a second run repeats: SHA-256 of all columns, twins numbered."""
    cols = df.columns
    joined = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols])
    hashed = df.withColumn("__h", F.sha2(joined, 256))
    twin = F.row_number().over(Window.partitionBy("__h").orderBy("__h"))
    return hashed.withColumn(out, F.concat_ws("-", "__h", twin.cast("string"))).drop("__h")


def scan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that there are."""
    return df.select([c for c in cols if c in df.columns])


def replace_table(df: DataFrame, path: str, month_of: str | None = None) -> None:
    """Overwrite a Parquet table; ``month_of`` names a date column to partition by month."""
    if month_of:
        df.withColumn("month_key", F.date_format(month_of, "yyyy-MM")).write.mode("overwrite").partitionBy("month_key").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_reference(df: DataFrame, state: str, district: str) -> DataFrame:
    """Distinct ``(state, district, state_key)``; text in parentheses does not count for the key."""
    key = text.name_key(F.regexp_replace(state, r"\(.*?\)", ""))
    return df.select(F.col(state).alias("state"), F.col(district).alias("district"), key.alias("state_key")).na.drop().dropDuplicates()


def load_boundaries(spark: SparkSession, path: str, names: Sequence[str] = NAME_COLUMNS) -> DataFrame:
    """GeoJSON polygons and multipolygons as a vertex table ``(region, part, ring, seq, x, y)``."""
    coords = "array<array<array<array<double>>>>"
    schema = f"features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    name = F.coalesce(*[F.try_element_at("f.properties", F.lit(n)) for n in names])
    many = F.when(F.col("f.geometry.type") == "Polygon", F.concat(F.lit("["), F.col("f.geometry.coordinates"), F.lit("]"))).otherwise(F.col("f.geometry.coordinates"))
    parts = raw.select(name.alias("region"), F.from_json(many, coords).alias("parts"))
    rings = parts.select("region", F.posexplode("parts").alias("part", "rings")).select("region", "part", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("region", "part", "ring", F.posexplode("points").alias("seq", "p"))
    return points.select("region", "part", "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def matrix_to_edges(df: DataFrame, row: str) -> DataFrame:
    """A labelled square matrix as ``(src, dst, w)`` without zeros."""
    cols = [c for c in df.columns if c != row]
    return df.unpivot(row, cols, "dst", "w").withColumnRenamed(row, "src").where("w <> 0")


def edges_to_matrix(edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """The matrix of an edge table over a given list of names, 0 where there is no edge."""
    return edges.groupBy("src").pivot("dst", list(names)).agg(F.sum("w")).na.fill(0.0)


def describe_tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """Tables and views of the catalogue with their columns and types."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(pattern=pattern) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def region_column(df: DataFrame, names: Sequence[str] = NAME_COLUMNS) -> str:
    """The first of the usual names of a region column that the table has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)} is a column")


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
