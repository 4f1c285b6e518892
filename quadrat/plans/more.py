"""Queries of joins, renamed sums, forecasts and spatial reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.functions import text
from quadrat.functions.cut import shared_folder
from quadrat.operators import features, forecast, geo, graph, names, reports, series
from quadrat.plans.panels import GRID, PANELS, TOUCH, bio, enrol, grid, table
from quadrat.plans.registry import query
from quadrat.plans.summaries import _F, _bio, _enrol
from quadrat.sources import tables

R = features.rounded

_BOOK = "CASE district WHEN 'NATION_1' THEN 'One' WHEN 'NATION_2' THEN 'One' ELSE district END"


def _book(s):
    return s.createDataFrame([("NATION_1", "One"), ("NATION_2", "One")], "old string, new string")


@query(_F + f" SELECT id, {_BOOK} AS district FROM e")
def looked_up(s, d):
    return reports.lookup(enrol(s, d).select("id", "district"), _book(s), "district", "old", "new")


@query("SELECT n_name AS district, coalesce(total, 0) AS total FROM nation LEFT JOIN (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS total FROM customer WHERE c_nationkey % 4 <> 1 GROUP BY 1) ON c_nationkey = n_nationkey")
def aligned_domain(s, d):
    nation = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("district"))
    counted = table(s, d, "customer").where("c_nationkey % 4 <> 1").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").cast("double").alias("total"))
    return reports.align_to(counted, nation, "n_nationkey").select("district", "total")


@query(_F + " SELECT state, district, round(avg(bio_a_ratio), 6) AS bio__bio_a_ratio, round(avg(bio_dependency), 6) AS bio__bio_dependency FROM b GROUP BY state, district")
def region_means(s, d):
    return R(reports.region_means(_bio(s, d), ["state", "district"], ["bio_a_ratio", "bio_dependency"], "bio"))


@query(_F + f""", m AS (SELECT district, avg(bio_total) AS a, stddev_samp(bio_total) AS b FROM b GROUP BY district) SELECT {_BOOK} AS district, round(avg(a), 6) AS bio_total_mean, round(avg(b), 6) AS bio_total_std FROM m GROUP BY 1""")
def region_moments(s, d):
    return R(reports.region_profile_moments(_bio(s, d), "district", ["bio_total"], _book(s)))


@query(f"{PANELS} SELECT date, district, CAST(sum(bio_age_5_17) AS DOUBLE) AS bio_age_5_17, CAST(sum(bio_age_17_) AS DOUBLE) AS bio_age_17_ FROM bio GROUP BY date, district")
def all_numeric_sums(s, d):
    """Every numeric column of the panel, as its schema names them."""
    return R(reports.sum_all_numeric(bio(s, d), ["date", "district"]))


@query(_F + f" SELECT date, {_BOOK} AS district, CAST(sum(enrol_total) AS BIGINT) AS enrol_total FROM e GROUP BY 1, 2")
def renamed_sums(s, d):
    return reports.resummed(_enrol(s, d), ["date"], "district", _book(s), ["enrol_total"])


_MONTHS = "mm AS (SELECT district, strftime(date, '%Y-%m') AS month, CAST(sum(enrol_total) AS DOUBLE) AS total FROM e GROUP BY ALL)"


def _months(s, d):
    return _enrol(s, d).groupBy("district", features.month_label("date").alias("month")).agg(F.sum("enrol_total").cast("double").alias("total"))


@query(_F + f", {_MONTHS} SELECT district, month, total, round(coalesce((total - first_value(total) OVER w) * 100.0 / nullif(first_value(total) OVER w, 0), 0), 6) AS change_pct FROM mm WINDOW w AS (PARTITION BY district ORDER BY month)")
def change_from_first(s, d):
    return R(series.change_from_first(_months(s, d), "district", "month", "total"))


def _totals(s, d):
    return _enrol(s, d).groupBy("state", "district").agg(F.sum("enrol_total").cast("double").alias("enrol_total"))


_TOTALS = "tt AS (SELECT state, district, CAST(sum(enrol_total) AS DOUBLE) AS enrol_total FROM e GROUP BY ALL)"


@query(_F + f", {_TOTALS} SELECT state, district, enrol_total FROM tt WHERE state = (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 1) AND district <> 'NATION_0'")
def peers_of_a_district(s, d):
    state = table(s, d, "region").orderBy("r_regionkey").first().r_name
    return reports.peers(_totals(s, d), state, "NATION_0", "enrol_total")


_TIERS = f", {_TOTALS}, pp AS (SELECT *, percent_rank() OVER (ORDER BY enrol_total) AS p FROM tt), tier AS (SELECT state, district, enrol_total, CASE WHEN p >= 0.9 THEN 'top' WHEN p >= 0.5 THEN 'above average' WHEN p >= 0.1 THEN 'below average' ELSE 'bottom' END AS tier FROM pp)"


def _tiers(s, d):
    return reports.performance_tiers(_totals(s, d), "enrol_total").select("state", "district", "enrol_total", "tier")


@query(_F + _TIERS + " SELECT district, enrol_total, tier FROM (SELECT * FROM tier WHERE tier = 'above average' ORDER BY enrol_total DESC, district LIMIT 5) UNION ALL SELECT district, enrol_total, tier FROM (SELECT * FROM tier WHERE tier = 'below average' ORDER BY enrol_total, district LIMIT 5)")
def extremes_of_classes(s, d):
    """The largest of one class and the smallest of another."""
    rows = _tiers(s, d).drop("state")
    return reports.top_n_where(rows, "tier", "above average", "enrol_total", 5, "district").unionByName(reports.top_n_where(rows, "tier", "below average", "enrol_total", 5, "district", True))


@query(_F + f", {GRID}" + _TIERS + ", corner AS (SELECT * FROM (VALUES (0, -0.5, -0.5), (1, 0.5, -0.5), (2, 0.5, 0.5), (3, -0.5, 0.5), (4, -0.5, -0.5)) t(seq, dx, dy)) SELECT region, CAST(seq AS INTEGER) AS seq, x + dx::DOUBLE AS x, y + dy::DOUBLE AS y, tier FROM cells CROSS JOIN corner LEFT JOIN tier ON district = region")
def labelled_boundaries(s, d):
    """Each vertex of the boundaries with its region's class."""
    labels = _tiers(s, d).select(F.col("district").alias("region"), "tier")
    return reports.attach_labels(grid(s, d).select("region", "seq", "x", "y"), labels)


_DAYS = """daily AS (SELECT coalesce(a.date, b.date) AS date, coalesce(a.district, b.district) AS district, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT date, district, sum(bio_total) AS x FROM b GROUP BY ALL) a FULL JOIN (SELECT date, district, CAST(sum(enrol_total) AS DOUBLE) AS y FROM e GROUP BY ALL) b ON a.date = b.date AND a.district = b.district),
 scaled AS (SELECT date, district, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS bio_bio_total, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS enrol_enrol_total FROM daily)"""


def _daily_panel(s, d):
    return series.daily_panel({"bio": _bio(s, d), "enrol": _enrol(s, d)}, "district", {"bio": ["bio_total"], "enrol": ["enrol_total"]})


@query(_F + f", {_DAYS} SELECT date, district, round(bio_bio_total, 6) AS bio_bio_total, round(enrol_enrol_total, 6) AS enrol_enrol_total FROM scaled")
def daily_scaled_panel(s, d):
    return R(_daily_panel(s, d))


@query(_F + f", {_DAYS}, c AS (SELECT count(*) FILTER (bio_bio_total > 0 OR enrol_enrol_total > 0) AS filled, count(DISTINCT date) * count(DISTINCT district) AS slots FROM scaled) SELECT filled, slots, round(filled / slots, 6) AS coverage FROM c")
def daily_panel_coverage(s, d):
    """Share of the days x districts with any event; the grid itself is only counted."""
    panel = _daily_panel(s, d)
    slots = panel.agg((F.countDistinct("date") * F.countDistinct("district")).alias("n")).first().n
    return R(series.coverage(panel, ["bio_bio_total", "enrol_enrol_total"], slots))


_LAST = f", {_MONTHS}, lm AS (SELECT district, month, total AS y, lag(total) OVER (PARTITION BY district ORDER BY month) AS prediction FROM mm), ok AS (FROM lm WHERE prediction IS NOT NULL)"


def _last_month(s, d):
    before = F.lag("total").over(Window.partitionBy("district").orderBy("month"))
    return _months(s, d).select("district", "month", F.col("total").alias("y"), before.alias("prediction")).where("prediction IS NOT NULL")


@query(_F + _LAST + " SELECT district, month, y, prediction, abs(y - prediction) AS abs_error FROM ok")
def prediction_table(s, d):
    return forecast.prediction_errors(_last_month(s, d))


@query(_F + _LAST + ", m AS (SELECT district, avg(abs(y - prediction)) AS mae, avg(abs(y - prediction) / (abs(y) + 1e-8)) * 100 AS mape FROM ok GROUP BY district) SELECT district, round(mae, 6) AS mae, round(mape, 4) AS mape, CAST(row_number() OVER (ORDER BY mae, district) AS INTEGER) AS place FROM m")
def regions_by_error(s, d):
    rows = forecast.ranked_metrics(_last_month(s, d), "district")
    return R(rows.select("district", "mae", F.round("mape", 4).alias("mape"), "place"))


@query("SELECT user_id, CASE WHEN abs(v) >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN abs(v) >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0f', v) END AS shown FROM (SELECT user_id, CAST(count(*) * 137 + 1 AS DOUBLE) AS v FROM events GROUP BY user_id)")
def shown_numbers(s, d):
    rows = table(s, d, "events").groupBy("user_id").agg((F.count("*") * 137 + 1).cast("double").alias("v"))
    return rows.select("user_id", text.short_number(F.col("v")).alias("shown"))


@query(f"WITH {GRID}, {TOUCH}, n AS (SELECT region, row_number() OVER (ORDER BY region) AS i FROM cells), p AS (SELECT a.region AS src, b.region AS dst FROM cells a JOIN cells b ON a.region <> b.region AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) SELECT src, dst, 1.0::DOUBLE AS w FROM p")
def near_regions(s, d):
    """Regions whose sides lie within the tolerance of each other."""
    return geo.near_edges(grid(s, d))


@query(f"WITH {GRID}, {TOUCH} SELECT src, dst, w FROM touch")
def edges_through_matrix(s, d):
    """Edges to a matrix and back."""
    regions = [r.n_name for r in table(s, d, "nation").select("n_name").collect()]  # the matrix' columns
    return tables.matrix_to_edges(tables.edges_to_matrix(geo.touch_edges(grid(s, d)), regions), "src")


@query("SELECT l_orderkey, sha256(CAST(l_orderkey AS VARCHAR)) || '-' || row_number() OVER (PARTITION BY l_orderkey) AS id FROM lineitem")
def surrogate_ids(s, d):
    return tables.surrogate_id(table(s, d, "lineitem").select("l_orderkey"))


@query(f"{PANELS} SELECT district FROM (SELECT DISTINCT district FROM enrol) ORDER BY md5('42:' || district), district LIMIT 10")
def sampled_districts(s, d):
    """A repeatable sample of districts."""
    return reports.sample_keys(enrol(s, d), "district", 10)


@query("SELECT c_custkey, CASE WHEN r_name || '|' || n_name IN ('AMERICA|NATION_1', 'ASIA|NATION_2') THEN 'Moved' ELSE n_name END AS name, CASE WHEN r_name || '|' || n_name = 'AMERICA|NATION_1' THEN 'ASIA' ELSE r_name END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def pair_overrides(s, d):
    """Pairs of state and name moved to other pairs by a dictionary of pairs."""
    book = s.createDataFrame([("AMERICA", "NATION_1", "ASIA", "Moved"), ("ASIA", "NATION_2", "ASIA", "Moved")], "old_state string, old_name string, new_state string, new_name string")
    places = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"), F.col("r_name").alias("state"))
    rows = table(s, d, "customer").select("c_custkey", "c_nationkey").join(places, "c_nationkey").drop("c_nationkey")
    return names.apply_pair_overrides(rows, book, "state", "name")


@query("SELECT 'l_quantity' AS \"column\", count(l_quantity) AS rows, min(l_quantity) + 0.0 AS least, max(l_quantity) + 0.0 AS most FROM lineitem UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), min(l_extendedprice) + 0.0, max(l_extendedprice) + 0.0 FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), min(l_discount) + 0.0, max(l_discount) + 0.0 FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), min(l_tax) + 0.0, max(l_tax) + 0.0 FROM lineitem")
def numeric_measure_columns(s, d):
    """Measures among a table's columns, by type, with the rows and the range that they have."""
    df = table(s, d, "lineitem")
    cols = tables.numeric_columns(df, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("rows"), (F.min(c).cast("double") + 0.0).alias("least"), (F.max(c).cast("double") + 0.0).alias("most")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*cols)).alias("x")).select("x.*")


@query(f"WITH {GRID}, {TOUCH} SELECT dst, w FROM touch WHERE src = (SELECT min(n_name) FROM nation)")
def neighbours_of_first(s, d):
    first = table(s, d, "nation").agg(F.min("n_name")).first()[0]
    return graph.neighbours(geo.touch_edges(grid(s, d)), first)


@query(f"""{PANELS}, c AS (SELECT pincode, strftime(date, '%Y') AS year, sum(age_0_5 + age_5_17 + age_18_greater)::DOUBLE AS total FROM enrol GROUP BY ALL), t AS (SELECT pincode FROM c GROUP BY pincode ORDER BY avg(total) DESC, pincode LIMIT 30)
SELECT pincode, year, total, round(coalesce((total - first_value(total) OVER w) * 100 / nullif(first_value(total) OVER w, 0), 0), 6) AS change_pct FROM c WHERE pincode IN (SELECT pincode FROM t) WINDOW w AS (PARTITION BY pincode ORDER BY year)""")
def change_of_top_regions(s, d):
    """Yearly change of the thirty pincodes with the largest yearly means."""
    rows = enrol(s, d).groupBy("pincode", F.date_format("date", "yyyy").alias("year")).agg(F.sum(F.col("age_0_5") + F.col("age_5_17") + F.col("age_18_greater")).cast("double").alias("total"))
    return R(series.change_from_first(rows, "pincode", "year", "total", 30))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def replaced_table(s, d):
    """A table written twice, the second time in place of the first, and read again by the columns that it has."""
    path = f"{shared_folder(s).rstrip('/')}/quadrat/{uuid.uuid4().hex}/customer"
    rows = table(s, d, "customer")
    tables.replace_table(rows, path)
    tables.replace_table(rows.where("c_custkey % 3 = 0"), path)
    return tables.scan(s.read.parquet(path), ["c_custkey", "c_acctbal", "no_such_column"])


@query("SELECT DISTINCT r_name AS state, n_name AS district, lower(r_name) AS state_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def reference_list(s, d):
    """Regions as a reference list; what stands in parentheses does not count for the key."""
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = tables.load_reference(rows.select(F.concat("r_name", F.lit(" (old)")).alias("r_name"), "n_name"), "r_name", "n_name")
    return listed.withColumn("state", F.regexp_replace("state", r" \(old\)$", ""))


@query("SELECT c_custkey, CAST(c_nationkey AS DOUBLE) * 3 + 60 AS lon, round(500000 + 0.9996 * 6378137.0 * 0, 3) AS east FROM customer WHERE c_nationkey = 5")
def central_meridian(s, d):
    """Points on the central meridian of a zone keep the false easting, whatever their latitude."""
    rows = table(s, d, "customer").where("c_nationkey = 5").withColumn("lon", F.col("c_nationkey") * 3.0 + 60)
    return rows.select("c_custkey", "lon", F.round(geo.to_utm(F.col("lon"), F.lit(10.0) + F.pmod("c_custkey", F.lit(50)), 43)[0], 3).alias("east"))
