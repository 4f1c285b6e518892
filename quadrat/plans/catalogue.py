"""Registered queries of the panel operators and the SQL they are held against.

Each query applies library operators to whole tables. Floating results are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.functions import text
from quadrat.functions.cut import cut
from quadrat.functions.numbers import percent_change
from quadrat.operators import cluster, features, forecast, geo, graph, names, quality, reports, series
from quadrat.plans import cleaning, decompositions, loading, matching, meshes, more  # noqa: F401  they register their queries
from quadrat.plans.panels import ENROL, GRID, TOUCH, bio, demo, enrol, grid, table
from quadrat.plans.registry import oracle_sql, queries, query as _query  # noqa: F401
from quadrat.plans.summaries import _COMMON, _F, _bio, _common, _demo, _enrol
from quadrat.sources import tables

R = features.rounded


@_query(_F + " SELECT date, state, district, pincode, bio_total, round(bio_a_ratio, 6) AS bio_a_ratio, round(bio_b_ratio, 6) AS bio_b_ratio, bio_dominant, round(bio_dependency, 6) AS bio_dependency FROM b")
def pair_ratio_features(s, d):
    return R(_bio(s, d).drop("bio_age_5_17", "bio_age_17_"))


@_query(_F + " SELECT id, CAST(enrol_total AS INTEGER) AS enrol_total, round(enrol_minor_ratio, 6) AS enrol_minor_ratio, round(enrol_adult_ratio, 6) AS enrol_adult_ratio FROM e")
def group_ratio_features(s, d):
    return R(_enrol(s, d).select("id", "enrol_total", "enrol_minor_ratio", "enrol_adult_ratio"))


@_query(f"WITH {ENROL} SELECT id, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, monthname(date) AS month_name, dayname(date) AS day_of_week, isodow(date) >= 6 AS is_weekend, CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofyear(date) AS INTEGER) AS day_of_year FROM enrol")
def calendar(s, d):
    return features.calendar_features(enrol(s, d).select("id", "date")).drop("date")


_G = "PARTITION BY state, district, pincode ORDER BY date"


@_query(_F + f""" SELECT date, state, district, pincode, round(coalesce(bio_total - lag(bio_total) OVER w, 0), 6) AS daily_change,
  round(coalesce(CASE WHEN lag(bio_total) OVER w = 0 THEN NULL ELSE (bio_total - lag(bio_total) OVER w) * 100.0 / lag(bio_total) OVER w END, 0), 6) AS daily_pct_change,
  round(avg(bio_total) OVER ({_G} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS bio_total_7day_avg, round(coalesce(stddev_samp(bio_total) OVER ({_G} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0), 6) AS bio_total_7day_std
  FROM b WINDOW w AS ({_G})""")
def growth_and_rolling(s, d):
    out = features.growth_features(_bio(s, d), "bio_total", ["state", "district", "pincode"], ["date"])
    return R(out.select("date", "state", "district", "pincode", "daily_change", "daily_pct_change", "bio_total_7day_avg", "bio_total_7day_std"))


@_query(_F + " SELECT date, pincode, state, district, round(avg(bio_total) OVER (PARTITION BY state, district, pincode ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS bio_total_7d_avg FROM b")
def rolling_calendar_days(s, d):
    return R(features.rolling_days(_bio(s, d), "bio_total", ["state", "district", "pincode"]).select("date", "pincode", "state", "district", "bio_total_7d_avg"))


@_query(_F + """, t AS (SELECT state, district, CAST(sum(enrol_total) AS BIGINT) AS district_total FROM e GROUP BY ALL), r AS (SELECT *, CAST(sum(district_total) OVER (PARTITION BY state) AS BIGINT) AS state_total,
  CAST(dense_rank() OVER (PARTITION BY state ORDER BY district_total DESC) AS INTEGER) AS district_rank_in_state FROM t) SELECT id, district_total, state_total, district_rank_in_state FROM e JOIN r USING (state, district)""")
def group_totals_and_rank(s, d):
    rows = features.rank_in_state(features.add_group_totals(_enrol(s, d), "enrol_total"), "enrol_total")
    return rows.select("id", "district_total", "state_total", "district_rank_in_state")


@_query(f"WITH {_COMMON} SELECT date FROM common")
def common_days(s, d):
    return _common(s, d)


@_query(f"WITH {_COMMON} SELECT date FROM snaps")
def snapshot_days(s, d):
    return features.snapshot_dates(_common(s, d), "first_or_n")


@_query(_F + """, n AS (SELECT * FROM (SELECT date, sum(bio_total) AS bio FROM b GROUP BY date) JOIN (SELECT date, sum(demo_total) AS demo FROM d GROUP BY date) USING (date) JOIN (SELECT date, CAST(sum(enrol_total) AS DOUBLE) AS enrol FROM e GROUP BY date) USING (date))
SELECT date, bio, demo, enrol, round(avg(bio) OVER w, 6) AS bio_smooth, round(avg(enrol) OVER w, 6) AS enrol_smooth FROM n WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def national_trend_smoothed(s, d):
    day = lambda df, c, n: df.groupBy("date").agg(F.sum(c).cast("double").alias(n))
    rows = reports.inner_align([day(_bio(s, d), "bio_total", "bio"), day(_demo(s, d), "demo_total", "demo"), day(_enrol(s, d), "enrol_total", "enrol")], ["date"])
    rows = rows.withColumn("__all", F.lit(0))
    return R(features.smooth(features.smooth(rows, ["__all"], "date", "bio"), ["__all"], "date", "enrol").drop("__all"))


@_query(_F + """, m AS (SELECT state, strftime(date, '%Y-%m') AS month, CAST(sum(enrol_total) AS BIGINT) AS total FROM e GROUP BY ALL)
SELECT * FROM (SELECT state, month, total, round(CASE WHEN lag(total) OVER w = 0 THEN 0 ELSE (total - lag(total) OVER w) * 100.0::DOUBLE / lag(total) OVER w END, 6) AS growth FROM m WINDOW w AS (PARTITION BY state ORDER BY month)) WHERE growth IS NOT NULL""")
def month_over_month(s, d):
    monthly = _enrol(s, d).groupBy("state", features.month_label("date").alias("month")).agg(F.sum("enrol_total").alias("total"))
    return R(reports.period_growth(monthly, "state", "month", "total"))


_YEARS = [str(y) for y in range(1995, 2002)]


@_query(_F + ", p AS (SELECT state, " + ", ".join(f"avg(bio_a_ratio) FILTER (year(date) = {y}) AS \"{y}\"" for y in _YEARS) + " FROM b GROUP BY state) SELECT state, "
  + ", ".join(f"round(\"{y}\", 6) AS \"{y}\"" for y in _YEARS) + ", round(list_avg(list_filter([" + ", ".join(f"\"{y}\"" for y in _YEARS) + "], lambda x: x IS NOT NULL)), 6) AS row_mean FROM p ORDER BY row_mean DESC, state LIMIT 4")
def pivot_state_year_mean(s, d):
    """The four states with the largest mean ratio over years."""
    return R(reports.pivot_mean(_bio(s, d).withColumn("year", F.year("date").cast("string")), "state", "year", "bio_a_ratio", _YEARS, 4))


@_query(_F + ", p AS (SELECT state, strftime(date, '%Y-%m') AS month, CAST(sum(enrol_total) AS DOUBLE) AS total FROM e GROUP BY ALL) SELECT state, month, total, round(CASE WHEN max(total) OVER (PARTITION BY state) = 0 THEN 0 ELSE total / max(total) OVER (PARTITION BY state) END, 6) AS share FROM p")
def month_share_of_peak(s, d):
    monthly = _enrol(s, d).groupBy("state", features.month_label("date").alias("month")).agg(F.sum("enrol_total").cast("double").alias("total"))
    return R(features.normalise_by_group(monthly, "state", "total", "share"))


@_query(_F + ", p AS (SELECT state, " + ", ".join(f"CAST(coalesce(sum(enrol_total) FILTER (year(date) = {y}), 0) AS BIGINT) AS \"{y}\"" for y in _YEARS) + " FROM e GROUP BY state) SELECT * FROM p")
def pivot_state_year_sum(s, d):
    return reports.pivot_sum(_enrol(s, d).withColumn("year", F.year("date").cast("string")), "state", "year", "enrol_total", _YEARS)


@_query(_F + """, v AS (SELECT district, avg(bio_a_ratio) AS ratio FROM b GROUP BY district) SELECT district, round(ratio, 6) AS ratio, round((SELECT avg(ratio) FROM v), 6) AS mean_value, round((SELECT median(ratio) FROM v), 6) AS median_value, ratio > (SELECT median(ratio) FROM v) AS above_median FROM v""")
def above_median_districts(s, d):
    return R(reports.flag_above_median(_bio(s, d).groupBy("district").agg(F.avg("bio_a_ratio").alias("ratio")), "ratio"))


@_query(_F + """, t AS (SELECT state, CAST(sum(enrol_total) AS BIGINT) AS enrol, count(*) AS events FROM e GROUP BY state) SELECT 'enrol' AS measure, arg_max(state, enrol) AS largest, arg_min(state, enrol) AS smallest FROM t UNION ALL SELECT 'events', arg_max(state, events), arg_min(state, events) FROM t""")
def kpi_leading_states(s, d):
    return reports.kpi_leaders(_enrol(s, d).groupBy("state").agg(F.sum("enrol_total").alias("enrol"), F.count("*").alias("events")), "state", ["enrol", "events"])


@_query(_F + """, t AS (SELECT unnest(['age_0_5', 'age_5_17', 'age_18_greater']) AS "group", unnest([sum(age_0_5), sum(age_5_17), sum(age_18_greater)])::DOUBLE AS total FROM e) SELECT "group", total, round(total / (SELECT sum(total) FROM t), 6) AS share FROM t""")
def age_shares(s, d):
    return R(reports.shares(enrol(s, d), ["age_0_5", "age_5_17", "age_18_greater"]))


@_query("SELECT CAST(least(floor((value - lo) * 20.0 / (hi - lo)) + 1, 20) AS INTEGER) AS bin, count(*) AS rows FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1")
def value_histogram(s, d):
    return reports.histogram(table(s, d, "events"), "value", 20)


@_query("SELECT CASE WHEN value >= 50 THEN 3 WHEN value >= 10 THEN 2 WHEN value >= 0 THEN 1 ELSE 0 END AS bucket, count(*) AS rows FROM events GROUP BY 1")
def value_buckets(s, d):
    return reports.bucketed(table(s, d, "events"), "value", [0.0, 10.0, 50.0])


_CORR = ("bio", "ratio", "demo", "enrol")


@_query(_F + ", n AS (SELECT * FROM (SELECT district, sum(bio_total) AS bio, avg(bio_a_ratio) AS ratio FROM b GROUP BY district) JOIN (SELECT district, sum(demo_total) AS demo FROM d GROUP BY district) USING (district) JOIN (SELECT district, CAST(sum(enrol_total) AS DOUBLE) AS enrol FROM e GROUP BY district) USING (district)) "
  + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM n" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def correlation_of_averages(s, d):
    b = _bio(s, d).groupBy("district").agg(F.sum("bio_total").alias("bio"), F.avg("bio_a_ratio").alias("ratio"))
    m = _demo(s, d).groupBy("district").agg(F.sum("demo_total").alias("demo"))
    e = _enrol(s, d).groupBy("district").agg(F.sum("enrol_total").cast("double").alias("enrol"))
    return R(reports.correlation_long(reports.inner_align([b, m, e], ["district"]), list(_CORR)))


_WEEK = _F + ", w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, district, CAST(sum(enrol_total) AS BIGINT) AS enrol_total, avg(enrol_minor_ratio) AS enrol_minor_ratio FROM e GROUP BY ALL)"


@_query(_WEEK + " SELECT week, district, enrol_total, round(enrol_minor_ratio, 6) AS enrol_minor_ratio FROM w")
def weekly_region_panel(s, d):
    return R(series.weekly_panel(_enrol(s, d), "district", ["enrol_total"], ["enrol_minor_ratio"]))


_GRID = _WEEK + """, g AS (SELECT CAST(t AS DATE) AS week, district FROM (SELECT unnest(generate_series((SELECT min(week) FROM w), (SELECT max(week) FROM w), INTERVAL 7 DAYS)) AS t), (SELECT DISTINCT district FROM w)),
 f AS (SELECT g.week, g.district, coalesce(enrol_total, 0) AS enrol_total, enrol_minor_ratio, row_number() OVER (PARTITION BY g.district ORDER BY g.week) AS n FROM g LEFT JOIN w ON w.week = g.week AND w.district = g.district),
 k AS (SELECT *, last_value(CASE WHEN enrol_minor_ratio IS NOT NULL THEN n END IGNORE NULLS) OVER a AS n1, last_value(enrol_minor_ratio IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN enrol_minor_ratio IS NOT NULL THEN n END IGNORE NULLS) OVER z AS n2, first_value(enrol_minor_ratio IGNORE NULLS) OVER z AS v2 FROM f
  WINDOW a AS (PARTITION BY district ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY district ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 dense AS (SELECT week, district, enrol_total, coalesce(enrol_minor_ratio, v1 + (v2 - v1) * (n - n1) / (n2 - n1), v1, v2, 0) AS enrol_minor_ratio FROM k)"""  # fmt: skip


def _dense(s, d):
    return series.weekly_dense_panel(_enrol(s, d), "district", ["enrol_total"], ["enrol_minor_ratio"])


@_query(_GRID + " SELECT week, district, enrol_total, round(enrol_minor_ratio, 6) AS enrol_minor_ratio FROM dense")
def dense_weekly_panel(s, d):
    return R(_dense(s, d))


@_query(_GRID + ", c AS (SELECT count(*) AS slots, count(*) FILTER (enrol_total > 0) AS filled FROM dense) SELECT filled, slots, round(filled / slots, 6) AS coverage FROM c")
def panel_coverage(s, d):
    return R(series.coverage(_dense(s, d), ["enrol_total"]))


@_query(_GRID + """, q AS (SELECT district, week, list(enrol_total) OVER (PARTITION BY district ORDER BY week ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS i, lead(enrol_total, 6) OVER (PARTITION BY district ORDER BY week) AS y FROM dense), ok AS (SELECT * FROM q WHERE y IS NOT NULL),
 t AS (SELECT week, row_number() OVER (ORDER BY week) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT week FROM ok))
SELECT district, week, CAST(list_sum(i) AS BIGINT) AS inputs_sum, y AS target, CASE WHEN n <= floor(total * 0.6) THEN 'train' WHEN n <= floor(total * 0.8) THEN 'val' ELSE 'test' END AS part FROM ok JOIN t USING (week)""")
def sequences_split(s, d):
    """Windows of six weeks and the next one, split by time."""
    seq = series.chronological_split(series.sliding_sequences(_dense(s, d), "district", "week", "enrol_total", 6, 1), "week")
    return seq.select("district", "week", F.aggregate("inputs", F.lit(0).cast("long"), lambda a, x: a + x).alias("inputs_sum"), F.col("targets")[0].alias("target"), "part")


@_query(_GRID + """, r AS (SELECT district, row_number() OVER (PARTITION BY district ORDER BY week) AS t, enrol_total::DOUBLE AS v, count(*) OVER (PARTITION BY district) AS n FROM dense)
SELECT a.district, CAST(b.t - a.t AS INTEGER) AS lag, round(corr(a.v, b.v), 6) AS acf, round(1.96 / sqrt(max(a.n)), 6) AS band FROM r a JOIN r b ON a.district = b.district AND b.t - a.t BETWEEN 1 AND least(20, floor(a.n / 2) - 1) GROUP BY 1, 2""")
def autocorrelation(s, d):
    return R(series.acf(_dense(s, d), "district", "week", "enrol_total"))


_PROFILE = _F + ", prof AS (SELECT * FROM (SELECT state, district, sum(bio_total) AS bio_total, avg(bio_a_ratio) AS bio_ratio FROM b GROUP BY ALL) FULL JOIN (SELECT state, district, sum(demo_total) AS demo_total, avg(demo_a_ratio) AS demo_ratio FROM d GROUP BY ALL) USING (state, district) FULL JOIN (SELECT state, district, CAST(sum(enrol_total) AS DOUBLE) AS enrol_total, avg(enrol_minor_ratio) AS minor_ratio FROM e GROUP BY ALL) USING (state, district)), profile AS (SELECT state, district, coalesce(bio_total, 0) AS bio_total, coalesce(bio_ratio, 0) AS bio_ratio, coalesce(demo_total, 0) AS demo_total, coalesce(demo_ratio, 0) AS demo_ratio, coalesce(enrol_total, 0) AS enrol_total, coalesce(minor_ratio, 0) AS minor_ratio FROM prof)"
_PCOLS = ["bio_total", "bio_ratio", "demo_total", "demo_ratio", "enrol_total", "minor_ratio"]


def _profile(s, d):
    keys = ["state", "district"]
    b = reports.summarise(_bio(s, d), keys, {"bio_total": "bio_total"}, {"bio_ratio": "bio_a_ratio"})
    m = reports.summarise(_demo(s, d), keys, {"demo_total": "demo_total"}, {"demo_ratio": "demo_a_ratio"})
    e = reports.summarise(_enrol(s, d), keys, {"enrol_total": "enrol_total"}, {"minor_ratio": "enrol_minor_ratio"}).withColumn("enrol_total", F.col("enrol_total").cast("double"))
    return reports.outer_align([b, m, e], keys)


@_query(_PROFILE + """, p AS (SELECT state, district, enrol_total, CAST(rank() OVER (ORDER BY enrol_total DESC) AS INTEGER) AS national_rank, CAST(rank() OVER (PARTITION BY state ORDER BY enrol_total DESC) AS INTEGER) AS state_rank, percent_rank() OVER (ORDER BY enrol_total) AS percentile FROM profile)
SELECT state, district, enrol_total, national_rank, state_rank, round(percentile, 6) AS percentile, CASE WHEN percentile >= 0.9 THEN 'top' WHEN percentile >= 0.5 THEN 'above average' WHEN percentile >= 0.1 THEN 'below average' ELSE 'bottom' END AS tier FROM p""")
def district_tiers(s, d):
    return R(reports.performance_tiers(_profile(s, d).select("state", "district", "enrol_total"), "enrol_total"))


@_query(_PROFILE + ", t AS (SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY enrol_total DESC, district) AS INTEGER) AS place FROM profile) SELECT state, district, enrol_total, place FROM t WHERE place <= 3")
def top_districts_per_state(s, d):
    return reports.top_n_per(_profile(s, d).select("state", "district", "enrol_total"), "state", "enrol_total", 3, "district")


@_query(_PROFILE + " SELECT district, enrol_total FROM profile ORDER BY enrol_total ASC, district LIMIT 10")
def bottom_districts(s, d):
    return reports.top_n(_profile(s, d).select("district", "enrol_total"), "enrol_total", 10, "district", ascending=True)


_SERIES = (("bio", "bio_total", "bio_a_ratio"), ("demo", "demo_total", "demo_a_ratio"), ("enrol", "enrol_total", "enrol_minor_ratio"))


@_query(_F + ", " + ", ".join(f"s_{n} AS (SELECT date, state, district, sum({t})::DOUBLE AS {n}, avg({r}) AS {n}_ratio FROM {n[0]} GROUP BY ALL)" for n, t, r in _SERIES)
    + " SELECT date, state, district, " + ", ".join(f"coalesce({n}, 0) AS {n}, round(coalesce({n}_ratio, 0), 6) AS {n}_ratio, round(coalesce(CASE WHEN lag(coalesce({n}, 0)) OVER w = 0 THEN 0 ELSE (coalesce({n}, 0) - lag(coalesce({n}, 0)) OVER w) * 100.0 / lag(coalesce({n}, 0)) OVER w END, 0), 6) AS {n}_change_pct" for n, _, _ in _SERIES)
    + " FROM s_bio FULL JOIN s_demo USING (date, state, district) FULL JOIN s_enrol USING (date, state, district) WINDOW w AS (PARTITION BY state, district ORDER BY date)")
def region_series(s, d):
    """Totals, mean ratios and % change of all three tables by day and district."""
    keys = ["date", "state", "district"]
    parts = [df.groupBy(*keys).agg(F.sum(t).cast("double").alias(n), F.avg(r).alias(f"{n}_ratio")) for df, (n, t, r) in zip((_bio(s, d), _demo(s, d), _enrol(s, d)), _SERIES, strict=True)]
    rows, w = reports.outer_align(parts, keys), Window.partitionBy("state", "district").orderBy("date")
    return R(rows.withColumns({f"{n}_change_pct": percent_change(F.col(n), F.lag(n).over(w)) for n, _, _ in _SERIES}))


@_query(_F + " SELECT count(*) AS rows, count(DISTINCT state) AS distinct_state, count(DISTINCT district) AS distinct_district, count(DISTINCT pincode) AS distinct_pincode FROM e")
def panel_counts(s, d):
    return reports.counts(enrol(s, d), ["state", "district", "pincode"])


@_query(_F + """ SELECT 'bio' AS "table", count(*) AS rows, count(DISTINCT state) AS states, count(DISTINCT (state, district)) AS districts FROM b UNION ALL SELECT 'demo', count(*), count(DISTINCT state), count(DISTINCT (state, district)) FROM d UNION ALL SELECT 'enrol', count(*), count(DISTINCT state), count(DISTINCT (state, district)) FROM e""")
def audit_tables(s, d):
    return quality.audit({"bio": bio(s, d), "demo": demo(s, d), "enrol": enrol(s, d)})


@_query("WITH p AS (SELECT DISTINCT c_mktsegment AS state, n_name AS district FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT district, count(*) AS states, string_agg(state, ',' ORDER BY state) AS found_in FROM p GROUP BY district HAVING count(*) > 1")
def names_in_several_segments(s, d):
    """Names under more than one parent, on customers' nations and segments."""
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("state"), F.col("n_name").alias("district"))
    return quality.names_in_several_states([rows])


@_query(_F + " SELECT min(date) AS first, max(date) AS last, count(DISTINCT date) AS distinct_days, max(date) - min(date) + 1 AS expected_days, max(date) - min(date) + 1 - count(DISTINCT date) AS missing_days FROM e")
def enrol_date_completeness(s, d):
    return quality.date_completeness(enrol(s, d))


@_query(_F + ", x AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM e), (SELECT max(date) FROM e), INTERVAL 1 DAY)) AS DATE) AS date) SELECT date FROM x WHERE date NOT IN (SELECT date FROM e)")
def enrol_missing_dates(s, d):
    return quality.missing_dates(enrol(s, d))


@_query(_F + """ SELECT 'bio' AS "table", count(*) AS rows, count(*) FILTER (date IS NULL) AS null_dates FROM b UNION ALL SELECT 'enrol', count(*), count(*) FILTER (date IS NULL) FROM e""")
def null_date_audit(s, d):
    return quality.null_dates({"bio": bio(s, d), "enrol": enrol(s, d)})


@_query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_line_keys(s, d):
    return quality.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_line_keys(s, d):
    return quality.dedup(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"]).drop("l_quantity")


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_rows FROM customer" for c, t in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))
def customer_profile(s, d):
    return quality.profile(table(s, d, "customer"))


@_query("SELECT c_custkey, lower(trim(c_name)) AS key, upper(left(c_name, 1)) || lower(substr(c_name, 2)) AS title FROM customer")
def customer_name_forms(s, d):
    return table(s, d, "customer").select("c_custkey", text.name_key(F.col("c_name")).alias("key"), text.title(F.col("c_name")).alias("title"))


@_query(f"""WITH n AS (SELECT DISTINCT lower(replace(n_name, '_', ' ')) AS name FROM nation), r AS (SELECT DISTINCT lower(replace(n_name, 'NATION_', 'NATIONS ')) AS ref FROM nation), s AS (SELECT name, ref, (greatest(length(name), length(ref)) - levenshtein(name, ref)) * 100.0::DOUBLE / greatest(length(name), length(ref)) AS plain,
 (greatest(length(name), length(ref)) - levenshtein(array_to_string(list_sort(string_split(name, ' ')), ' '), array_to_string(list_sort(string_split(ref, ' ')), ' '))) * 100.0::DOUBLE / greatest(length(name), length(ref)) AS sorted FROM n, r),
 k AS (SELECT name, ref, greatest(plain, sorted) AS score, row_number() OVER (PARTITION BY name ORDER BY greatest(plain, sorted) DESC, ref) AS n, lead(greatest(plain, sorted)) OVER (PARTITION BY name ORDER BY greatest(plain, sorted) DESC, ref) AS runner_up FROM s)
SELECT name, CASE WHEN score >= 80 THEN ref END AS ref, round(CASE WHEN score >= 80 THEN score END, 6) AS score, round(CASE WHEN runner_up >= 80 THEN runner_up END, 6) AS runner_up FROM k WHERE n = 1""")
def fuzzy_top1(s, d):
    """Nation names matched with a misspelt list."""
    nation = table(s, d, "nation")
    left = nation.select(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("name"))
    right = nation.select(F.lower(F.replace("n_name", F.lit("NATION_"), F.lit("NATIONS "))).alias("ref"))
    return R(names.fuzzy_match(left, right, 80.0))


@_query("WITH b AS (SELECT c_custkey, c_mktsegment AS segment FROM customer) SELECT c_custkey, CASE segment WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'MACHINERY' THEN 'Industry' ELSE segment END AS segment FROM b")
def segment_remap(s, d):
    book = s.createDataFrame([("HOUSEHOLD", "Home"), ("MACHINERY", "Industry")], "old string, new string")
    return names.remap(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), book, "segment")[0]


@_query("SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' AND n_name = 'NATION_2' THEN 'Home two' ELSE n_name END AS name, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scoped_overrides(s, d):
    book = s.createDataFrame([("HOUSEHOLD", "NATION_2", "Home two")], "scope string, old string, new string")
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return names.apply_overrides(rows, book, "name", "segment")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('FURNITURE') AND NOT regexp_matches(c_mktsegment, '(?i)^build')")
def junk_removed(s, d):
    return names.drop_junk(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["FURNITURE"], ["^build"])


@_query(_F + " SELECT state, count(DISTINCT district) AS districts, string_agg(DISTINCT district, ',' ORDER BY district) AS names FROM e GROUP BY state")
def inventory_by_state(s, d):
    return names.region_inventory(enrol(s, d))


@_query("WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 0), p AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT coalesce(c.k, p.k) AS k, CASE WHEN c.k IS NULL THEN 'right' WHEN p.k IS NULL THEN 'left' ELSE 'both' END AS side FROM c FULL JOIN p ON c.k = p.k")
def reconcile_nations(s, d):
    left = table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return names.reconcile(left, table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), ["k"])


@_query(f"WITH {GRID}, {TOUCH} SELECT src, dst, w FROM touch")
def touching_regions(s, d):
    return geo.touch_edges(grid(s, d))


@_query(f"WITH {GRID} SELECT region, x, y, 1.0::DOUBLE AS area FROM cells")
def region_centroids(s, d):
    return R(geo.centroids(grid(s, d)))


_DIST = f"WITH {GRID}, p AS (SELECT a.region AS src, b.region AS dst, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS d FROM cells a JOIN cells b ON a.region <> b.region), dist AS (SELECT src, dst, exp(-((d / (SELECT max(d) FROM p)) ^ 2) / 0.1) AS w FROM p)"


def _distances(s, d):
    return graph.distance_edges(geo.centroids(grid(s, d)), 0.1, 0.1)


@_query(_DIST + " SELECT src, dst, round(w, 6) AS w FROM dist WHERE w >= 0.1")
def distance_weights(s, d):
    return R(_distances(s, d))


_SIM = _PROFILE + ", z AS (" + " UNION ALL ".join(f"SELECT district, '{c}' AS f, ({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS v FROM profile" for c in _PCOLS) + "), n AS (SELECT district, sqrt(sum(v * v)) AS n FROM z GROUP BY district), sim AS (SELECT a.district AS src, b.district AS dst, least(greatest(sum(a.v * b.v) / max(na.n) / max(nb.n), 0), 1) AS w FROM z a JOIN z b ON a.f = b.f AND a.district <> b.district JOIN n na ON na.district = a.district JOIN n nb ON nb.district = b.district GROUP BY ALL)"


def _similar(s, d):
    rows = cut(_profile(s, d).drop("state"))  # moments and rows
    return graph.similarity_edges(cluster.zscore_apply(rows, cluster.zscore_fit(rows, _PCOLS), _PCOLS), _PCOLS, 0.1, "district")


@_query(_SIM + " SELECT src, dst, round(w, 6) AS w FROM sim WHERE w >= 0.1")
def similarity_weights(s, d):
    return R(_similar(s, d))


@_query(_SIM + _DIST.replace("WITH ", ", ", 1) + " SELECT src, dst, round(coalesce(a.w, 0) * 0.5 + coalesce(b.w, 0) * 0.5, 6) AS w FROM (FROM dist WHERE w >= 0.1) a FULL JOIN (FROM sim WHERE w >= 0.1) b USING (src, dst)")
def combined_weights(s, d):
    return R(graph.combine_edges(_distances(s, d), _similar(s, d), 0.5))


@_query(f"WITH {GRID}, {TOUCH}, g AS (SELECT src, sum(w) AS g FROM touch GROUP BY src) SELECT t.src, t.dst, round(-w / sqrt(a.g * b.g), 6) AS w FROM touch t JOIN g a ON a.src = t.src JOIN g b ON b.src = t.dst UNION ALL SELECT region, region, 1.0 FROM cells")
def laplacian(s, d):
    return R(graph.laplacian_edges(geo.touch_edges(grid(s, d)), grid(s, d).select("region").distinct()))


@_query(f"WITH {GRID}, {TOUCH} SELECT (SELECT count(*) FROM cells) AS nodes, count(*) AS edges, round(count(*) / 600, 6) AS density, 1.0::DOUBLE AS max_weight, round(sum(w) / 25, 6) AS mean_degree, CAST(0 AS BIGINT) AS isolated FROM touch")
def graph_figures(s, d):
    return R(graph.graph_summary(geo.touch_edges(grid(s, d)), grid(s, d)))


_LAG = f"{_F}, {GRID}, {TOUCH}, v AS (SELECT district AS region, CAST(sum(enrol_total) AS DOUBLE) AS v FROM e GROUP BY ALL), z AS (SELECT region, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM v), l AS (SELECT z.region, any_value(z.z) AS z, coalesce(avg(n.z), 0) AS lag FROM z LEFT JOIN touch ON src = z.region LEFT JOIN z n ON n.region = dst GROUP BY z.region)"


def _values(s, d):
    return _enrol(s, d).groupBy(F.col("district").alias("region")).agg(F.sum("enrol_total").cast("double").alias("v"))


@_query(_LAG + " SELECT region, round(z, 6) AS z, round(lag, 6) AS lag FROM l")
def spatial_lags(s, d):
    return R(graph.spatial_lag(_values(s, d), geo.touch_edges(grid(s, d))))


@_query(_LAG + " SELECT round(sum(z * lag) / sum(z * z), 6) AS i, round(-1.0::DOUBLE / (count(*) - 1), 6) AS expected FROM l")
def morans_i(s, d):
    return R(graph.morans_i(_values(s, d), geo.touch_edges(grid(s, d))))


@_query(_LAG + " SELECT round(regr_slope(lag, z), 6) AS slope, round(regr_intercept(lag, z), 6) AS intercept FROM l")
def moran_slope(s, d):
    return R(graph.moran_slope(_values(s, d), geo.touch_edges(grid(s, d))))


def _tests(values: str, n_perms: int, where: str = "") -> str:
    """CTEs ``lags(feature, perm, region, z, lag)`` from ``values(feature, region, v)`` and the touching cells."""
    return f"""{values}, vz AS (SELECT feature, region, coalesce((v - avg(v) OVER f) / nullif(stddev_pop(v) OVER f, 0), 0) AS z FROM vals WINDOW f AS (PARTITION BY feature)),
 names AS (SELECT region, row_number() OVER (ORDER BY region) AS slot FROM (SELECT DISTINCT region FROM vals)),
 slots AS (SELECT perm, region, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm > 0 THEN md5('42:' || perm || ':' || region) END, region) AS slot FROM names, (SELECT unnest(range(0, {n_perms} + 1)) AS perm)),
 dealt AS (SELECT feature, perm, n.region, z FROM slots s JOIN names n USING (slot) JOIN vz ON vz.region = s.region), deg AS (SELECT src, sum(w) AS g FROM touch GROUP BY src),
 lag AS (SELECT feature, perm, t.src AS region, sum(w / g * z) AS lag FROM touch t JOIN deg USING (src) JOIN dealt ON dealt.region = t.dst GROUP BY ALL),
 lags AS (SELECT feature, perm, region, z, coalesce(lag, 0) AS lag FROM dealt LEFT JOIN lag USING (feature, perm, region)),
 each AS (SELECT feature, perm, coalesce(sum(z * lag) / nullif(sum(z * z), 0), 0) AS i, count(*) AS n FROM lags GROUP BY ALL), own AS (SELECT feature, i AS own FROM each WHERE perm = 0),
 tested AS (SELECT feature, own AS i, -1.0::DOUBLE / (max(n) - 1) AS expected, coalesce((own - avg(i)) / nullif(stddev_pop(i), 0), 0) AS z_score, avg(CASE WHEN abs(i) >= abs(own) - 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM each JOIN own USING (feature) WHERE perm > 0 GROUP BY feature, own),
 locals AS (SELECT region, z, lag, z * lag AS local_i FROM lags WHERE perm = 0), shares AS (SELECT region, avg(CASE WHEN abs(l.z * l.lag) >= abs(local_i) - 1e-12 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM lags l JOIN locals USING (region) WHERE perm > 0 GROUP BY region),
 lisa AS (SELECT region, z, lag, local_i, p, CASE WHEN p > 0.05 THEN 'NS' WHEN z > 0 AND lag > 0 THEN 'HH' WHEN z < 0 AND lag < 0 THEN 'LL' WHEN z > 0 AND lag < 0 THEN 'HL' ELSE 'LH' END AS class FROM locals JOIN shares USING (region))"""


_ONE = f"{_F}, {GRID}, {TOUCH}, vals AS (SELECT 'v' AS feature, district AS region, CAST(sum(enrol_total) AS DOUBLE) AS v FROM e GROUP BY ALL)"


@_query(_tests(_ONE, 999) + " SELECT round(i, 6) AS i, round(expected, 6) AS expected, round(z_score, 6) AS z_score, round(p, 6) AS p FROM tested")
def moran_permutation_test(s, d):
    return R(graph.morans_permutation(_values(s, d), geo.touch_edges(grid(s, d))))


@_query(_tests(_ONE, 999) + " SELECT region, round(z, 6) AS z, round(lag, 6) AS lag, round(local_i, 6) AS local_i, round(p, 6) AS p, class FROM lisa")
def lisa_clusters(s, d):
    return R(graph.lisa(_values(s, d), geo.touch_edges(grid(s, d))))


@_query(_tests(_ONE, 999) + " SELECT lisa.region, round(z, 6) AS z, round(lag, 6) AS lag, round(local_i, 6) AS local_i, round(p, 6) AS p, class, v FROM lisa JOIN vals ON vals.region = lisa.region WHERE class <> 'NS'")
def lisa_regions(s, d):
    """The regions of a significant class with their totals."""
    values = cut(_values(s, d))
    return R(graph.lisa_table(graph.lisa(values, geo.touch_edges(grid(s, d))), values))


@_query(_tests(f"{_PROFILE}, {GRID}, {TOUCH}, vals AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, district AS region, {c}::DOUBLE AS v FROM profile" for c in _PCOLS) + ")", 499) + " SELECT feature, round(i, 6) AS i, round(expected, 6) AS expected, round(z_score, 6) AS z_score, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM tested")
def moran_feature_sweep(s, d):
    """Every feature of the region profiles, tested in one job."""
    return R(graph.moran_sweep(cut(_profile(s, d).withColumnRenamed("district", "region")), _PCOLS, geo.touch_edges(grid(s, d)), 499))


@_query(_PROFILE + " SELECT district, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 6) AS {c}" for c in _PCOLS) + " FROM profile")
def zscores(s, d):
    rows = cut(_profile(s, d).drop("state"))  # moments and rows
    return R(cluster.zscore_apply(rows, cluster.zscore_fit(rows, _PCOLS), _PCOLS))


@_query(_PROFILE + " SELECT district, " + ", ".join(f"round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) AS {c}" for c in _PCOLS) + " FROM profile")
def minmax_scaled(s, d):
    return R(cluster.minmax(_profile(s, d).drop("state"), _PCOLS))


@_query(_PROFILE + ", r AS (SELECT district, state AS label, minor_ratio AS x, bio_ratio AS y FROM profile), m AS (SELECT a.district, a.label, b.label AS other, avg(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS d FROM r a JOIN r b ON a.district <> b.district GROUP BY ALL), ab AS (SELECT district, label, min(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM m GROUP BY ALL) SELECT district, label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM ab")
def silhouette_of_states(s, d):
    return R(cluster.silhouette(_profile(s, d).withColumn("label", F.col("state")), ["minor_ratio", "bio_ratio"], "district"))


@_query()
def kmeans_sizes(s, d):
    """Sizes of the best clustering of the region profiles."""
    return cluster.kmeans_sweep(_profile(s, d), _PCOLS, "district", n_init=10)[1].groupBy("label").agg(F.count("*").alias("regions"))


def _density(points: str, eps: float, min_pts: int) -> str:
    """CTEs that end in ``labelled(k, label)`` from ``points(k, x, y)``, by all pairs."""
    return f"""{points}, near AS (SELECT a.k, b.k AS k2 FROM points a JOIN points b ON (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 <= {eps}::DOUBLE ^ 2), core AS (SELECT k FROM near GROUP BY k HAVING count(*) >= {min_pts}),
 reach(k, root) AS (SELECT k, k FROM core UNION SELECT near.k2, reach.root FROM reach JOIN near ON near.k = reach.k WHERE near.k2 IN (SELECT k FROM core)), lab AS (SELECT k, min(root) AS l FROM reach GROUP BY k),
 every AS (SELECT k, l FROM lab UNION ALL SELECT near.k, min(l) FROM near JOIN lab ON lab.k = near.k2 WHERE near.k NOT IN (SELECT k FROM core) GROUP BY near.k),
 labelled AS (SELECT points.k, coalesce(CAST(dense_rank() OVER (PARTITION BY l IS NULL ORDER BY l) - 1 AS INTEGER) * CASE WHEN l IS NULL THEN 0 ELSE 1 END + CASE WHEN l IS NULL THEN -1 ELSE 0 END, -1) AS label FROM points LEFT JOIN every ON every.k = points.k)"""


@_query(_density(_PROFILE.replace("WITH ", "WITH RECURSIVE ", 1) + ", points AS (SELECT district AS k, (enrol_total - avg(enrol_total) OVER ()) / stddev_pop(enrol_total) OVER () AS x, (bio_total - avg(bio_total) OVER ()) / stddev_pop(bio_total) OVER () AS y FROM profile)", 0.8, 5) + " SELECT k AS district, label FROM labelled")
def density_clusters(s, d):
    rows = cut(_profile(s, d).drop("state"))  # moments and rows
    return cluster.dbscan(cluster.zscore_apply(rows, cluster.zscore_fit(rows, _PCOLS), _PCOLS), "district", "enrol_total", "bio_total")


@_query(_density("WITH RECURSIVE points AS (SELECT vec_id AS k, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)", 0.02, 4) + " SELECT k AS vec_id, label FROM labelled")
def density_of_vectors(s, d):
    """Clusters of the first two coordinates of all vectors."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return cluster.dbscan(table(s, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y")), "vec_id", eps=0.02, min_pts=4)


_SIL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS v, label % 2 AS half, label, vec_id % 7 AS id_mod FROM embeddings),
 d AS (SELECT a.vec_id, a.label, a.half, a.id_mod, b.vec_id AS other, b.label AS other_label, b.half AS other_half, b.id_mod AS other_mod, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
 m AS (SELECT 'label' AS labels, vec_id, label AS own, other_label AS other, avg(d) AS d FROM d GROUP BY ALL UNION ALL SELECT 'half', vec_id, half, other_half, avg(d) FROM d GROUP BY ALL UNION ALL SELECT 'id_mod', vec_id, id_mod, other_mod, avg(d) FROM d GROUP BY ALL),
 ab AS (SELECT labels, vec_id, min(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b, count(DISTINCT other) AS n FROM m GROUP BY ALL)
SELECT labels, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS rows, CAST(max(n) AS INTEGER) AS clusters FROM ab GROUP BY labels"""


@_query(_SIL)
def silhouettes_of_labels(s, d):
    """Mean silhouettes of all vectors under three labellings, from one pass over the pairs."""
    rows = table(s, d, "embeddings").select("vec_id", "embedding", "label", (F.col("label") % 2).alias("half"), (F.col("vec_id") % 7).alias("id_mod"))
    return R(cluster.silhouettes(rows, "embedding", ["label", "half", "id_mod"]))


_RING = """ring AS (SELECT n_name AS node, lead(n_name, 1, (SELECT min(n_name) FROM nation)) OVER (ORDER BY n_name) AS next FROM nation), two AS (SELECT node AS src, next AS dst FROM ring UNION ALL SELECT next, node FROM ring),
 lambda_max AS (SELECT 1 - cos(2 * pi() * floor(count(*) / 2) / count(*)) AS m FROM ring)"""


def _ring(s, d):
    """Nations by name in a ring, as the edges of its normalised Laplacian."""
    names = table(s, d, "nation").select(F.col("n_name").alias("region"))
    after = F.coalesce(F.lead("region").over(Window.orderBy("region")), F.min("region").over(Window.partitionBy(F.lit(0))))
    return graph.laplacian_edges(geo.mirrored(names.select(F.col("region").alias("src"), after.alias("dst"), F.lit(1.0).alias("w"))), names)


@_query(f"WITH {_RING} SELECT round(m, 6) AS lambda_max, (SELECT count(*) FROM two) + (SELECT count(*) FROM ring) AS entries FROM lambda_max")
def ring_eigenvalue(s, d):
    """The largest eigenvalue of a ring, whose eigenvalues are known: one less a cosine."""
    edges = cut(_ring(s, d))
    return edges.agg(F.lit(round(graph.largest_eigenvalue(edges), 6)).alias("lambda_max"), F.count("*").alias("entries"))


@_query(_F + f""", {_RING}, p AS (SELECT strftime(date, '%Y-%m') AS t, district AS node, CAST(sum(enrol_total) AS DOUBLE) AS v FROM e GROUP BY ALL), lt AS (SELECT src, dst, -1.0::DOUBLE / m AS w FROM two, lambda_max UNION ALL SELECT node, node, 2 / m - 1 FROM ring, lambda_max),
 c1 AS (SELECT t, src AS node, sum(w * v) AS v1 FROM p JOIN lt ON dst = node GROUP BY ALL), x AS (SELECT p.*, coalesce(v1, 0) AS v1 FROM p LEFT JOIN c1 USING (t, node)), c2 AS (SELECT t, src AS node, sum(w * v1) AS v2 FROM x JOIN lt ON dst = node GROUP BY ALL)
SELECT t, node, round(v, 4) AS v_cheb0, round(v1, 4) AS v_cheb1, round(2 * coalesce(v2, 0) - v, 4) AS v_cheb2 FROM x LEFT JOIN c2 USING (t, node)""")
def chebyshev_on_ring(s, d):
    """Diffusion terms with the Laplacian scaled by its own largest eigenvalue."""
    edges = cut(_ring(s, d))
    lt = graph.scaled_laplacian(edges, graph.largest_eigenvalue(edges))
    panel = _enrol(s, d).groupBy(features.month_label("date").alias("t"), F.col("district").alias("node")).agg(F.sum("enrol_total").cast("double").alias("v"))
    out = forecast.chebyshev_features(panel, lt, ["v"], 3)
    return out.withColumns({c: F.round(c, 4) for c, kind in out.dtypes if kind == "double"})


@_query(_PROFILE + ", q AS (SELECT count(*) AS n FROM profile) SELECT n AS regions, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2, 0.0::DOUBLE AS product, true AS falling, true AS below_all FROM q")
def component_figures(s, d):
    """Two components of the profiles: centred, without correlation, the first with more of the variance, both with no more than there is."""
    pcs = cut(cluster.pca2(_profile(s, d), _PCOLS, "district")[0])
    zero = lambda c: F.abs(F.round(c, 6)) + 0.0
    return pcs.agg(F.count("*").alias("regions"), zero(F.avg("pc1")).alias("mean1"), zero(F.avg("pc2")).alias("mean2"), zero(F.avg(F.col("pc1") * F.col("pc2"))).alias("product"), (F.var_pop("pc1") >= F.var_pop("pc2")).alias("falling"), (F.var_pop("pc1") + F.var_pop("pc2") <= len(_PCOLS) + 1e-9).alias("below_all"))


@_query()
def principal_components(s, d):
    return cluster.pca2(_profile(s, d), _PCOLS, "district")[0]


@_query(_F + f""", {GRID}, {TOUCH}, g AS (SELECT src, sum(w) AS g FROM touch GROUP BY src), lt AS (SELECT t.src, t.dst, -w / sqrt(a.g * b.g) AS w FROM touch t JOIN g a ON a.src = t.src JOIN g b ON b.src = t.dst),
 p AS (SELECT strftime(date, '%Y-%m') AS t, district AS node, CAST(sum(enrol_total) AS DOUBLE) AS v FROM e GROUP BY ALL), c1 AS (SELECT t, src AS node, sum(w * v) AS v1 FROM p JOIN lt ON dst = node GROUP BY ALL), x AS (SELECT p.*, coalesce(v1, 0) AS v1 FROM p LEFT JOIN c1 USING (t, node)), c2 AS (SELECT t, src AS node, sum(w * v1) AS v2 FROM x JOIN lt ON dst = node GROUP BY ALL)
SELECT t, node, round(v, 6) AS v_cheb0, round(v1, 6) AS v_cheb1, round(2 * coalesce(v2, 0) - v, 6) AS v_cheb2 FROM x LEFT JOIN c2 USING (t, node)""")
def chebyshev_terms(s, d):
    lt = graph.scaled_laplacian(graph.laplacian_edges(geo.touch_edges(grid(s, d)), grid(s, d).select("region").distinct()))
    panel = _enrol(s, d).groupBy(features.month_label("date").alias("t"), F.col("district").alias("node")).agg(F.sum("enrol_total").cast("double").alias("v"))
    return R(forecast.chebyshev_features(panel, lt, ["v"], 3))


_NAIVE = _GRID + ", nv AS (SELECT district, enrol_total::DOUBLE AS y, lag(enrol_total) OVER (PARTITION BY district ORDER BY week)::DOUBLE AS prediction FROM dense), ok AS (FROM nv WHERE prediction IS NOT NULL)"


def _naive(s, d):
    w = Window.partitionBy("district").orderBy("week")
    return _dense(s, d).select("district", F.col("enrol_total").cast("double").alias("y"), F.lag("enrol_total").over(w).cast("double").alias("prediction")).where("prediction IS NOT NULL")


@_query(_NAIVE + " SELECT district, count(*) AS n, round(avg(abs(y - prediction)), 6) AS mae, round(sqrt(avg((y - prediction) ^ 2)), 6) AS rmse, round(avg(abs(y - prediction) / abs(y)) FILTER (abs(y) > 0.05) * 100, 6) AS mape_masked, round(avg(abs(y - prediction) * 200.0 / nullif(abs(y) + abs(prediction), 0)), 6) AS smape, round(1 - sum((y - prediction) ^ 2) / nullif(var_pop(y) * count(*), 0), 6) AS r2 FROM ok GROUP BY district")
def naive_forecast_metrics(s, d):
    """Measures of last week's value as a forecast, by region."""
    return R(forecast.forecast_metrics(_naive(s, d), ["district"]).drop("mape"))


@_query(_WEEK + ", t AS (SELECT week, CAST(sum(enrol_total) AS DOUBLE) AS total FROM w GROUP BY week) SELECT week, total, round(total * 0.92, 6) AS low, round(total * 1.08, 6) AS high, round((total - (SELECT arg_min(total, week) FROM t)) * 100 / (SELECT arg_min(total, week) FROM t), 6) AS trend_pct FROM t")
def weekly_band_and_trend(s, d):
    rows = series.weekly_panel(_enrol(s, d), "district", ["enrol_total"], []).withColumn("enrol_total", F.col("enrol_total").cast("double"))
    return R(forecast.forecast_summary(rows, "week", "enrol_total"))


@_query()
def panel_forecast(s, d):
    """Test predictions of the lag and diffusion model on weekly enrolment."""
    lt = graph.scaled_laplacian(graph.laplacian_edges(geo.touch_edges(grid(s, d)), grid(s, d).select("region").distinct()))
    panel = _dense(s, d).select(F.col("week").alias("t"), F.col("district").alias("node"), F.col("enrol_total").cast("double").alias("v"))
    return forecast.fit_panel_forecaster(panel, lt, "v")[1]


@_query("SELECT event_id, user_id, event_type FROM events WHERE contains(lower(event_type), 'err') OR contains(lower(props), '\"k\": 6')")
def substring_search(s, d):
    return features.search(table(s, d, "events"), "ERR", ["event_type"]).unionByName(features.search(table(s, d, "events"), '"K": 6', ["props"])).select("event_id", "user_id", "event_type").distinct()


@_query("SELECT user_id, round(sum(value), 6) AS v FROM events GROUP BY user_id ORDER BY v DESC, user_id LIMIT 10")
def top_users(s, d):
    return reports.top_n(table(s, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("v")), "v", 10, "user_id")


@_query("SELECT n_name || ' | ' || r_name AS key, n_name AS district, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey")
def composite_keys(s, d):
    rows = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return features.split_key(features.composite_key(rows, ["n_name", "r_name"]).select("key"), "key", ["district", "state"])


@_query("SELECT l_shipmode_key AS k, rows FROM (SELECT l_returnflag AS l_shipmode_key, count(*) AS rows FROM lineitem WHERE l_quantity >= 0 AND l_discount IS NOT NULL GROUP BY 1)")
def validated_lines(s, d):
    ok, _ = tables.validate(table(s, d, "lineitem"), {"quantity": F.col("l_quantity") >= 0, "discount": F.col("l_discount").isNotNull()})
    return ok.groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("rows"))
