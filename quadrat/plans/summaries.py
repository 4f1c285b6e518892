"""Panels with their features, and the summaries by state, day and district that rest on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import features, reports
from quadrat.plans.panels import PANELS, bio, demo, enrol, table
from quadrat.plans.registry import query

R = features.rounded
KEYS = ["state", "district", "pincode"]


def _bio(s, d):
    """Biometric panel with its pair features."""
    return features.pair_features(bio(s, d), "bio_age_5_17", "bio_age_17_", "bio")


def _demo(s, d):
    return features.pair_features(demo(s, d), "demo_age_5_17", "demo_age_17_", "demo")


def _enrol(s, d):
    return features.group_features(enrol(s, d), ["age_0_5", "age_5_17"], ["age_18_greater"], "enrol")


_F = PANELS + """, b AS (SELECT *, bio_age_5_17 + bio_age_17_ AS bio_total, bio_age_5_17 / (bio_age_5_17 + bio_age_17_ + 1) AS bio_a_ratio, bio_age_17_ / (bio_age_5_17 + bio_age_17_ + 1) AS bio_b_ratio,
  CASE WHEN bio_age_5_17 > bio_age_17_ THEN '0-5' ELSE '5-17' END AS bio_dominant, bio_age_5_17 / (bio_age_17_ + 1) AS bio_dependency FROM bio),
d AS (SELECT *, demo_age_5_17 + demo_age_17_ AS demo_total, demo_age_5_17 / (demo_age_5_17 + demo_age_17_ + 1) AS demo_a_ratio, demo_age_17_ / (demo_age_5_17 + demo_age_17_ + 1) AS demo_b_ratio,
  demo_age_5_17 / (demo_age_17_ + 1) AS demo_dependency FROM demo),
e AS (SELECT *, age_0_5 + age_5_17 + age_18_greater AS enrol_total, (age_0_5 + age_5_17) / (age_0_5 + age_5_17 + age_18_greater + 1.0::DOUBLE) AS enrol_minor_ratio,
  age_18_greater / (age_0_5 + age_5_17 + age_18_greater + 1.0::DOUBLE) AS enrol_adult_ratio FROM enrol)"""  # fmt: skip


def _grown(df, col, order):
    """With change, growth, and mean and deviation of the last seven rows of a place; over all days, before any filter."""
    return features.growth_features(df, col, KEYS, order)


def _sql_grown(source, col, order):
    return f"""{source}g AS (SELECT *, coalesce({col} - lag({col}) OVER w, 0)::DOUBLE AS daily_change, coalesce(CASE WHEN lag({col}) OVER w <> 0 THEN ({col} - lag({col}) OVER w) * 100.0::DOUBLE / lag({col}) OVER w END, 0) AS daily_pct_change,
  avg({col}) OVER r AS {col}_7day_avg, coalesce(stddev_samp({col}) OVER r, 0) AS {col}_7day_std FROM {source} WINDOW w AS (PARTITION BY state, district, pincode ORDER BY {order}), r AS (PARTITION BY state, district, pincode ORDER BY {order} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


_GROWN = ", ".join((_F, _sql_grown("b", "bio_total", "date"), _sql_grown("d", "demo_total", "date"), _sql_grown("e", "enrol_total", "date, id")))


def _bio_grown(s, d):
    return _grown(_bio(s, d), "bio_total", ["date"])


def _demo_grown(s, d):
    return _grown(_demo(s, d), "demo_total", ["date"])


def _enrol_grown(s, d):
    return _grown(_enrol(s, d), "enrol_total", ["date", "id"])


#: Order dates and ship dates are the panels' days: every order has a customer, every line an order and a supplier.
_COMMON = "common AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem), snaps AS (SELECT date FROM common WHERE day(date) = 1)"


def _common(s, d):
    """The days that all panels have, from the facts' date columns alone: no join and no panel is built for them."""
    days = [table(s, d, t).select(F.to_date(c).alias("date")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return features.common_dates(days)


# sums and means of the reports: new name to column
_BIO = {"bio_total": "bio_total"}, {"avg_bio_a_ratio": "bio_a_ratio", "avg_bio_b_ratio": "bio_b_ratio", "avg_dependency": "bio_dependency", "avg_bio_growth": "daily_pct_change", "avg_bio_volatility": "bio_total_7day_std"}
_DEMO = {"demo_total": "demo_total"}, {"avg_demo_a_ratio": "demo_a_ratio", "avg_demo_dependency": "demo_dependency", "avg_demo_growth": "daily_pct_change"}
_ENROL = {"enrol_total": "enrol_total"}, {"avg_minor_ratio": "enrol_minor_ratio", "avg_adult_ratio": "enrol_adult_ratio", "avg_enrol_growth": "daily_pct_change", "avg_enrol_volatility": "enrol_total_7day_std"}


def _sql_aggs(sums, means):
    return ", ".join([f"CAST(sum({c}) AS DOUBLE) AS {n}" for n, c in sums.items()] + [f"avg({c}) AS {n}" for n, c in means.items()])


def _summary(df, keys, sums, means, distinct={}):
    """Sums as doubles, so that three tables line up."""
    out = reports.summarise(df, keys, sums, means, distinct)
    return out.withColumns({n: F.col(n).cast("double") for n in sums})


_ALL = [*_BIO[0], *_BIO[1], *_DEMO[0], *_DEMO[1], *_ENROL[0], *_ENROL[1]]
_FILLED = ", ".join(f"round(round(coalesce({n}, 0), 10), 6) + 0.0::DOUBLE AS {n}" for n in _ALL)


def _sql_aligned(keys, where, count=""):
    """The three aggregates side by side; ``count`` is one more of the first."""
    parts = [f"(SELECT {keys}, {_sql_aggs(*spec)}{count if t == 'bg' else ''} FROM {t} {where} GROUP BY {keys})" for t, spec in (("bg", _BIO), ("dg", _DEMO), ("eg", _ENROL))]
    return f"{parts[0]} FULL JOIN {parts[1]} USING ({keys}) FULL JOIN {parts[2]} USING ({keys})"


@query(f"""{_GROWN}, {_COMMON}, s AS (SELECT * FROM {_sql_aligned('state', 'WHERE date IN (FROM snaps)', ', count(DISTINCT district) AS district_count')})
SELECT state, CAST(row_number() OVER (ORDER BY coalesce(enrol_total, 0) DESC, state) AS INTEGER) AS enrol_rank, {_FILLED}, coalesce(district_count, 0) AS district_count FROM s""")
def state_summary(s, d):
    """States over the monthly snapshots that all three panels have, ranked by enrolment: 16 measures."""
    snaps = F.broadcast(features.snapshot_dates(_common(s, d)))  # a subset of the calendar's days
    parts = [
        _summary(features.filter_dates(_bio_grown(s, d), snaps), ["state"], *_BIO, {"district_count": "district"}),
        _summary(features.filter_dates(_demo_grown(s, d), snaps), ["state"], *_DEMO),
        _summary(features.filter_dates(_enrol_grown(s, d), snaps), ["state"], *_ENROL),
    ]
    return R(reports.rank_by(reports.outer_align(parts, ["state"]), "enrol_total", "state", "enrol_rank"))


@query(f"{_GROWN}, s AS (SELECT * FROM {_sql_aligned('state, district', '')}) SELECT state, district, {_FILLED} FROM s")
def region_profile(s, d):
    """One row for each district: totals, ratios, growth and volatility of the three panels over all days."""
    keys = ["state", "district"]
    return R(reports.outer_align([_summary(_bio_grown(s, d), keys, *_BIO), _summary(_demo_grown(s, d), keys, *_DEMO), _summary(_enrol_grown(s, d), keys, *_ENROL)], keys))


def _daily_spec(total, groups, ratios):
    """Sums of the groups and their total; means of the ratios, the windows, growth and change."""
    sums = {c: c for c in (*groups, total)}
    return sums, {f"avg_{c}": c for c in (*ratios, f"{total}_7day_avg", f"{total}_7day_std", "daily_pct_change", "daily_change")}


_DAILY = {
    "bio": (_bio_grown, "bg", _daily_spec("bio_total", ["bio_age_5_17", "bio_age_17_"], ["bio_a_ratio", "bio_b_ratio", "bio_dependency"])),
    "demo": (_demo_grown, "dg", _daily_spec("demo_total", ["demo_age_5_17", "demo_age_17_"], ["demo_a_ratio", "demo_b_ratio", "demo_dependency"])),
    "enrol": (_enrol_grown, "eg", _daily_spec("enrol_total", ["age_0_5", "age_5_17", "age_18_greater"], ["enrol_minor_ratio", "enrol_adult_ratio"])),
}


def _daily(s, d, name):
    make, _, spec = _DAILY[name]
    return _summary(features.filter_dates(make(s, d), F.broadcast(_common(s, d))), ["date", "state"], *spec)


def _sql_daily(name):
    _, source, spec = _DAILY[name]
    return f"daily_{name} AS (SELECT date, state, {_sql_aggs(*spec)} FROM {source} WHERE date IN (FROM common) GROUP BY date, state)"


for _name, (_, _, (_sums, _means)) in _DAILY.items():

    def _report(s, d, name=_name):
        """Sums and means by day and state on the common days."""
        return R(_daily(s, d, name))

    _report.__name__ = f"daily_state_{_name}"
    query(f"{_GROWN}, {_COMMON}, {_sql_daily(_name)} SELECT date, state, " + ", ".join(f"round(round({n}, 10), 6) + 0.0::DOUBLE AS {n}" for n in (*_sums, *_means)) + f" FROM daily_{_name}")(_report)


@query(f"""{_GROWN}, {_COMMON}, x AS (SELECT date, state, CAST(sum(enrol_total) AS DOUBLE) AS enrol_total, avg(daily_pct_change) AS avg_growth, avg(enrol_total_7day_avg) AS rolling_avg, avg(enrol_total_7day_std) AS volatility FROM eg WHERE date IN (FROM common) GROUP BY ALL),
 y AS (SELECT date, state, sum(bio_total) AS bio_total FROM b WHERE date IN (FROM common) GROUP BY ALL)
SELECT date, state, enrol_total, round(avg_growth, 6) AS avg_growth, round(rolling_avg, 6) AS rolling_avg, round(volatility, 6) AS volatility, bio_total FROM x LEFT JOIN y USING (date, state)""")
def daily_state_series(s, d):
    """Enrolment by day and state with growth, rolling mean and volatility, and the biometric total beside it."""
    days = F.broadcast(_common(s, d))
    means = {"avg_growth": "daily_pct_change", "rolling_avg": "enrol_total_7day_avg", "volatility": "enrol_total_7day_std"}
    x = _summary(features.filter_dates(_enrol_grown(s, d), days), ["date", "state"], {"enrol_total": "enrol_total"}, means)
    y = reports.summarise(features.filter_dates(_bio(s, d), days), ["date", "state"], {"bio_total": "bio_total"})
    return R(reports.with_measure(x, y, ["date", "state"]))


@query(f"""{_GROWN}, {_COMMON}, {_sql_daily('bio')} SELECT state, sum(bio_total) AS bio_total, round(avg(avg_bio_dependency), 6) AS dependency, round(avg(avg_daily_pct_change), 6) AS growth, round(avg(avg_bio_total_7day_std), 6) AS volatility FROM daily_bio GROUP BY state""")
def state_rollup(s, d):
    """The daily table by state: total, and the means of its daily means."""
    means = {"dependency": "avg_bio_dependency", "growth": "avg_daily_pct_change", "volatility": "avg_bio_total_7day_std"}
    return R(reports.summarise(_daily(s, d, "bio"), ["state"], {"bio_total": "bio_total"}, means))
