"""Tensor decompositions on the panels: cells against SQL, factors by what they must fulfil."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions.cut import cut
from quadrat.operators import features, tensor
from quadrat.plans.panels import table
from quadrat.plans.registry import query as _query
from quadrat.plans.summaries import _F, _bio, _enrol

R = features.rounded


def panel_tensor(s, d):
    month = lambda df: df.withColumn("month", features.month_label("date"))
    return tensor.build_tensor({"bio": month(_bio(s, d)), "enrol": month(_enrol(s, d))}, {"bio": ["bio_total", "bio_a_ratio"], "enrol": ["enrol_total", "enrol_minor_ratio"]}, "district", "month")


_MEANS = " UNION ALL ".join(f"SELECT district AS i, strftime(date, '%Y-%m') AS j, '{t}__{c}' AS k, avg({c}) AS v FROM {t[0]} GROUP BY ALL" for t, c in (("bio", "bio_total"), ("bio", "bio_a_ratio"), ("enrol", "enrol_total"), ("enrol", "enrol_minor_ratio")))
_TENSOR = _F + f""", means AS ({_MEANS}), filled AS (
  SELECT i, j, k, coalesce(v, avg(v) OVER (PARTITION BY j, k), 0) AS v FROM (FROM (SELECT DISTINCT i FROM means), (SELECT DISTINCT j FROM means), (SELECT DISTINCT k FROM means)) LEFT JOIN means USING (i, j, k)),
 tensor AS (SELECT i, j, k, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS value FROM filled WINDOW w AS (PARTITION BY k))"""


@_query(_TENSOR + " SELECT i, j, k, round(value, 6) AS value FROM tensor")
def tensor_cells(s, d):
    return R(panel_tensor(s, d))


@_query(_TENSOR + " SELECT count(DISTINCT i) AS size_i, count(DISTINCT j) AS size_j, count(DISTINCT k) AS size_k, count(*) AS cells, abs(round(avg(value), 6)) AS mean, round(stddev_pop(value), 6) AS std FROM tensor")
def tensor_figures(s, d):
    """The dense tensor's sizes; its features are standardised."""
    return tensor.tensor_summary(panel_tensor(s, d)).withColumns({"mean": F.abs(F.round("mean", 6)), "std": F.round("std", 6)})


@_query()
def cp_components(s, d):
    """Weights of a two-component decomposition of the region x month x feature tensor."""
    return tensor.component_variance(tensor.loadings(tensor.cp_als(panel_tensor(s, d), 2)[0]))


def _misfit(coo, factors, error, core=None):
    """Is the error that was returned the one of the cells that the factors make?"""
    beside = tensor.reconstruct(factors, coo, core)
    norm = F.sqrt(F.sum(F.pow(F.col("value") - F.col("model"), 2)) / F.sum(F.col("value") * F.col("value")))
    return beside.agg(F.count("*").alias("cells"), (F.abs(norm - error) < 1e-6).alias("error_agrees"))


@_query(_TENSOR + " SELECT count(*) AS cells, true AS error_agrees, true AS stationary, 2 * count(DISTINCT i) AS slopes FROM tensor")
def cp_checks(s, d):
    """The error recomputed from the factors; and no step along any region's factors makes it smaller: residuals are
    orthogonal to the outer products of the other modes."""
    coo = cut(panel_tensor(s, d))
    factors, error = tensor.cp_als(coo, 2)
    beside = tensor.reconstruct(factors, coo).join(factors["j"].withColumnRenamed("f", "fj"), "j").join(factors["k"].withColumnRenamed("f", "fk"), "k")
    pull = F.posexplode(F.zip_with("fj", "fk", lambda x, y: x * y))
    slopes = beside.select("i", (F.col("value") - F.col("model")).alias("off"), "value", pull.alias("component", "x")).groupBy("i", "component").agg(F.sum(F.col("off") * F.col("x")).alias("slope"), F.sum(F.abs(F.col("value") * F.col("x"))).alias("scale"))
    ends = slopes.agg(F.every(F.abs("slope") < 1e-2 * F.col("scale") + 1e-9).alias("stationary"), F.count("*").alias("slopes"))
    return _misfit(coo, factors, error).join(ends)


@_query(_TENSOR + " SELECT rank, true AS falls FROM (SELECT unnest([1, 2, 3]) AS rank) WHERE (SELECT count(*) FROM tensor) > 0")
def cp_rank_sweep(s, d):
    """Errors of one to three components, none above the one before."""
    errors = tensor.cp_sweep(panel_tensor(s, d), [1, 2, 3]).collect()
    rows = [(r.rank, i == 0 or r.error <= errors[i - 1].error + 1e-6) for i, r in enumerate(errors)]
    return s.createDataFrame(rows, "rank int, falls boolean")


#: Two outer products of counts and of deviations, over nations, months of orders and priorities.
_OUTER = """WITH oc AS (SELECT n_name AS i, strftime(o_orderdate, '%Y-%m') AS j, o_orderpriority AS k, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 m AS (SELECT avg(p) AS p, count(*) AS n FROM oc), fi AS (SELECT i, count(*) * 25.0 / (SELECT n FROM m) AS x, avg(p) / (SELECT p FROM m) - 1 AS y FROM oc GROUP BY i),
 fj AS (SELECT j, count(*) * 80.0 / (SELECT n FROM m) AS x, avg(p) / (SELECT p FROM m) - 1 AS y FROM oc GROUP BY j), fk AS (SELECT k, count(*) * 5.0 / (SELECT n FROM m) AS x, (avg(p) / (SELECT p FROM m) - 1) * 10000 AS y FROM oc GROUP BY k),
 outer_cells AS (SELECT i, j, k, fi.x * fj.x * fk.x + fi.y * fj.y * fk.y AS value FROM fi, fj, fk)"""


def _outer(s, d):
    place = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("i"))
    rows = cut(table(s, d, "orders").join(place, "o_custkey").select("i", features.month_label(F.to_date("o_orderdate")).alias("j"), F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("p")))
    price, n = rows.agg(F.avg("p"), F.count("*")).first()
    sides = [rows.groupBy(m).agg((F.count("*") * scale / n).alias(f"x{m}"), ((F.avg("p") / price - 1) * stretch).alias(f"y{m}")) for m, scale, stretch in (("i", 25.0, 1.0), ("j", 80.0, 1.0), ("k", 5.0, 10000.0))]
    cells = sides[0].crossJoin(sides[1]).crossJoin(sides[2])  # the dense tensor asked for
    return cut(cells.select("i", "j", "k", (F.col("xi") * F.col("xj") * F.col("xk") + F.col("yi") * F.col("yj") * F.col("yk")).alias("value")))


def _agreeing(cells):
    return R(cells.select("i", "j", "k", "value", (F.abs(F.col("model") - F.col("value")) < 1e-4).alias("agrees")))


@_query(_OUTER + " SELECT i, j, k, round(value, 6) AS value, true AS agrees FROM outer_cells")
def cp_of_outer_products(s, d):
    """A tensor made of two outer products comes back from two components, every cell."""
    coo = _outer(s, d)
    return _agreeing(tensor.reconstruct(tensor.cp_als(coo, 2, tol=1e-12)[0], coo))


@_query(_OUTER + " SELECT i, j, k, round(value, 6) AS value, true AS agrees FROM outer_cells")
def tucker_of_outer_products(s, d):
    """The same from a core of 2 x 2 x 2."""
    coo = _outer(s, d)
    factors, core, _ = tensor.tucker_hooi(coo, (2, 2, 2))
    return _agreeing(tensor.reconstruct(factors, coo, core))


@_query(_TENSOR + " SELECT count(*) AS cells, true AS error_agrees, true AS orthonormal FROM tensor")
def tucker_checks(s, d):
    """Ranks by the sizes of the panel tensor: the error recomputed from factors and core; all factors orthonormal."""
    coo = cut(panel_tensor(s, d))
    sizes = coo.agg(*[F.countDistinct(m) for m in tensor.MODES]).first()
    factors, core, error = tensor.tucker_hooi(coo, tensor.tucker_ranks(sizes))
    long = tensor.loadings(factors)
    other = long.select("mode", "index", F.col("component").alias("other"), F.col("loading").alias("beside"))
    dots = long.join(other, ["mode", "index"]).groupBy("mode", "component", "other").agg(F.sum(F.col("loading") * F.col("beside")).alias("dot"))
    unit = dots.agg(F.every(F.abs(F.col("dot") - F.when(F.col("component") == F.col("other"), 1.0).otherwise(0.0)) < 1e-6).alias("orthonormal"))
    return _misfit(coo, factors, error, core).join(unit)


@_query(_TENSOR + " SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS feature_rank, true AS falls, count(*) AS cells FROM tensor")
def tucker_rank_sweep(s, d):
    coo = cut(panel_tensor(s, d))
    errors = tensor.tucker_sweep(coo, (8, 8, 3), [1, 2, 3], tol=1e-6).collect()  # errors are compared to 1e-6
    rows = [(r.feature_rank, i == 0 or r.error <= errors[i - 1].error + 1e-6) for i, r in enumerate(errors)]
    return s.createDataFrame(rows, "feature_rank int, falls boolean").join(coo.agg(F.count("*").alias("cells")))


#: Loadings as in a factor table: regions and features by two components, here standardised monthly figures.
_LONG = _TENSOR + """, long AS (SELECT 'i' AS mode, i AS index, CASE WHEN k = 'bio__bio_total' THEN 0 ELSE 1 END AS component, sum(value) AS loading FROM tensor WHERE k IN ('bio__bio_total', 'enrol__enrol_total') GROUP BY ALL
  UNION ALL SELECT 'k', k, CAST(substr(j, 6, 2) AS INTEGER) % 2, sum(value * CAST(substr(j, 7, 1) AS INTEGER)) / 10 FROM tensor GROUP BY ALL)"""


def _long(s, d):
    coo = cut(panel_tensor(s, d))
    regions = coo.where(F.col("k").isin("bio__bio_total", "enrol__enrol_total")).groupBy(F.col("i").alias("index"), F.when(F.col("k") == "bio__bio_total", 0).otherwise(1).alias("component")).agg(F.sum("value").alias("loading"))
    month = F.substring("j", 6, 2).cast("int")
    kinds = coo.groupBy(F.col("k").alias("index"), (month % 2).alias("component")).agg((F.sum(F.col("value") * F.substring("j", 7, 1).cast("int")) / 10).alias("loading"))
    return regions.select(F.lit("i").alias("mode"), "*").unionByName(kinds.select(F.lit("k").alias("mode"), "*"))


@_query(_LONG + """, n AS (SELECT mode, component, sqrt(sum(loading * loading)) AS n FROM long GROUP BY ALL), w AS (SELECT component, product(n) AS weight FROM n GROUP BY component)
SELECT component, round(weight, 4) AS weight, round(weight / sum(weight) OVER (), 6) AS share, round(sum(weight) OVER (ORDER BY weight DESC, component) / sum(weight) OVER (), 6) AS cumulative_share FROM w""")
def component_shares(s, d):
    return R(tensor.component_variance(_long(s, d))).withColumn("weight", F.round("weight", 4))


@_query(_LONG + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, index) AS INTEGER) AS place FROM long WHERE mode = 'i') SELECT mode, index, component, round(loading, 6) AS loading, place FROM r WHERE place <= 10")
def component_top_regions(s, d):
    return R(tensor.top_loadings(_long(s, d), "i", 10))


@_query(_LONG + """, m AS (SELECT component, split_part(index, '__', 1) AS source, avg(abs(loading)) AS mean_loading FROM long WHERE mode = 'k' GROUP BY ALL), a AS (SELECT *, count(*) FILTER (mean_loading >= 0.2) OVER (PARTITION BY component) AS active FROM m)
SELECT component, source, round(mean_loading, 6) AS mean_loading, active, CASE WHEN active >= 3 THEN 'all tables' WHEN active = 2 THEN 'two tables' WHEN active = 1 THEN 'one table' ELSE 'none' END AS kind FROM a""")
def component_source_tables(s, d):
    return R(tensor.component_sources(_long(s, d)))


@_query(_LONG + " SELECT round(corr(a.loading, b.loading), 6) AS r FROM long a JOIN long b ON a.mode = 'i' AND b.mode = 'i' AND a.index = b.index AND a.component = 0 AND b.component = 1")
def component_pair_correlation(s, d):
    return R(tensor.component_correlation(_long(s, d), 0, 1))


@_query(_LONG + """, names AS (SELECT DISTINCT n_name AS index, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT index, state, round(max(loading) FILTER (component = 0), 6) AS c1, round(max(loading) FILTER (component = 1), 6) AS c2 FROM long JOIN names USING (index) WHERE mode = 'i' GROUP BY ALL""")
def component_scores(s, d):
    """A row for each region with its state and its score on each component."""
    names = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("index"), F.col("r_name").alias("state"))
    return R(tensor.score_table(_long(s, d), 2, names))
