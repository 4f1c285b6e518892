"""Files written from line items and loaded again, and forecasts whose steps SQL repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.functions.cut import shared_folder
from quadrat.operators import features, forecast, geo, graph
from quadrat.plans.panels import table
from quadrat.plans.registry import query as _query
from quadrat.sources import tables

R = features.rounded

#: Files by line number: in those of number 3 some quantities are words, in those of number 5 some are negative.
_FILES = """WITH lines AS (SELECT l_linenumber AS number, l_returnflag AS flag, l_quantity AS quantity, (l_linenumber = 3 AND l_orderkey % 50 = 0) AS word, (l_linenumber = 5 AND l_orderkey % 70 = 0) AS negative FROM lineitem),
 files AS (SELECT number, count(*) AS rows, count(*) FILTER (word OR negative) AS broken_rows, count(*) FILTER (word) AS unreadable, count(*) FILTER (word OR negative) AS no_quantity FROM lines GROUP BY number)"""


def _loaded(s, d):
    path = f"{shared_folder(s).rstrip('/')}/quadrat/{uuid.uuid4().hex}/lines"
    number, order = F.col("l_linenumber"), F.col("l_orderkey")
    quantity = F.when((number == 3) & (order % 50 == 0), "many").when((number == 5) & (order % 70 == 0), F.lit("-1")).otherwise(F.col("l_quantity").cast("string"))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("flag"), quantity.alias("quantity"), "l_linenumber")
    rows.write.option("header", True).partitionBy("l_linenumber").csv(path)
    return tables.load_whole_files(s, f"{path}/*", "order_id long, flag string, quantity double", {"flag is given": F.col("flag").isNotNull(), "quantity >= 0": F.col("quantity") >= 0})


def _number(file="file"):
    return F.regexp_extract(file, r"l_linenumber=(\d+)", 1).cast("int")


@_query(_FILES + " SELECT CAST(number AS INTEGER) AS number, rows, broken_rows, unreadable, no_quantity FROM files")
def file_report(s, d):
    """What the files of each line number broke."""
    _, report = _loaded(s, d)
    of = lambda rule: F.sum(F.coalesce(F.try_element_at("broken", F.lit(rule)), F.lit(0)))
    return report.groupBy(_number().alias("number")).agg(F.sum("rows").alias("rows"), F.sum("broken_rows").alias("broken_rows"), of("row is readable").alias("unreadable"), of("quantity >= 0").alias("no_quantity"))


@_query(_FILES + " SELECT CAST(number AS INTEGER) AS number, flag, count(*) AS rows, sum(quantity) AS quantity FROM lines JOIN files USING (number) WHERE broken_rows = 0 GROUP BY ALL")
def rows_of_good_files(s, d):
    """Rows of the line numbers none of whose files was set aside."""
    good, report = _loaded(s, d)
    bad = report.where("NOT accepted").select(_number().alias("number")).distinct()
    return good.withColumn("number", _number()).join(bad, "number", "left_anti").groupBy("number", "flag").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"))


_LAGS, _TERMS, _STEPS = 3, 3, 4
#: Given weights, by lag and diffusion term.
_WEIGHTS = [round(0.5 / (lag + 1) - 0.11 * n, 2) for lag in range(_LAGS) for n in range(_TERMS)]


def _steps_sql() -> str:
    """A CTE for each step: terms ``h{t}(node, n, v)`` of the last weeks (t from 1 - _LAGS to 0) and of the predicted ones."""
    def terms(t: int) -> str:
        beside = lambda of: f"(SELECT a.node, -0.5::DOUBLE * (b.v + c.v) AS v FROM ring a JOIN ({of}) b ON b.node = a.next JOIN ring p ON p.next = a.node JOIN ({of}) c ON c.node = p.node)"
        one = beside(f"SELECT node, v FROM p{t + _LAGS}")
        return f"""o{t + _LAGS} AS {one}, h{t + _LAGS} AS (SELECT node, 0 AS n, v FROM p{t + _LAGS} UNION ALL SELECT node, 1, v FROM o{t + _LAGS} UNION ALL
 SELECT x.node, 2, 2 * y.v - x.v FROM p{t + _LAGS} x JOIN {beside(f'SELECT node, v FROM o{t + _LAGS}')} y ON y.node = x.node)"""

    out = []
    for t in range(1 - _LAGS, 1):
        out += [f"p{t + _LAGS} AS (SELECT node, v FROM weeks WHERE back = {-t})", terms(t)]
    for t in range(1, _STEPS + 1):
        sums = " UNION ALL ".join(f"SELECT node, v * {_WEIGHTS[lag * _TERMS + n]}::DOUBLE AS v FROM h{t - 1 - lag + _LAGS} WHERE n = {n}" for lag in range(_LAGS) for n in range(_TERMS))
        out += [f"p{t + _LAGS} AS (SELECT node, sum(v) + 0.25::DOUBLE AS v FROM ({sums}) GROUP BY node)", terms(t)]
    return ", ".join(out)


_WEEKS = """WITH ring AS (SELECT n_name AS node, lead(n_name, 1, (SELECT min(n_name) FROM nation)) OVER (ORDER BY n_name) AS next FROM nation),
 sold AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, n_name AS node, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 latest AS (SELECT week, row_number() OVER (ORDER BY week DESC) - 1 AS back FROM (SELECT DISTINCT week FROM sold)), weeks AS (SELECT back, node, coalesce(n, 0)::DOUBLE / 8 AS v FROM latest CROSS JOIN (SELECT node FROM ring) LEFT JOIN sold USING (week, node) WHERE back < 3)"""


@_query(f"{_WEEKS}, {_steps_sql()} " + " UNION ALL ".join(f"SELECT node, {t} AS step, round(v * 8, 6) AS prediction FROM p{t + _LAGS}" for t in range(1, _STEPS + 1)))
def recursive_forecast(s, d):
    """Four steps from the last three weeks of orders, by given weights, each step from the one before."""
    places = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("node"))
    sold = table(s, d, "orders").join(places, "o_custkey").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("t"), "node").agg(F.count("*").alias("v"))
    names = table(s, d, "nation").select(F.col("n_name").alias("node"))
    grid = sold.select("t").distinct().orderBy(F.desc("t")).limit(_LAGS).crossJoin(names)  # three weeks
    panel = grid.join(sold, ["t", "node"], "left").select("t", "node", F.coalesce("v", F.lit(0)).cast("double").alias("v"))
    after = F.coalesce(F.lead("node").over(Window.orderBy("node")), F.min("node").over(Window.partitionBy(F.lit(0))))
    ring = geo.mirrored(names.select(F.col("node").alias("src"), after.alias("dst"), F.lit(1.0).alias("w")))
    edges = graph.scaled_laplacian(graph.laplacian_edges(ring, names, "node"))
    model = forecast.Forecaster(_WEIGHTS, 0.25, edges, "v", _LAGS, _TERMS, 0.0, 8.0, "t", "node")
    return R(forecast.forecast(model, panel, _STEPS))
