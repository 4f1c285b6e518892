"""Panel forecasts from lags and graph-diffused features, and their measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.cut import cut
from quadrat.operators.series import chronological_split


def chebyshev_features(panel: DataFrame, l_tilde: DataFrame, cols: Sequence[str], k: int = 3, time: str = "t", node: str = "node") -> DataFrame:
    """Columns ``<col>_cheb0`` to ``<col>_cheb{k-1}``: Chebyshev terms of the scaled Laplacian applied to each column."""
    now = panel.select(time, node, *[F.col(c).cast("double").alias(f"{c}_cheb0") for c in cols])
    for n in range(1, k):
        moved = now.select(time, F.col(node).alias("dst"), *[f"{c}_cheb{n - 1}" for c in cols])
        spread = l_tilde.join(moved, "dst").groupBy(time, F.col("src").alias(node)).agg(*[F.sum(F.col("w") * F.col(f"{c}_cheb{n - 1}")).alias(f"__{c}") for c in cols])
        now = now.join(spread, [time, node], "left")
        for c in cols:
            term = F.coalesce(f"__{c}", F.lit(0.0))
            now = now.withColumn(f"{c}_cheb{n}", term if n == 1 else term * 2 - F.col(f"{c}_cheb{n - 2}")).drop(f"__{c}")
    return now


@dataclass
class Forecaster:
    """A global linear model over lags of diffused features, with the scaling of its training part. ``weights``: by lag, the
    newest first, and for each lag by diffusion term."""

    weights: list[float]
    intercept: float
    edges: DataFrame
    target: str
    t_in: int
    k: int
    mean: float
    std: float
    time: str
    node: str


def _design(panel: DataFrame, edges: DataFrame, target: str, t_in: int, k: int, time: str, node: str, mean: float, std: float) -> tuple[DataFrame, list[str]]:
    z = panel.select(time, node, ((F.col(target) - mean) / (std or 1.0)).alias("z"))
    cheb = chebyshev_features(z, edges, ["z"], k, time, node)
    w = Window.partitionBy(node).orderBy(time)
    names = [f"x{lag}_{n}" for lag in range(t_in) for n in range(k)]
    lagged = {f"x{lag}_{n}": F.lag(f"z_cheb{n}", lag + 1).over(w) for lag in range(t_in) for n in range(k)}
    return cheb.withColumns(lagged), names


def fit_panel_forecaster(panel: DataFrame, edges: DataFrame, target: str, t_in: int = 6, k: int = 3, time: str = "t", node: str = "node", grid: Sequence[float] = (0.0, 1e-3, 1e-1)) -> tuple[Forecaster, DataFrame]:
    """Next-step model and its test predictions ``(time, node, y, prediction)``.

    Scaling is fitted on the training times alone; the split follows time; the penalty is chosen on the validation
    part. This is a linear model on lags and diffusion terms: same task as a neural graph forecaster, other estimator.
    """
    parts = chronological_split(panel, time)
    row = parts.where("part = 'train'").agg(F.avg(target), F.stddev_pop(target)).first()
    mean, std = float(row[0] or 0.0), float(row[1] or 0.0) or 1.0
    design, names = _design(panel, edges, target, t_in, k, time, node, mean, std)
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(design.where(F.col(f"x{t_in - 1}_0").isNotNull()))
    ready = cut(ready.join(parts.select(time, "part").distinct(), time).select(time, node, F.col("z_cheb0").alias("z"), "features", "part"))
    train, val, test = (ready.where(F.col("part") == p) for p in ("train", "val", "test"))
    best = None
    for reg in grid:
        model = LinearRegression(featuresCol="features", labelCol="z", regParam=reg, solver="normal").fit(train)
        error = model.transform(val).agg(F.avg(F.pow(F.col("z") - F.col("prediction"), 2))).first()[0]
        if best is None or (error is not None and error < best[0]):
            best = (error if error is not None else float("inf"), model)
    model = best[1]
    back = lambda c: (F.col(c) * std + mean)
    predicted = model.transform(test).select(time, node, back("z").alias("y"), back("prediction").alias("prediction"))
    return Forecaster([float(x) for x in model.coefficients], float(model.intercept), edges, target, t_in, k, mean, std, time, node), predicted


def forecast(f: Forecaster, panel: DataFrame, steps: int) -> DataFrame:
    """``(node, step, prediction)``: each prediction feeds the next window.

    A node's state is its window, one array of the diffusion terms of the last ``t_in`` times. A step multiplies it with the
    weights, joins the edges with the new values for their terms, and pushes these to the front; what is written
    between steps is one row a node. Nodes that lack one of the panel's last ``t_in`` times get no forecast."""
    times = panel.select(f.time).distinct().orderBy(F.desc(f.time)).limit(f.t_in)
    z = panel.join(times, f.time, "left_semi").select(f.time, f.node, ((F.col(f.target) - f.mean) / (f.std or 1.0)).alias("z"))
    terms = F.array(*[f"z_cheb{n}" for n in range(f.k)])
    rows = chebyshev_features(z, f.edges, ["z"], f.k, f.time, f.node).groupBy(f.node).agg(F.sort_array(F.collect_list(F.struct(F.col(f.time).alias("t"), terms.alias("x"))), asc=False).alias("w"))
    state = cut(rows.where(F.size("w") == f.t_in).select(f.node, F.flatten(F.transform("w", lambda r: r["x"])).alias("window")))
    weighted = F.aggregate(F.zip_with("window", F.array(*map(F.lit, f.weights)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    out = []
    for step in range(1, steps + 1):
        told = state.select(f.node, "window", (weighted + f.intercept).alias("z"))
        new = chebyshev_features(told.select(F.lit(0).alias("__t"), f.node, "z"), f.edges, ["z"], f.k, "__t", f.node).select(f.node, terms.alias("new"))
        state = cut(told.join(new, f.node).select(f.node, F.concat("new", F.slice("window", 1, (f.t_in - 1) * f.k)).alias("window"), "z"))
        out.append(state.select(f.node, F.lit(step).alias("step"), (F.col("z") * f.std + f.mean).alias("prediction")))
    return reduce(DataFrame.unionByName, out)


def forecast_metrics(pred: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "prediction", eps: float = 1e-8) -> DataFrame:
    """MAE, RMSE, MAPE in three forms (all rows, rows with |y| above 0.05, symmetric over rows not both 0), R squared."""
    e, a = F.col(y) - F.col(p), F.abs(y)
    sym = F.try_divide(F.abs(e) * 200.0, a + F.abs(p))
    groups = pred.groupBy(*by) if by else pred.groupBy()
    out = groups.agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e) / (a + eps)) * 100.0).alias("mape"),
        (F.avg(F.when(a > 0.05, F.abs(e) / a)) * 100.0).alias("mape_masked"), F.avg(sym).alias("smape"), F.sum(e * e).alias("__sse"), (F.var_pop(y) * F.count("*")).alias("__sst"),
    )
    return out.withColumn("r2", 1 - F.try_divide("__sse", "__sst")).drop("__sse", "__sst")


def prediction_errors(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """Every prediction with its absolute error."""
    return pred.withColumn("abs_error", F.abs(F.col(y) - F.col(p)))


def ranked_metrics(pred: DataFrame, by: str) -> DataFrame:
    """Measures of each region, numbered by mean absolute error, smallest first, ties by name."""
    return forecast_metrics(pred, [by]).withColumn("place", F.row_number().over(Window.orderBy("mae", by)))


def forecast_summary(pred: DataFrame, step: str = "step", col: str = "prediction", band: float = 0.08) -> DataFrame:
    """National total of each step, its band, and the % change from the first step."""
    totals = pred.groupBy(step).agg(F.sum(col).alias("total"))
    first = totals.agg(F.min_by("total", step).alias("__f"))  # one row
    return totals.crossJoin(first).select(step, "total", (F.col("total") * (1 - band)).alias("low"), (F.col("total") * (1 + band)).alias("high"), F.coalesce(F.try_divide((F.col("total") - F.col("__f")) * 100.0, "__f"), F.lit(0.0)).alias("trend_pct"))


def grade(r2):
    """A word for the size of R squared."""
    return F.when(r2 >= 0.9, "excellent").when(r2 >= 0.7, "good").when(r2 >= 0.5, "fair").otherwise("poor")

