"""Registered panel queries against DuckDB on the smallest tables."""

import importlib
import inspect

import duckdb
import pytest

from quadrat.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    cell = lambda v: None if v is None or v != v else round(float(v), 4) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else str(v)
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, (tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, DATA).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", ["principal_components", "panel_forecast", "cp_components"])
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name, module, operator, wanted", [
    ("cp_components", "tensor", "cp_als", {"iters": 200, "tol": 1e-8}), ("kmeans_sizes", "cluster", "kmeans_sweep", {"ks": range(2, 11), "n_init": 10}),
    ("density_clusters", "cluster", "dbscan", {"eps": 0.8, "min_pts": 5}), ("moran_permutation_test", "graph", "morans_permutation", {"n_perms": 999}),
    ("lisa_clusters", "graph", "lisa", {"n_perms": 999}), ("panel_forecast", "forecast", "fit_panel_forecaster", {"t_in": 6, "k": 3}),
])
def test_full_settings(spark, monkeypatch, name, module, operator, wanted):
    """Queries without SQL run the operators with the settings of the reference."""

    class Called(Exception):
        pass

    def catch(*args, **how):
        bound = inspect.signature(real).bind(*args, **how)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in wanted})

    real = getattr(importlib.import_module(f"quadrat.operators.{module}"), operator)
    monkeypatch.setattr(importlib.import_module(f"quadrat.operators.{module}"), operator, catch)
    with pytest.raises(Called) as got:
        catalogue.queries()[name](spark, DATA)
    assert got.value.args[0] == wanted
