"""Decompositions, permutations, contacts, clusters and matching against plain computations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import text
from quadrat.operators import cluster, forecast, geo, graph, names, tensor
from quadrat.sources import tables


# --- tensors


def coo_of(spark, x, keep=lambda *_: True):
    cells = [(f"i{i:03}", f"j{j:02}", f"k{k}", float(x[i, j, k])) for i, j, k in np.ndindex(*x.shape) if keep(i, j, k)]
    return spark.createDataFrame(cells, "i string, j string, k string, value double").repartition(3)


def drawn(shape, rank, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    a, b, c = (rng.normal(size=(n, rank)) for n in shape)
    return np.einsum("ir,jr,kr->ijk", a, b, c) + noise * rng.normal(size=shape)


def test_cp_of_exact_rank(spark, monkeypatch):
    monkeypatch.setattr(tensor, "BLOCK", 100)  # several blocks
    x = drawn((40, 9, 4), 2)
    coo = coo_of(spark, x)
    factors, error = tensor.cp_als(coo, 2, tol=1e-13)
    assert error < 1e-6
    assert tensor.reconstruct(factors, coo).agg(F.max(F.abs(F.col("value") - F.col("model")))).first()[0] < 1e-5
    assert tensor.component_variance(tensor.loadings(factors)).agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_cp_by_joins(spark, monkeypatch):
    """Where factors are too long to be sent the same is found by joins."""
    x = drawn((6, 5, 4), 1, seed=2)
    monkeypatch.setattr(tensor, "SENT", 1)
    assert tensor.cp_als(coo_of(spark, x), 1, iters=6)[1] < 1e-4


def test_cp_with_holes_and_without_cells(spark):
    x = drawn((8, 5, 3), 2, noise=0.1, seed=3)
    coo = coo_of(spark, x, lambda i, j, k: (i + j + k) % 4)
    factors, error = tensor.cp_als(coo, 2, iters=30)
    y = np.where(np.add.outer(np.add.outer(np.arange(8), np.arange(5)), np.arange(3)) % 4 > 0, x, 0.0)
    # a cell that is missing is 0: the error is that of the whole tensor
    fi, fj, fk = (np.array([r.f for r in factors[m].orderBy(m).collect()]) for m in "ijk")
    assert np.linalg.norm(y - np.einsum("ir,jr,kr->ijk", fi, fj, fk)) / np.linalg.norm(y) == pytest.approx(error, abs=1e-6)
    assert tensor.cp_als(coo.where("false"), 2)[1] == 0.0


def test_tucker_against_numpy(spark):
    x = drawn((20, 7, 5), 4, noise=0.3, seed=5)
    factors, core, error = tensor.tucker_hooi(coo_of(spark, x), (3, 3, 2))
    u = [np.linalg.svd(np.moveaxis(x, m, 0).reshape(x.shape[m], -1), full_matrices=False)[0][:, :r] for m, r in enumerate((3, 3, 2))]
    for _ in range(300):
        for m in range(3):
            y = x
            for n in range(3):
                if n != m:
                    y = np.moveaxis(np.tensordot(u[n].T, y, (1, n)), 0, n)
            u[m] = np.linalg.svd(np.moveaxis(y, m, 0).reshape(x.shape[m], -1), full_matrices=False)[0][:, : (3, 3, 2)[m]]
    least = np.linalg.norm(x - np.einsum("abc,ia,jb,kc->ijk", np.einsum("ijk,ia,jb,kc->abc", x, *u), *u)) / np.linalg.norm(x)
    assert error == pytest.approx(least, abs=1e-5)
    for m in "ijk":
        f = np.array([r.f for r in factors[m].orderBy(m).collect()])
        assert np.allclose(f.T @ f, np.eye(f.shape[1]), atol=1e-8)
    assert core.count() == 18 and tensor.tucker_hooi(coo_of(spark, x), (20, 7, 5))[2] < 1e-6


# --- permutations and eigenvalues


def test_sweep_of_features(spark):
    """Every feature as if tested alone; batches that are not full; a column without spread."""
    rng = random.Random(1)
    rows = [(f"r{i:02}", float(i), rng.random(), 3.0) for i in range(30)]
    edges = [(f"r{i:02}", f"r{j:02}", 1.0) for i in range(30) for j in (i - 1, i + 1) if 0 <= j < 30]
    values, w = spark.createDataFrame(rows, "region string, a double, b double, c double"), spark.createDataFrame(edges, "src string, dst string, w double")
    got = {r.feature: r for r in graph.moran_sweep(values, ["a", "b", "c"], w, 120, 7).collect()}
    alone = graph.morans_permutation(values.select("region", F.col("a").alias("v")), w, 120, 7).first()
    assert got["a"].i == pytest.approx(alone.i) and got["a"].p == alone.p and got["a"].stars == "***" and got["a"].i == pytest.approx(graph.morans_i(values, w, col="a").first().i)
    assert got["c"].i == 0 and got["c"].p == 1 and got["c"].stars == ""


def test_largest_eigenvalue(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, j) for i in range(60) for j in range(i) if rng.random() < 0.08] + [(i, i - 1) for i in range(1, 60)]
    m = np.zeros((60, 60))
    for i, j in pairs:
        m[i, j] = m[j, i] = 1 + rng.random()
    edges = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(m)))], "src int, dst int, w double")
    l = graph.laplacian_edges(edges, spark.range(60).select(F.col("id").cast("int").alias("region")))
    d = 1 / np.sqrt(m.sum(1))
    assert graph.largest_eigenvalue(l) == pytest.approx(np.linalg.eigvalsh(np.eye(60) - d[:, None] * m * d)[-1], abs=1e-6)
    assert graph.largest_eigenvalue(l.where("false")) == 0.0


def test_tensor_reads_tables_once(spark):
    """The plan of a tensor rests on means that lie ready; before, it held each table many times."""
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, None)], "region string, t int, x double").withColumn("read", F.lit(1))
    cells = tensor.build_tensor({"one": df, "two": df}, {"one": ["x"], "two": ["x"]}, "region", "t")
    assert {(r.i, r.j) for r in cells.collect()} == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert "LogicalRDD" in (plan := cells._jdf.queryExecution().analyzed().toString()) and "read#" not in plan


# --- boundaries


def boxes(spark, *given):
    """Rectangles ``(region, x, y, x2, y2)`` as a vertex table."""
    rows = [(r, i, 0, s, float(x), float(y)) for i, (r, x1, y1, x2, y2) in enumerate(given) for s, (x, y) in enumerate([(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)])]
    return spark.createDataFrame(rows, "region string, part int, ring int, seq int, x double, y double")


def test_contacts(spark):
    """A long side beside two short ones, half a side, a corner in the middle of a side, a gap, a slanted side."""
    wall = boxes(spark, ("base", 0, 0, 4, 1), ("left", 0, 1, 1.5, 2), ("right", 1.5, 1, 4, 2), ("half", 3.5, 2, 6, 3), ("away", 0, 2.001, 1, 3))
    got = {(r.src, r.dst): r.length for r in geo.contacts(wall).where("src < dst").collect()}
    assert got == {("base", "left"): pytest.approx(1.5), ("base", "right"): pytest.approx(2.5), ("left", "right"): pytest.approx(1.0), ("half", "right"): pytest.approx(0.5)}
    slanted = spark.createDataFrame([("big", 0, 0, s, x, y) for s, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)])] + [("tip", 1, 0, s, x, y) for s, (x, y) in enumerate([(1.0, 3.0), (5.0, 5.0), (2.0, 5.0), (1.0, 3.0)])] + [("side", 2, 0, s, x, y) for s, (x, y) in enumerate([(2.0, 2.0), (3.0, 1.0), (4.0, 4.0), (2.0, 2.0)])], "region string, part int, ring int, seq int, x double, y double")
    got = {(r.src, r.dst): r.length for r in geo.contacts(slanted).where("src < dst").collect()}
    assert got[("big", "tip")] == 0 and got[("big", "side")] == pytest.approx(2**0.5)
    assert geo.contacts(wall.where("false")).count() == 0


def test_sides_are_not_sent_through_the_driver(spark):
    """Spark takes exploded sides for small: no join of them may be a broadcast, however small their file."""
    wall = boxes(spark, ("a", 0, 0, 4, 1), ("a", 1, 1, 2, 2), ("b", 2, 1, 3, 2))
    for found in (geo.contacts(wall), geo.dissolve(wall), geo.near_edges(wall)):
        assert found.count() > 0 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_dissolve_along_parts_of_sides(spark):
    outline = geo.dissolve(boxes(spark, ("a", 0, 0, 4, 1), ("a", 1, 1, 2, 2), ("b", 2, 1, 3, 2))).groupBy("region").agg(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("n"))
    assert {r.region: r.n for r in outline.collect()} == {"a": pytest.approx(12.0), "b": pytest.approx(4.0)}


# --- clusters


def brute_density(pts, eps, least):
    near = {k: [j for j, (a, b) in pts.items() if (a - x) ** 2 + (b - y) ** 2 <= eps * eps] for k, (x, y) in pts.items()}
    core, label = {k for k in pts if len(near[k]) >= least}, {}
    for k in sorted(core):
        stack = [k] if k not in label else []
        while stack:
            at = stack.pop()
            if at not in label:
                label[at] = k
                stack += [j for j in near[at] if j in core]
    for k in set(pts) - core:
        label |= {k: min(c)} if (c := [label[j] for j in near[k] if j in core]) else {}
    place = {root: i for i, root in enumerate(sorted(set(label.values())))}
    return {k: place[label[k]] if k in label else -1 for k in pts}


@pytest.mark.parametrize("eps, least", [(0.5, 4), (0.2, 5), (1.0, 1)])
def test_density_clusters(spark, eps, least):
    rng = np.random.default_rng(2)
    pts = {i: (float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 0.1, (150, 2)), rng.normal(1.2, 0.3, (60, 2)), rng.uniform(-3, 3, (60, 2)), [[5, 5]] * 9, [[5 + eps, 5]] * 9]).round(3))}
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in pts.items()] + [(999, None, 1.0)], "id int, x double, y double")
    got = {r.id: r.label for r in cluster.dbscan(df, "id", eps=eps, min_pts=least).collect()}
    assert got.pop(999) == -1 and got == brute_density(pts, eps, least)
    assert cluster.dbscan(df.where("false"), "id").count() == 0


def test_vectors_work_a_table_out_once(spark):
    """Moments and rows rest on a table that lies ready; before, the plan held it twice."""
    df = spark.range(9).select("id", F.sin("id").alias("x"), F.cos("id").alias("y"))
    assert "Range" not in cluster._vectors(df, ["x", "y"])._jdf.queryExecution().analyzed().toString()


def test_silhouettes_by_groups(spark, monkeypatch):
    """Groups of several blocks, copies and rows all but equal far from the origin; no product of all blocks with all."""
    monkeypatch.setattr(cluster, "ROWS", 8)
    monkeypatch.setattr(cluster, "GROUP", 2)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(120, 4)) + 1e3, np.full((20, 4), 1e3), np.full((20, 4), 1e3) + rng.normal(0, 1e-7, (20, 4))])
    a = rng.integers(0, 4, 160)
    df = spark.createDataFrame([([float(x) for x in r], int(p)) for r, p in zip(v, a)], "v array<double>, a int").repartition(3)
    d = np.linalg.norm(v[:, None] - v, axis=2)
    means = np.stack([d[:, a == c].sum(1) / ((a == c).sum() - (a == c)) for c in range(4)], 1)
    inside = means[np.arange(160), a]
    means[np.arange(160), a] = np.inf
    outside = means.min(1)
    found = cluster.silhouettes(df, "v", ["a"])
    row = found.first()
    assert row.silhouette == pytest.approx(float(((outside - inside) / np.maximum(inside, outside)).mean()), abs=1e-9) and (row.rows, row.clusters) == (160, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_silhouettes(spark, monkeypatch):
    monkeypatch.setattr(cluster, "ROWS", 16)
    rng = np.random.default_rng(4)
    v, a, b = rng.normal(size=(70, 3)), rng.integers(0, 3, 70), np.where(np.arange(70) == 5, 9, rng.integers(0, 2, 70))
    df = spark.createDataFrame([([float(x) for x in r], int(p), int(q), 1) for r, p, q in zip(v, a, b)], "v array<double>, a int, b int, one int").repartition(4)
    d = np.linalg.norm(v[:, None] - v, axis=2)

    def mean(labels):
        out = []
        for i, own in enumerate(labels):
            inside = [d[i, j] for j in range(70) if j != i and labels[j] == own]
            if inside:
                x, y = np.mean(inside), min(d[i, labels == o].mean() for o in set(labels.tolist()) - {own})
                out.append((y - x) / max(x, y))
        return sum(out) / 70

    got = {r.labels: r.silhouette for r in cluster.silhouettes(df, "v", ["a", "b", "one"]).collect()}
    assert got == {"a": pytest.approx(mean(a)), "b": pytest.approx(mean(b)), "one": 0.0}


# --- names and files


def test_weighted_match_loses_none(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdn") for _ in range(draw.randint(1, 6)))
    refs = sorted({" ".join(word() for _ in range(draw.randint(1, 4))) for _ in range(70)} | {"a", "b c", "xyz"})
    given = sorted({draw.choice(refs)[draw.randint(0, 2):] + draw.choice(["", " nagar", "x"]) for _ in range(60)} | {"a", "d", "xyz and more words"} - {""})
    left, right = spark.createDataFrame([(x,) for x in given] + [(None,), (" ",)], "name string"), spark.createDataFrame([(x,) for x in refs] + [(None,)], "ref string")
    every = text.with_weighted_ratio(left.where("length(trim(name)) > 0").crossJoin(right.na.drop()).distinct(), "name", "ref")
    for threshold in (85.0, 72.0):
        best = {}
        for r in sorted(every.where(F.col("score") >= threshold).collect(), key=lambda r: (-r.score, r.ref)):
            best.setdefault(r.name, []).append((r.ref, r.score))
        got = {r.name: (r.ref, r.score, r.runner_up) for r in names.fuzzy_match_weighted(left, right, threshold).collect()}
        assert got.pop(" ") == (None, None, None)
        assert got == {n: (*best[n][0], best[n][1][1] if len(best[n]) > 1 else None) if n in best else (None, None, None) for n in {x for x in given if x.strip()}}
    with pytest.raises(ValueError, match="70"):
        names.fuzzy_match_weighted(left, right, 60.0)


def test_common_lengths():
    def plain(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    draw = random.Random(2)
    for _ in range(200):
        a, b = ("".join(draw.choice("abcé") for _ in range(draw.choice([0, 1, 5, 90]))) for _ in range(2))
        assert text._common(text._bits(a), len(a), b) == plain(a, b)


def test_whole_files(spark, tmp_path):
    for name, lines in {"good": "1,a,2\n2,b,3", "word": "1,a,two\n2,b,3", "negative": "1,a,-1", "empty": ""}.items():
        (tmp_path / f"{name}.csv").write_text("id,s,n\n" + lines + ("\n" if lines else ""))
    rows, report = tables.load_whole_files(spark, str(tmp_path / "*.csv"), "id int, s string, n int", {"n >= 0": F.col("n") >= 0})
    assert sorted((r.id, r.s, r.n) for r in rows.collect()) == [(1, "a", 2), (2, "b", 3)]
    assert {r.file.rsplit("/", 1)[-1]: (r.rows, r.broken_rows, r.broken, r.accepted) for r in report.collect()} == {
        "good.csv": (2, 0, {}, True), "word.csv": (2, 1, {"row is readable": 1, "n >= 0": 1}, False), "negative.csv": (1, 1, {"n >= 0": 1}, False),
    }


def test_forecast_by_state(spark):
    """Steps against a loop over arrays; a node without its last times is left out."""
    rng = np.random.default_rng(7)
    nodes, weights = ["a", "b", "c"], rng.normal(size=4) * 0.4
    z = rng.normal(size=(5, 3))
    rows = [(n, t, float(z[t, i]) * 2 + 1) for i, n in enumerate(nodes) for t in range(5)] + [("late", 4, 1.0)]
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", -0.3)], "src string, dst string, w double")
    m = np.array([[0, 0.5, 0], [0.5, 0, -0.3], [0, 0, 0]])
    model = forecast.Forecaster([float(x) for x in weights], 0.1, edges, "v", 2, 2, 1.0, 2.0, "t", "node")
    got = {(r.node, r.step): r.prediction for r in forecast.forecast(model, spark.createDataFrame(rows, "node string, t int, v double"), 3).collect()}
    past = [z[4], z[3]]
    for step in range(1, 4):
        new = sum(weights[2 * i] * past[i] + weights[2 * i + 1] * (m @ past[i]) for i in range(2)) + 0.1
        past = [new, past[0]]
        for i, n in enumerate(nodes):
            assert got.pop((n, step)) == pytest.approx(new[i] * 2 + 1)
    assert not got
