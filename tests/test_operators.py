"""Operators on small literal tables: goldens and invariants."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import text
from quadrat.operators import cluster, features, forecast, geo, graph, names, quality, reports, series, tensor
from quadrat.sources import tables


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s"))).first()[0]


def test_text(spark):
    assert one(spark, text.title, "5th cross medchal-malkajgiri") == "5Th Cross Medchal-Malkajgiri"
    assert one(spark, text.repair_encoding, "SÃ©cond") == "Sécond" and one(spark, text.repair_encoding, "é – x") == "é - x"
    assert one(spark, text.fix_encoding, "é") == "é"
    assert one(spark, text.name_key, "  A   b ") == "a b"
    assert one(spark, text.normalise_region, "*kaimur (bhabua) ") == "Kaimur Bhabua"
    assert one(spark, text.basic_name, "K.V.Rangareddy") == "K V Rangareddy"
    assert one(spark, lambda c: text.clean_text(c, strict=True), "A_b 9é") == "a b 9"
    assert one(spark, lambda c: text.short_number(c.cast("double")), "2500000") == "2.5M"
    assert one(spark, lambda c: text.percent(c.cast("double")), "0.125") in ("12.5%", "12.50%")


def test_names(spark):
    pairs = spark.createDataFrame([("S", "Patna"), ("S", "Gaya town"), ("T", "Agre"), ("U", "Patnna")], "state string, district string")
    refs = spark.createDataFrame([("S", "patna"), ("S", "town gaya"), ("T", "agra")], "state string, ref string")
    got = {(r.state, r.district): (r.ref, r.source) for r in names.fuzzy_match_blocked(pairs, refs, 70.0).collect()}
    assert got == {("S", "Patna"): ("patna", "block"), ("S", "Gaya town"): ("town gaya", "block"), ("T", "Agre"): ("agra", "block"), ("U", "Patnna"): ("patna", "all")}
    changed, counts = names.remap(pairs, spark.createDataFrame([("Agre", "Agra"), ("None", "x")], "old string, new string"), "district")
    assert counts.first().asDict() == {"values_found": 1, "rows_changed": 1} and changed.where("district = 'Agra'").count() == 1
    assert quality.guard_counts(pairs, changed)["removed"] == 0
    with pytest.raises(ValueError, match="added rows"):
        quality.guard_counts(pairs, pairs.union(pairs))
    assert names.keep_canonical(pairs, "district", spark.createDataFrame([("Patna",)], "d string")).count() == 1


@pytest.mark.parametrize("threshold, subsets", [(85.0, False), (70.0, True), (50.0, False), (40.0, False)])
def test_fuzzy_match_loses_none(spark, threshold, subsets):
    """Candidates by bigrams give what all pairs give."""
    draw = random.Random(3)
    refs = [" ".join("".join(draw.choice("abcn") for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(1, 3))) for _ in range(60)] + ["", "Xatna", "aaaaaaaa"]

    def edited(word):
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(word))
            word = word[:at] + draw.choice(["", "a", "z", " "]) + word[at + draw.randint(0, 1):]
        return word

    given = [edited(draw.choice(refs)) for _ in range(120)] + ["Patna", "aaaaaaa", " "]
    left, right = spark.createDataFrame([(x,) for x in given] + [(None,)], "name string"), spark.createDataFrame([(x,) for x in refs], "ref string")
    every = left.where("name IS NOT NULL").distinct().crossJoin(right.distinct()).withColumn("score", text.similarity(F.col("name"), F.col("ref"), subsets)).where(F.col("score") >= threshold)
    best = {}
    for row in sorted(every.collect(), key=lambda r: (-r.score, r.ref)):
        best.setdefault(row.name, []).append((row.ref, row.score))
    got = {r.name: (r.ref, r.score, r.runner_up) for r in names.fuzzy_match(left, right, threshold, subsets=subsets).collect()}
    wanted = {n: (*best[n][0], best[n][1][1] if len(best[n]) > 1 else None) if n in best else (None, None, None) for n in set(given)}
    assert got == wanted


def test_name_chain(spark):
    """Names as they come in: spaces, parentheses, digits, dots, hyphens, broken encodings, other scripts, blank, null."""
    raw = ["  Kaimur   (Bhabua) ", "5th cross", "K.V.Rangareddy", "Medchal-malkajgiri", "SÃ©cond", "Sécond", "E\u0301toile", "दिल्ली", "a – b", "", None]
    rows = spark.createDataFrame([(x,) for x in raw], "s string").select("s", text.normalise_region(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in rows} == {
        "  Kaimur   (Bhabua) ": "Kaimur Bhabua", "5th cross": "5Th Cross", "K.V.Rangareddy": "K.V.Rangareddy", "Medchal-malkajgiri": "Medchal-Malkajgiri", "SÃ©cond": "Sécond",
        "Sécond": "Sécond", "E\u0301toile": "Étoile", "दिल्ली": "दिल्ली", "a – b": "A - B", "": "", None: None,
    }
    assert names.drop_junk(spark.createDataFrame([("560001",), ("Near station",), (" ",), (None,), ("Patna",)], "d string"), "d", patterns=[r"^\d{6}$", "^near "]).count() == 1
    pair = spark.createDataFrame([("east singhbhum", "singhbhum")], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("p"), text.similarity(F.col("a"), F.col("b"), True).alias("q")).first()
    assert pair.p < 70 and pair.q == 95.0


def test_acf_by_slices(spark):
    draw = random.Random(1)
    series_of = [draw.gauss(0, 1) + i * 0.1 for i in range(24)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(series_of)] + [("flat", i, 1.0) for i in range(8)], "k string, t int, v double")
    got = {(r.k, r.lag): r.acf for r in series.acf(df, "k", "t", "v").collect()}
    for lag in range(1, 12):
        assert math.isclose(got["a", lag], np.corrcoef(series_of[:-lag], series_of[lag:])[0, 1], abs_tol=1e-9)
    assert len(got) == 11 + 3 and got["flat", 1] is None


def test_missing_and_dates(spark):
    df = spark.createDataFrame([("2024-01-01", None, None), ("x", 1, "a"), ("2024-01-04", 2, "a")], "date string, n int, s string")
    assert quality.invalid_dates(df, "date").first().invalid == 1
    assert quality.handle_missing(df, "fill").where("n = 0 AND s = 'Unknown'").count() == 1
    assert quality.handle_missing(df, "drop").count() == 2
    dates = quality.coerce_date(df, "date").where("date IS NOT NULL")
    assert quality.date_completeness(dates).first().missing_days == 2
    assert [str(r.date) for r in quality.missing_dates(dates).orderBy("date").collect()] == ["2024-01-02", "2024-01-03"]


def test_interpolation_and_growth(spark):
    gaps = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [("b", 0, None)], "node string, t int, v double")
    got = features.interpolate(gaps, "node", "t", ["v"]).orderBy("node", "t").collect()
    assert [r.v for r in got] == [1, 1, 2, 3, 4, 4, 0]
    rows = spark.createDataFrame([("k", 1, 0), ("k", 2, 5), ("k", 3, 10), ("z", 1, 3)], "k string, t int, v int")
    out = features.growth_features(rows, "v", ["k"], ["t"]).orderBy("k", "t").collect()
    assert [r.daily_pct_change for r in out] == [0, 0, 100, 0] and [r.v_7day_std for r in out][0] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,state,district,pincode,n\n2024-01-01,"S, one",d,123456,1\n2024-01-02,S,d,12345,-1\n2024-01-03,,d,123456,2\n')
    df = tables.load_csv(spark, str(tmp_path / "*.csv"), "date date, state string, district string, pincode string, n int")
    ok, bad = tables.validate(df, tables.panel_rules(["n"]))
    assert ok.first().state == "S, one" and ok.count() == 1
    assert sorted(map(len, (r.broken_rules for r in bad.collect()))) == [1, 2]
    assert tables.rows_by_file(df).first().rows == 3
    assert tables.surrogate_id(df.union(df)).select("id").distinct().count() == 6
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]
    shape = lambda n, c, t="Polygon": {"type": "Feature", "properties": {"NAME_2": n}, "geometry": {"type": t, "coordinates": c}}
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "features": [shape("A", square), shape("B", [[[[x + 1, y] for x, y in square[0]]]], "MultiPolygon"), shape("C", [[[x + 2.015, y] for x, y in square[0]]])]}))
    polygons = tables.load_boundaries(spark, str(tmp_path / "b.json"))
    assert {(r.src, r.dst) for r in geo.touch_edges(polygons).collect()} == {("A", "B"), ("B", "A")}
    assert geo.near_edges(polygons, 0.01).where("src < dst").count() == 2
    assert geo.centroids(polygons).where("region = 'B'").first().x == pytest.approx(1.5)
    merged = polygons.where("region <> 'C'").withColumns({"part": F.when(F.col("region") == "A", 0).otherwise(1), "region": F.lit("AB")})
    assert geo.dissolve(merged).count() == 6
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "a", 1.0)], "src string, dst string, w double")
    matrix = tables.edges_to_matrix(edges, ["a", "b"])
    assert sorted(map(tuple, tables.matrix_to_edges(matrix, "src").collect())) == sorted(map(tuple, edges.collect()))
    assert tables.scan(edges, ["w", "none"]).columns == ["w"]
    tables.replace_table(df, str(tmp_path / "t"), "date")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_utm(spark):
    east, north = spark.range(1).select(*geo.to_utm(F.lit(75.0), F.lit(20.0), 43)).first()
    assert east == pytest.approx(500000.0) and north == pytest.approx(2211481.0, abs=30)


def board(spark):
    cells = [(f"{i}{j}", i, j) for i in range(4) for j in range(4)]
    edges = [(a[0], b[0], 1.0) for a in cells for b in cells if abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1]
    return spark.createDataFrame(edges, "src string, dst string, w double"), cells


def test_graph_invariants(spark):
    w, cells = board(spark)
    nodes = spark.createDataFrame([(c[0],) for c in cells], "region string")
    l = graph.laplacian_edges(w, nodes)
    root = graph.degrees(w).select(F.col("node").alias("dst"), F.sqrt("degree").alias("r"))
    assert l.join(root, "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("r")).alias("x")).agg(F.max(F.abs("x"))).first()[0] < 1e-12
    assert graph.largest_eigenvalue(l) == pytest.approx(2.0, abs=1e-6)
    checks = spark.createDataFrame([(c[0], float((c[1] + c[2]) % 2)) for c in cells], "region string, v double")
    slope = spark.createDataFrame([(c[0], float(c[1])) for c in cells], "region string, v double")
    assert graph.morans_i(checks, w).first().i == pytest.approx(-1.0) and graph.morans_i(slope, w).first().i > 0
    a, b = (graph.morans_permutation(slope, w, 99, 7).first() for _ in range(2))
    assert a == b and a.p < 0.05
    assert set(graph.lisa_summary(graph.lisa(slope, w, 0.2, 99)).toPandas()["class"]) <= {"HH", "LL", "HL", "LH", "NS"}
    assert graph.graph_summary(w, nodes).first().isolated == 0


def test_clusters(spark):
    points = [(i, 0.1 * i, 0.0) for i in range(8)] + [(10 + i, 5 + 0.1 * i, 5.0) for i in range(8)] + [(99, 50.0, 50.0)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {r.id: r.label for r in cluster.dbscan(df, "id", eps=0.3, min_pts=3).collect()}
    assert {got[i] for i in range(8)} == {0} and {got[10 + i] for i in range(8)} == {1} and got[99] == -1
    scores, labels = cluster.kmeans_sweep(df.where("id < 99"), ["x", "y"], "id", ks=(2, 3), n_init=1)
    assert labels.select("label").distinct().count() == 2 and scores.count() == 2
    params = cluster.zscore_fit(df, ["x"])
    back = cluster.zscore_invert(cluster.zscore_apply(df, params, ["x"]), params, ["x"])
    assert back.join(df.withColumnRenamed("x", "x0"), "id").agg(F.max(F.abs(F.col("x") - F.col("x0")))).first()[0] < 1e-9


def test_forecast(spark):
    rows = [(n, t, 3.0 * t + (5 if n == "a" else 0)) for n in ("a", "b") for t in range(30)]
    panel = spark.createDataFrame(rows, "node string, t int, v double")
    edges = spark.createDataFrame([("a", "b", -1.0), ("b", "a", -1.0)], "src string, dst string, w double")
    model, predicted = forecast.fit_panel_forecaster(panel, edges, "v", t_in=2, k=2)
    assert forecast.forecast_metrics(predicted).first().mae < 1e-3
    ahead = {(r.node, r.step): r.prediction for r in forecast.forecast(model, panel, 2).collect()}
    assert ahead[("b", 2)] == pytest.approx(93.0, abs=0.1)


def test_series_and_reports(spark):
    rows = spark.createDataFrame([("a", t, float(math.sin(t))) for t in range(40)], "k string, t int, v double")
    assert series.acf(rows, "k", "t", "v", 5).count() == 5
    assert series.sliding_sequences(rows, "k", "t", "v", 6, 2).count() == 33
    assert series.change_from_first(rows.where("t > 0"), "k", "t", "v").where("t = 1").first().change_pct == 0
    assert reports.sample_keys(rows.select(F.col("t").alias("key")), "key", 5).count() == 5
    assert reports.peers(spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "state string, district string, v int"), "s", "a", "v").first().district == "b"


def test_rounding_of_ties(spark):
    """Sums that differ in their last bit round alike."""
    ties = [0.2421875, 0.4859375, 2.3984375, 12.3984375]
    got = features.rounded(spark.createDataFrame([(i, float(v)) for i, t in enumerate(ties) for v in (np.nextafter(t, 0), t, np.nextafter(t, 99))], "i int, v double")).distinct().collect()
    assert sorted((r.i, r.v) for r in got) == [(0, 0.242188), (1, 0.485938), (2, 2.398438), (3, 12.398438)]
