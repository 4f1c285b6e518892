"""Weighted region graphs as edge tables ``(src, dst, w)``, and spatial statistics on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.cut import cut
from quadrat.operators.geo import mirrored


def distance_edges(points: DataFrame, sigma2: float = 0.1, epsilon: float = 0.1, key: str = "region") -> DataFrame:
    """``exp(-(d / largest d)^2 / sigma2)`` for all pairs of regions, those below ``epsilon`` left out.

    Every pair of regions takes part by definition of the largest distance; regions are few beside the facts."""
    a = points.select(F.col(key).alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = points.select(F.col(key).alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = a.join(b, F.col("src") < F.col("dst")).select("src", "dst", F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)).alias("d"))
    scaled = pairs.crossJoin(pairs.agg(F.max("d").alias("m"))).select("src", "dst", F.exp(-F.pow(F.coalesce(F.try_divide("d", "m"), F.lit(0.0)), 2) / sigma2).alias("w"))
    return mirrored(scaled.where(F.col("w") >= epsilon))


def similarity_edges(profiles: DataFrame, cols: Sequence[str], epsilon: float = 0.1, key: str = "region", blocks: int = 8) -> DataFrame:
    """Cosine of the profiles, held to 0..1; pairs below ``epsilon`` and regions whose profile is all zero are left out.

    A profile is one array of unit length, written once. Regions are dealt to blocks, and every two blocks meet in one key
    of the join, so the pairs of regions, all of which are asked for, spread over ``blocks`` squared keys."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = profiles.select(F.col(key).alias("src"), values.alias("v")).withColumn("n", norm).where("n > 0")
    unit = cut(rows.select("src", F.transform("v", lambda x: x / F.col("n")).alias("v"), F.pmod(F.xxhash64("src"), F.lit(blocks)).alias("own")))
    every = F.explode(F.array(*[F.lit(b).cast("long") for b in range(blocks)]))
    left = unit.select("src", "v", F.col("own").alias("p"), every.alias("q"))
    right = unit.select(F.col("src").alias("dst"), F.col("v").alias("v2"), F.col("own").alias("q"), every.alias("p"))
    dot = F.aggregate(F.zip_with("v", "v2", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pairs = left.join(right, ["p", "q"]).where("src < dst").select("src", "dst", F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0)).alias("w"))
    return mirrored(pairs.where(F.col("w") >= epsilon))


def combine_edges(a: DataFrame, b: DataFrame, alpha: float = 0.5) -> DataFrame:
    both = a.withColumnRenamed("w", "wa").join(b.withColumnRenamed("w", "wb"), ["src", "dst"], "full")
    return both.select("src", "dst", (F.coalesce("wa", F.lit(0.0)) * alpha + F.coalesce("wb", F.lit(0.0)) * (1 - alpha)).alias("w")).where("w <> 0")


def degrees(w: DataFrame) -> DataFrame:
    return w.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))


def laplacian_edges(w: DataFrame, nodes: DataFrame, key: str = "region") -> DataFrame:
    """``I - D^-1/2 W D^-1/2`` with its diagonal; a node without edges has 1 there."""
    d = degrees(w)
    off = w.join(d.select(F.col("node").alias("src"), F.col("degree").alias("d1")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("d2")), "dst")
    off = off.select("src", "dst", (-F.col("w") / F.sqrt(F.col("d1") * F.col("d2"))).alias("w"))
    return off.union(nodes.select(F.col(key).alias("src"), F.col(key).alias("dst"), F.lit(1.0).alias("w")))


def largest_eigenvalue(l: DataFrame, rounds: int = 60, tolerance: float = 1e-9) -> float:
    """The largest eigenvalue of a symmetric edge table, by the Lanczos method.

    A node holds its entries of all vectors so far, side by side; a round joins the edges with the newest vector, and
    makes the result orthogonal to all of them by sums of products. Only these numbers come to the driver, where the
    eigenvalues of a matrix of ``rounds`` squared at most are found. Ends when the error that the last entry allows is under ``tolerance``, or when
    the vectors span all that the start can reach. 0 for an empty table."""
    l = cut(l.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    start = F.lit(1.0) + F.pmod(F.xxhash64("node"), F.lit(1009)) / 1009.0
    first = l.select(F.col("src").alias("node")).distinct().withColumn("w", start)
    size = first.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0]
    if not size:
        return 0.0
    basis = cut(first.select("node", F.array(F.col("w") / size).alias("q")))
    matrix, value = np.zeros((rounds + 1, rounds + 1)), 0.0
    less = lambda h: F.col("w") - F.aggregate(F.zip_with("q", F.array(*map(F.lit, h)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    for j in range(1, rounds + 1):
        newest = basis.select(F.col("node").alias("dst"), F.element_at("q", -1).alias("v"))
        moved = l.join(newest, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("w"))
        step, products = basis.join(moved, "node", "left").select("node", "q", F.coalesce("w", F.lit(0.0)).alias("w")), np.zeros(j)
        for _ in range(2):  # once more takes away what rounding leaves
            step = cut(step)
            h = [float(x) for x in step.agg(*[F.sum(F.col("w") * F.col("q")[i]) for i in range(j)]).first()]
            products += h
            step = step.select("node", "q", less(h).alias("w"))
        step = cut(step)
        length = float(step.agg(F.sqrt(F.sum(F.col("w") * F.col("w")))).first()[0])
        matrix[:j, j - 1] = matrix[j - 1, :j] = products
        values, vectors = np.linalg.eigh(matrix[:j, :j])
        value = float(values[-1])
        if length * abs(vectors[-1, -1]) < tolerance or length < 1e-12:
            break
        basis = step.select("node", F.concat("q", F.array(F.col("w") / length)).alias("q"))
    return value


def scaled_laplacian(l: DataFrame, lambda_max: float | None = None) -> DataFrame:
    """``2 L / lambda - I``; by default with the bound 2 of normalised Laplacians, which needs no iteration."""
    m = float(lambda_max or 2.0)
    return l.select("src", "dst", (F.col("w") * 2 / m - F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)).alias("w")).where("abs(w) > 1e-15")


def row_normalise(w: DataFrame) -> DataFrame:
    return w.join(degrees(w).withColumnRenamed("node", "src"), "src").select("src", "dst", F.coalesce(F.try_divide("w", "degree"), F.lit(0.0)).alias("w"))


def graph_summary(w: DataFrame, nodes: DataFrame, key: str = "region") -> DataFrame:
    """Nodes, directed edges, density, largest weight, mean degree, isolated nodes."""
    edges = w.agg(F.count("*").alias("edges"), F.max("w").alias("max_weight"), F.sum("w").alias("__s"))
    linked = w.select(F.col("src").alias(key)).distinct().withColumn("__l", F.lit(1))
    names = nodes.select(key).distinct().join(linked, key, "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("__l").isNull()).alias("isolated"))
    both = names.crossJoin(edges)  # one row each
    return both.select("nodes", "edges", F.try_divide(F.col("edges").cast("double"), (F.col("nodes") * (F.col("nodes") - 1)).cast("double")).alias("density"), "max_weight", F.try_divide("__s", "nodes").alias("mean_degree"), "isolated")


def neighbours(w: DataFrame, node: str) -> DataFrame:
    return w.where(F.col("src") == node).select("dst", "w").orderBy(F.desc("w"), "dst")


def standardised(values: DataFrame, col: str = "v") -> DataFrame:
    """z-score with the population deviation; 0 where that is 0."""
    one = values.agg(F.avg(col).alias("__m"), F.stddev_pop(col).alias("__s"))  # one row
    return values.crossJoin(one).withColumn("z", F.coalesce(F.try_divide(F.col(col) - F.col("__m"), "__s"), F.lit(0.0))).drop("__m", "__s")


def spatial_lag(values: DataFrame, w: DataFrame, key: str = "region", col: str = "v") -> DataFrame:
    """``(key, z, lag)``: weighted mean of the neighbours' z, 0 for a node without any."""
    z = standardised(values, col).select(key, "z")
    lag = row_normalise(w).join(z.select(F.col(key).alias("dst"), "z"), "dst").groupBy(F.col("src").alias(key)).agg(F.sum(F.col("w") * F.col("z")).alias("lag"))
    return z.join(lag, key, "left").na.fill(0.0, subset=["lag"])


def morans_i(values: DataFrame, w: DataFrame, key: str = "region", col: str = "v") -> DataFrame:
    """Global I and its expectation."""
    rows = spatial_lag(values, w, key, col)
    return rows.agg(F.coalesce(F.try_divide(F.sum(F.col("z") * F.col("lag")), F.sum(F.col("z") * F.col("z"))), F.lit(0.0)).alias("i"), F.try_divide(F.lit(-1.0), F.count("*") - 1.0).alias("expected"))


def moran_slope(values: DataFrame, w: DataFrame, key: str = "region", col: str = "v") -> DataFrame:
    """Slope and intercept of the lag on z."""
    return spatial_lag(values, w, key, col).agg(F.regr_slope("lag", "z").alias("slope"), F.regr_intercept("lag", "z").alias("intercept"))


#: Permutations that a node holds side by side.
SIDE = 50


def _permuted(values: DataFrame, cols: Sequence[str], w: DataFrame, n_perms: int, seed: int, key: str) -> DataFrame:
    """``(feature, batch, key, z array, lag array)``: standardised values dealt anew to the nodes, and their lags; place i of batch
    b is permutation ``SIDE * b + i``, and permutation 0 is the data itself.

    Permutation p gives the node that is n-th by name the values of the node that is n-th by the MD5 of ``seed:p:name``,
    so any engine can repeat it. All features move together. A node holds the values of a batch side by side, as
    columns: edges are joined once for each batch and feature, and their sums are combined before they are
    shuffled. Null values count as the mean. Sorting takes a permutation of the nodes in one task, which may spill.
    """
    moments = values.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"f{i}") for i, c in enumerate(cols)])  # one row
    z = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"f{i}.m"), f"f{i}.s"), F.lit(0.0)).alias("z")) for i, c in enumerate(cols)])).alias("x")
    long = cut(values.crossJoin(moments).select(F.col(key).alias("from"), z).select("from", "x.*"))
    names = long.select("from").distinct().withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perms))))
    draw = F.when(F.col("perm") > 0, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("perm").cast("string"), F.col("from").cast("string")).cast("binary")))
    slots = names.withColumn("slot", F.row_number().over(Window.partitionBy("perm").orderBy(draw, "from")))
    order = names.where("perm = 0").select(F.col("from").alias(key), F.row_number().over(Window.partitionBy("perm").orderBy("from")).alias("slot"))
    dealt = slots.join(order, "slot").join(long, "from")
    place = F.col("perm") % SIDE
    wide = cut(dealt.groupBy("feature", F.floor(F.col("perm") / SIDE).cast("int").alias("batch"), key).agg(*[F.max(F.when(place == i, F.col("z"))).alias(f"z{i}") for i in range(SIDE)]))
    lag = row_normalise(w).join(wide.withColumnRenamed(key, "dst"), "dst").groupBy("feature", "batch", F.col("src").alias(key)).agg(*[F.sum(F.col("w") * F.col(f"z{i}")).alias(f"l{i}") for i in range(SIDE)])
    both = wide.join(lag, ["feature", "batch", key], "left")
    return both.select("feature", "batch", key, F.array(*[f"z{i}" for i in range(SIDE)]).alias("z"), F.array(*[F.when(F.col(f"z{i}").isNotNull(), F.coalesce(f"l{i}", F.lit(0.0))) for i in range(SIDE)]).alias("lag"))


def moran_sweep(values: DataFrame, cols: Sequence[str], w: DataFrame, n_perms: int = 499, seed: int = 42, key: str = "region") -> DataFrame:
    """For each column I, its expectation, z-score against the permutations, two-sided pseudo p (share of permutations whose size is
    at least that of I, to 1e-12) and stars, all columns in one job. A column without spread has I 0 and p 1."""
    rows = _permuted(values, cols, w, n_perms, seed, key)
    sums = rows.groupBy("feature", "batch").agg(F.count("*").alias("n"), F.array(*[F.coalesce(F.try_divide(F.sum(F.col("z")[i] * F.col("lag")[i]), F.sum(F.col("z")[i] * F.col("z")[i])), F.lit(0.0)) for i in range(SIDE)]).alias("i"))
    each = sums.select("feature", "n", "batch", F.posexplode("i").alias("place", "i")).select("feature", "n", (F.col("batch") * SIDE + F.col("place")).alias("perm"), "i").where(F.col("perm") <= n_perms)
    own = F.max(F.when(F.col("perm") == 0, F.col("i"))).over(Window.partitionBy("feature"))
    tested = each.withColumn("own", own).where("perm > 0").groupBy("feature").agg(
        F.max("own").alias("i"), F.try_divide(F.lit(-1.0), F.max("n") - 1.0).alias("expected"),
        F.coalesce(F.try_divide(F.max("own") - F.avg("i"), F.stddev_pop("i")), F.lit(0.0)).alias("z_score"),
        F.avg((F.abs("i") >= F.abs("own") - 1e-12).cast("double")).alias("p"),
    )
    return tested.withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def morans_permutation(values: DataFrame, w: DataFrame, n_perms: int = 999, seed: int = 42, key: str = "region", col: str = "v") -> DataFrame:
    """I, its expectation, z-score against the permutations and two-sided pseudo p; see ``moran_sweep``."""
    return moran_sweep(values, [col], w, n_perms, seed, key).drop("feature", "stars")


def lisa(values: DataFrame, w: DataFrame, p: float = 0.05, n_perms: int = 999, seed: int = 42, key: str = "region", col: str = "v") -> DataFrame:
    """Local I of each node, pseudo p, and class: HH, LL, HL, LH, or NS where p is above the level."""
    rows = cut(_permuted(values, [col], w, n_perms, seed, key))
    local = F.transform(F.arrays_zip("z", "lag"), lambda x: x["z"] * x["lag"])
    seen = rows.where("batch = 0").select(key, F.col("z")[0].alias("z"), F.col("lag")[0].alias("lag"), (F.col("z")[0] * F.col("lag")[0]).alias("local_i"))
    tried = rows.select(key, F.when(F.col("batch") == 0, F.slice(local, 2, SIDE)).otherwise(local).alias("local")).join(seen.select(key, "local_i"), key)
    share = tried.groupBy(key).agg((F.sum(F.size(F.filter("local", lambda x: F.abs(x) >= F.abs("local_i") - 1e-12))) / float(n_perms)).alias("p"))
    return lisa_classes(seen.join(share, key), p)


def lisa_classes(rows: DataFrame, level: float = 0.05) -> DataFrame:
    kind = (
        F.when(F.col("p") > level, "NS").when((F.col("z") > 0) & (F.col("lag") > 0), "HH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL")
        .when((F.col("z") > 0) & (F.col("lag") < 0), "HL").otherwise("LH")
    )
    return rows.withColumn("class", kind)


def lisa_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("regions"))


def lisa_table(rows: DataFrame, values: DataFrame, key: str = "region") -> DataFrame:
    """The regions of a significant class with their values."""
    return rows.where("class <> 'NS'").join(values, key)
