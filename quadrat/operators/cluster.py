"""Scaling, components, clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.cut import cut


def zscore_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and population deviations."""
    return df.agg(*[f(c).alias(f"__{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])


def zscore_apply(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardised columns; 0 where the deviation is 0."""
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)) for c in cols}
    return df.crossJoin(params).withColumns(z).select(*df.columns)


def zscore_invert(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.crossJoin(params).withColumns({c: F.col(c) * F.col(f"__s_{c}") + F.col(f"__m_{c}") for c in cols}).select(*df.columns)


def minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column is 0."""
    ends = df.agg(*[f(c).alias(f"__{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))])
    out = {c: F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"__lo_{c}"), (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double")), F.lit(0.0)) for c in cols}
    return df.crossJoin(ends).withColumns(out).select(*df.columns)


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    df = cut(df)  # moments and rows: what lies behind is worked out once
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(zscore_apply(df, zscore_fit(df, cols), cols))


def pca2(df: DataFrame, cols: Sequence[str], key: str) -> tuple[DataFrame, list[float]]:
    """``(key, pc1, pc2)`` of the standardised columns, and the explained shares. The largest weight of a component is positive."""
    vectors = _vectors(df, cols)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vectors)
    weights, pc = model.pc.toArray(), vector_to_array("pc")
    signs = [-1.0 if w[np.abs(w).argmax()] < 0 else 1.0 for w in weights.T]
    return model.transform(vectors).select(key, (pc[0] * signs[0]).alias("pc1"), (pc[1] * signs[1]).alias("pc2")), list(model.explainedVariance)


#: Rows that one task of a fit takes.
FIT = 1 << 16


def kmeans_sweep(df: DataFrame, cols: Sequence[str], key: str, ks: Sequence[int] = range(2, 11), seed: int = 42, n_init: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(k, inertia, silhouette)`` of the best of ``n_init`` runs for each k, and the labels of the k whose Euclidean
    silhouette is best (the smallest of several). Distances of all rows are summed once, for all k together."""
    vectors = cut(_vectors(df, cols).select(key, "features"))
    vectors = vectors.coalesce(max(1, -(-vectors.count() // FIT)))  # each round of each fit is a job: of a few rows, one of few tasks
    inertia, labelled = {}, vectors
    for k in ks:
        best = min((KMeans(k=k, seed=seed + i).fit(vectors) for i in range(n_init)), key=lambda m: m.summary.trainingCost)
        inertia[k] = float(best.summary.trainingCost)
        labelled = best.setPredictionCol(f"__k{k}").transform(labelled)
    labelled = cut(labelled.withColumn("features", vector_to_array("features")))
    shown = {r.labels: r.silhouette for r in silhouettes(labelled, "features", [f"__k{k}" for k in ks]).collect()}
    scores = [(k, inertia[k], shown[f"__k{k}"]) for k in ks]
    top = max(scores, key=lambda s: (s[2], -s[0]))[0]
    return df.sparkSession.createDataFrame(scores, "k int, inertia double, silhouette double"), labelled.select(key, F.col(f"__k{top}").alias("label"))


#: Rows of a block whose distances to another block are measured at once, and blocks of a group.
ROWS, GROUP = 1024, 32


def silhouettes(df: DataFrame, vector: str, labels: Sequence[str]) -> DataFrame:
    """The mean Euclidean silhouette under each of several label columns: ``(labels, silhouette, rows, clusters)``.

    Every two rows are measured, by definition, but only once for all labellings: rows are packed into blocks and blocks into
    groups. Every two groups meet in one task, which multiplies blocks as matrices and adds up the distances of each row of both to each
    cluster. So a block moves, and its sums move, once for each group, and a task holds two groups. A row that is
    alone in its cluster counts 0, and so does everything under a single label. Labels must not be null; they and vectors of doubles of one length
    are all that is read."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.array(*[F.col(c).cast("string") for c in labels]).alias("l"))
    known = rows.select(F.posexplode("l").alias("at", "label")).groupBy("at", "label").agg(F.count("*").alias("n")).collect()  # labels are few
    book = [sorted((r.label, r.n) for r in known if r.at == i) for i in range(len(labels))]
    places, sizes = [{label: i for i, (label, _) in enumerate(b)} for b in book], [np.array([n for _, n in b], float) for b in book]
    firsts = np.cumsum([0, *map(len, sizes)])  # columns of the sums where each labelling begins
    blocks = max(1, -(-int(sum(sizes[0])) // ROWS)) if known else 1
    groups = max(-(-blocks // GROUP), min(blocks, 8))  # of few blocks smaller groups, so that many tasks share the work

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch.column("v").to_pylist(), float)
                own = np.array([[p[x] for p, x in zip(places, row, strict=True)] for row in batch.column("l").to_pylist()], np.int32)
                for i in range(0, len(v), ROWS):
                    part = v[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([own[i : i + ROWS].tobytes()], pa.binary())], ["n", "v", "l"])

    packed = cut(rows.repartition(blocks).mapInArrow(pack, "n int, v binary, l binary").withColumn("id", F.monotonically_increasing_id()))

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the rows of two blocks. Products of matrices lose digits where rows are near one another beside
        their length: those pairs are measured by differences."""
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        both = aa[:, None] + bb
        d = both - 2 * (a @ b.T)
        near = np.argwhere(~(d > 1e-6 * both))
        for s in range(0, len(near), 1 << 14):
            i, j = near[s : s + (1 << 14)].T
            d[i, j] = ((a[i] - b[j]) ** 2).sum(1)
        return np.sqrt(d)

    def measure(group: pa.Table) -> pa.Table:
        """The sums of each block of two groups over the blocks of the other, or of its own group."""
        one, two = group["one"][0].as_py(), group["two"][0].as_py()
        held = []
        for at, side, n, v, l in zip(*(group[c].to_pylist() for c in ("id", "group", "n", "v", "l")), strict=True):
            own = np.frombuffer(l, np.int32).reshape(n, -1)
            member = np.zeros((n, firsts[-1]))
            for i, first in enumerate(firsts[:-1]):
                member[np.arange(n), first + own[:, i]] = 1
            held.append((at, side, np.frombuffer(v, float).reshape(n, -1), member, np.zeros((n, firsts[-1]))))
        held.sort(key=lambda h: h[0])
        for x, (_, side, a, ma, sa) in enumerate(held):
            for y, (_, other, b, mb, sb) in enumerate(held):
                if (one == two and x <= y) or (side == one and other == two and one != two):
                    d = apart(a, b)
                    if x == y:
                        np.fill_diagonal(d, 0.0)
                    else:
                        sb += d.T @ ma
                    sa += d @ mb
        return pa.table({"id": pa.array([h[0] for h in held], pa.int64()), "sums": pa.array([h[4].tobytes() for h in held], pa.binary())})

    def score(group: pa.Table) -> pa.Table:
        """All partial sums of one block of rows."""
        own = np.frombuffer(next(x for x in group["l"].to_pylist() if x is not None), np.int32).reshape(-1, len(sizes))
        sums = np.zeros((len(own), firsts[-1]))
        for part in group["sums"]:
            if part.is_valid:
                sums += np.frombuffer(part.as_py(), float).reshape(sums.shape)
        out = []
        for i, size in enumerate(sizes):
            total = sums[:, firsts[i] : firsts[i + 1]]
            at, mine = np.arange(len(own)), own[:, i]
            if len(size) > 1:
                inside = total[at, mine] / np.maximum(size[mine] - 1, 1)
                means = total / size
                means[at, mine] = np.inf
                outside = means.min(1)
                most = np.maximum(inside, outside)
                out.append(float(np.where((size[mine] > 1) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0.0).sum()))
            else:
                out.append(0.0)
        return pa.table({"at": pa.array(range(len(out)), pa.int32()), "total": pa.array(out, pa.float64()), "n": pa.array([len(own)] * len(out), pa.int64())})

    mine = packed.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.struct(F.least("group", g).alias("one"), F.greatest("group", g).alias("two"))))
    sent = mine.withColumn("p", pairs).select((F.col("p.one") * groups + F.col("p.two")).alias("pair"), "p.one", "p.two", "id", "group", "n", "v", "l")
    tasks = min(groups * (groups + 1) // 2, 4096)  # by number: few bytes are much work here
    sums = sent.repartition(tasks, "pair").groupBy("pair").applyInArrow(measure, "id long, sums binary")
    together = sums.select("id", F.lit(None).cast("binary").alias("l"), "sums").unionByName(packed.select("id", "l", F.lit(None).cast("binary").alias("sums")))
    scored = together.groupBy("id").applyInArrow(score, "at int, total double, n long")
    named = F.element_at(F.array(*map(F.lit, labels)), F.col("at") + 1)
    clusters = F.element_at(F.array(*[F.lit(len(s)) for s in sizes]), F.col("at") + 1)
    return scored.groupBy("at").agg(F.sum("total").alias("t"), F.sum("n").alias("rows")).select(named.alias("labels"), F.try_divide("t", "rows").alias("silhouette"), "rows", clusters.alias("clusters"))


def silhouette(df: DataFrame, cols: Sequence[str], key: str, label: str = "label") -> DataFrame:
    """Euclidean silhouette of each row of an aggregated table; every pair of rows is measured, by definition."""
    rows = df.select(key, label, F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    other = rows.select(F.col(key).alias("__k"), F.col(label).alias("__l"), F.col("v").alias("__v"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "__v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    pairs = rows.join(other, F.col(key) != F.col("__k")).groupBy(key, label, "__l").agg(F.avg(d).alias("mean_d"))
    each = pairs.groupBy(key, label).agg(F.min(F.when(F.col(label) == F.col("__l"), F.col("mean_d"))).alias("a"), F.min(F.when(F.col(label) != F.col("__l"), F.col("mean_d"))).alias("b"))
    return each.select(key, label, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


#: Halvings of cells before points are compared.
LEVELS = 5


def dbscan(df: DataFrame, key: str, x: str = "x", y: str = "y", eps: float = 0.8, min_pts: int = 5, max_rounds: int = 40) -> DataFrame:
    """Density clusters: ``(key, label)``, noise -1, clusters numbered by their smallest core key; border points take the
    smallest cluster of a core within ``eps``. Keys must differ; rows without a coordinate are noise.

    Cells have the side ``eps / sqrt(2)``, so all points of a cell are neighbours: those of a cell that holds ``min_pts`` are core
    without looking, and the cores of a cell are in one cluster. Only points of other cells, fewer than ``min_pts`` each,
    are compared with points around them, so pairs grow with the points and not with the square of a dense cell. Which
    cells are linked is decided on halves, quarters and so on of cells that hold cores (see ``_linked``). Clusters are
    the components of the cells."""
    side = eps / 2**0.5
    given = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    pts = given.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    full = pts.groupBy("cx", "cy").agg(F.count("*").alias("here"))
    pts = cut(pts.join(full, ["cx", "cy"]))
    sparse = pts.where(F.col("here") < min_pts)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    close = F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2) <= eps * eps

    def around(points: DataFrame, others: DataFrame) -> DataFrame:
        moved = points.withColumn("s", steps).select("k", F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
        return moved.join(others, ["cx", "cy"]).where(close)

    counts = around(sparse, pts.select("cx", "cy", "x", "y")).groupBy("k").agg(F.count("*").alias("n"))
    found = pts.join(counts, "k", "left").withColumn("core", (F.col("here") >= min_pts) | (F.coalesce("n", F.lit(0)) >= min_pts))
    pts = cut(found.select("k", "x", "y", "cx", "cy", "core"))
    cells = pts.where("core").groupBy("cx", "cy").agg(F.min("k").alias("rep"))
    cores = cut(pts.where("core").join(cells, ["cx", "cy"]).select("k", "x", "y", "cx", "cy", "rep"))
    links = cut(_linked(cores, side, eps))
    labels = cut(cores.select(F.col("rep").alias("k")).distinct().withColumn("l", F.col("k")))
    for _ in range(max_rounds):
        heard = links.join(labels.select(F.col("k").alias("k2"), "l"), "k2").groupBy("k").agg(F.min("l").alias("m"))
        lower = labels.join(heard, "k", "left").select("k", F.least("l", F.coalesce("m", "l")).alias("p"))
        short = lower.join(lower.select(F.col("k").alias("p"), F.col("p").alias("g")), "p").select("k", F.least("p", "g").alias("l"))
        nxt = cut(short)
        moved = nxt.join(labels.withColumnRenamed("l", "old"), "k").where("l <> old").limit(1).count()
        labels = nxt
        if not moved:
            break
    else:
        raise RuntimeError(f"labels did not settle within {max_rounds} rounds")
    cores = cores.join(labels.withColumnRenamed("k", "rep"), "rep").select("k", "x", "y", "cx", "cy", "l")
    border = around(pts.where("NOT core"), cores.select("cx", "cy", "x", "y", "l")).groupBy("k").agg(F.min("l").alias("l"))
    of = cores.select("k", "l").union(border)
    numbers = labels.select("l").distinct()
    numbers = numbers.withColumn("label", (F.row_number().over(Window.orderBy("l")) - 1).cast("int"))  # one row a cluster
    out = of.join(numbers, "l").select(F.col("k").alias(key), "label")
    return df.select(key).join(out, key, "left").na.fill(-1, subset=["label"])


def _linked(cores: DataFrame, side: float, eps: float) -> DataFrame:
    """Pairs of cells ``(k, k2)``, by their representatives, that hold two cores within ``eps``; both directions.

    Two boxes are linked if their farthest corners are near enough, and are not if their nearest are too far. Of the rest,
    as long as nothing links their cells, the quarters that hold cores are taken; what is open after some rounds is compared by points.
    So of two dense cells a few boxes are looked at, not all pairs."""
    reps = cores.select("rep", F.col("cx").alias("bx"), F.col("cy").alias("by")).distinct()
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]))
    moved = reps.withColumn("s", steps).select(F.col("rep").alias("r1"), F.col("bx").alias("ax"), F.col("by").alias("ay"), (F.col("bx") + F.col("s.i")).alias("bx"), (F.col("by") + F.col("s.j")).alias("by"))
    open_, linked = moved.join(reps.withColumnRenamed("rep", "r2"), ["bx", "by"]), None
    for level in range(LEVELS + 1):
        size = side / 2**level
        dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
        far = (F.pow(dx + 1, 2) + F.pow(dy + 1, 2)) * size * size
        near = (F.pow(F.greatest(dx - 1, F.lit(0)), 2) + F.pow(F.greatest(dy - 1, F.lit(0)), 2)) * size * size
        boxes = cut(open_.where(near <= eps * eps * (1 + 1e-12)).withColumn("sure", far <= eps * eps * (1 - 1e-12)))
        sure = boxes.where("sure").select("r1", "r2").distinct()
        linked = sure if linked is None else linked.union(sure)
        open_ = boxes.join(sure, ["r1", "r2"], "left_anti").drop("sure")
        if level == LEVELS or not open_.limit(1).count():
            break
        half = size / 2
        parts = cores.select("rep", F.floor(F.col("x") / half).alias("x"), F.floor(F.col("y") / half).alias("y")).distinct()
        for r, a, b in (("r1", "ax", "ay"), ("r2", "bx", "by")):
            mine = parts.select(F.col("rep").alias(r), F.floor(F.col("x") / 2).alias(a), F.floor(F.col("y") / 2).alias(b), F.col("x").alias(f"{a}_"), F.col("y").alias(f"{b}_"))
            open_ = open_.join(mine, [r, a, b]).drop(a, b).withColumnsRenamed({f"{a}_": a, f"{b}_": b})
    size = side / 2**level
    inside = cores.select("rep", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"), "x", "y")
    first = inside.withColumnsRenamed({"rep": "r1", "bx": "ax", "by": "ay", "x": "x1", "y": "y1"})
    met = open_.join(first, ["r1", "ax", "ay"]).join(inside.withColumnRenamed("rep", "r2"), ["r2", "bx", "by"])
    met = met.where(F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2) <= eps * eps).select("r1", "r2").distinct()
    pairs = linked.union(met)
    return pairs.select(F.col("r1").alias("k"), F.col("r2").alias("k2")).union(pairs.select("r2", "r1"))


def cluster_profile(df: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """Size and means of each cluster, noise left out."""
    return df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("regions"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
