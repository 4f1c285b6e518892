"""Region x time x feature tensors in coordinate form ``(i, j, k, value)``, and their decompositions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.cut import cut

MODES = ("i", "j", "k")
#: A factor table is broadcast up to this size in bytes.
SENT = 8 << 20


def build_tensor(tables: Mapping[str, DataFrame], cols: Mapping[str, Sequence[str]], region: str, time: str, how: str = "union") -> DataFrame:
    """Means by region, time and feature of several tables; holes take the mean of their time and feature, else 0;
    each feature standardised. ``how``: regions of any table, or of all. Tables are read once, for their means; all else rests on these."""
    means = [cut(df.groupBy(region, time).agg(*[F.avg(c).alias(f"{name}__{c}") for c in cols[name]])) for name, df in tables.items()]
    long = reduce(DataFrame.unionByName, [m.unpivot([region, time], [c for c in m.columns if c not in (region, time)], "k", "value") for m in means]).where("value IS NOT NULL")
    domain = reduce(DataFrame.intersect if how == "intersect" else DataFrame.union, [m.select(region).distinct() for m in means]).distinct()
    grid = domain.crossJoin(long.select(time).distinct()).crossJoin(long.select("k").distinct())  # the dense tensor asked for
    mean = long.groupBy(time, "k").agg(F.avg("value").alias("__m"))
    full = grid.join(long, [region, time, "k"], "left").join(mean, [time, "k"], "left").withColumn("value", F.coalesce("value", "__m", F.lit(0.0))).drop("__m")
    moments = full.groupBy("k").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("__m"), "__s"), F.lit(0.0))
    return full.join(moments, "k").select(F.col(region).alias("i"), F.col(time).alias("j"), "k", z.alias("value"))


#: Up to this many cells of the tensor make a block.
BLOCK = 1 << 18


class _Blocks:
    """The cells of a tensor, packed once into blocks of its longest mode.

    A block holds all cells of its indices of that mode, so their factor rows are computed where the cells lie and never
    move. The other two modes are numbered; their factors are sent to the tasks, and what tasks return is as large as such a
    factor. ``short`` tells whether both are below ``SENT`` bytes at ``width`` values an index; only then may blocks be used.
    Cells of one place are added up; null values are none. A tensor of zeros or without cells has factors of zeros."""

    def __init__(self, coo: DataFrame, width: int):
        coo = cut(coo.where("value IS NOT NULL").groupBy(*MODES).agg(F.sum("value").alias("value")))
        *sizes, self.cells, norm2 = coo.agg(*[F.countDistinct(m) for m in MODES], F.count("*"), F.sum(F.col("value") * F.col("value"))).first()
        self.sizes, self.norm2, self.coo = dict(zip(MODES, sizes, strict=True)), float(norm2 or 0.0), coo
        self.long = max(MODES, key=lambda m: self.sizes[m])
        self.short = tuple(m for m in MODES if m != self.long)
        self.fits = all(self.sizes[m] * (8 * width + 100) <= SENT for m in self.short)
        if self.fits:
            self.labels = {m: coo.select(m).distinct().sort(m).toArrow()[m].combine_chunks() for m in self.short}
            self.packed = cut(self._pack(coo).coalesce(max(1, -(-self.cells // BLOCK))))
            self.tasks = max(1, self.packed.rdd.getNumPartitions())

    def _pack(self, coo: DataFrame) -> DataFrame:
        (first, second), labels, kind = self.short, self.labels, coo.schema[self.long].dataType.simpleString()
        blocks = max(1, -(-self.cells // BLOCK))

        def pack(group: pa.Table) -> pa.Table:
            index = group["index"].combine_chunks().dictionary_encode()
            order = np.argsort(index.indices.to_numpy(), kind="stable")
            numbers = [index.indices, *(pc.index_in(group[c].combine_chunks(), labels[m]) for c, m in (("one", first), ("two", second)))]
            parts = [pa.array([n.to_numpy()[order].astype(np.int32).tobytes()]) for n in numbers]
            names = pa.ListArray.from_arrays(pa.array([0, len(index.dictionary)], pa.int32()), index.dictionary)
            return pa.Table.from_arrays([names, *parts, pa.array([group["value"].to_numpy()[order].astype(float).tobytes()])], ["names", "at", "one", "two", "value"])

        rows = coo.select(F.col(self.long).alias("index"), F.col(first).alias("one"), F.col(second).alias("two"), F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64(self.long), F.lit(blocks)).alias("block"))
        return rows.groupBy("block").applyInArrow(pack, f"names array<{kind}>, at binary, one binary, two binary, value binary")

    def total(self, work, *sizes: int) -> list[np.ndarray]:
        """Sums over all blocks of the arrays of ``sizes`` that ``work(at, one, two, value, n)`` returns for a block. Each
        task returns one sum; those of many tasks are added by Spark."""
        length = sum(sizes)

        def scan(batches):
            sums = np.zeros(length)
            for batch in batches:
                for row in _rows(batch):
                    sums += np.concatenate([x.ravel() for x in work(*row)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(sums)], ["at", "x"])

        parts = self.packed.drop("names").mapInArrow(scan, "at int, x double")
        if self.tasks * length * 12 > SENT:
            parts = parts.groupBy("at").agg(F.sum("x").alias("x"))
        got = parts.toArrow()
        return np.split(np.bincount(got["at"].to_numpy(), got["x"].to_numpy(), minlength=length), np.cumsum(sizes)[:-1])

    def tables(self, work, others: Mapping[str, np.ndarray]) -> dict[str, DataFrame]:
        """Factor tables: of the long mode the rows that ``work`` returns for a block, of the short ones those given."""

        def scan(batches):
            for batch in batches:
                for names, row in zip(batch.column("names"), _rows(batch.drop_columns("names")), strict=True):
                    yield pa.RecordBatch.from_arrays([names.values, pa.array(list(work(*row)), pa.list_(pa.float64()))], [long, "f"])

        long, kind = self.long, self.coo.schema[self.long].dataType.simpleString()
        out = {long: cut(self.packed.mapInArrow(scan, f"{long} {kind}, f array<double>"))}
        for m in self.short:
            out[m] = self.coo.sparkSession.createDataFrame(pa.Table.from_arrays([self.labels[m], pa.array(list(others[m]), pa.list_(pa.float64()))], [m, "f"]), self.coo.select(m, F.array(F.lit(0.0)).alias("f")).schema)
        return {m: out[m] for m in MODES}

    def spectral(self, ranks: Mapping[str, int], seed: int) -> dict[str, np.ndarray]:
        """Starts of the short modes: the first eigenvectors of the mode's Gram matrix, summed over pairs of cells that differ
        in that mode alone. A mode of over 1000 indices, and columns beyond its length, start from hashes."""
        sizes = {m: self.sizes[m] for m in self.short}
        wanted = [n for n, m in enumerate(self.short) if sizes[m] <= 1000]
        first, second = self.short

        def work(at, one, two, value, n):
            grams = []
            for mode, mine, other, width in ((0, one, two, sizes[second]), (1, two, one, sizes[first])):
                size = sizes[self_short[mode]]
                gram = np.zeros((size, size)) if mode in wanted else np.zeros(0)
                if mode in wanted:
                    fibre = at.astype(np.int64) * width + other
                    order = np.argsort(fibre, kind="stable")
                    new = np.concatenate(([True], np.diff(fibre[order]) != 0)) if len(order) else np.zeros(0, bool)
                    column, step = np.cumsum(new) - 1, max(1, (1 << 21) // size)
                    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
                        s, e = np.searchsorted(column, (lo, lo + step))
                        dense = np.zeros((size, step))
                        dense[mine[order[s:e]], column[s:e] - lo] = value[order[s:e]]
                        gram += dense @ dense.T
                grams.append(gram)
            return grams

        self_short = self.short
        grams = self.total(work, *(sizes[m] ** 2 if n in wanted else 0 for n, m in enumerate(self.short)))
        out = {}
        for n, m in enumerate(self.short):
            draw = np.random.default_rng(seed + n).uniform(-1, 1, (sizes[m], ranks[m]))
            if n in wanted and sizes[m]:
                vectors = _first_eigenvectors(grams[n].reshape(sizes[m], sizes[m]), ranks[m])
                draw[:, : vectors.shape[1]] = vectors
            out[m] = draw
        return out


def _rows(batch: pa.RecordBatch):
    """``at, one, two, value`` of each block and how many indices of the long mode it has."""
    for at, one, two, value in zip(*(batch.column(c) for c in ("at", "one", "two", "value")), strict=True):
        numbers = [np.frombuffer(x.as_py(), np.int32) for x in (at, one, two)]
        yield *numbers, np.frombuffer(value.as_py(), float), int(numbers[0][-1]) + 1 if len(numbers[0]) else 0


def _first_eigenvectors(gram: np.ndarray, n: int) -> np.ndarray:
    """Columns by falling eigenvalue, each with its largest entry positive."""
    vectors = np.linalg.eigh(gram)[1][:, ::-1][:, :n]
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _summed(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by index."""
    return np.stack([np.bincount(index, col, minlength=size) for col in rows.T], 1) if rows.size else np.zeros((size, rows.shape[1]))


def cp_als(coo: DataFrame, rank: int, iters: int = 200, tol: float = 1e-8, seed: int = 42, ridge: float = 1e-12) -> tuple[dict[str, DataFrame], float]:
    """CP decomposition by alternating least squares: a factor table ``(index, f array)`` for each mode, and the relative error.

    Starts from the singular vectors of the tensor laid out by mode. Ends when the error moves by less than ``tol``, or
    after ``iters`` rounds. A round is two jobs without a shuffle over packed cells (see ``_Blocks``): one solves the rows of the longest mode,
    block by block, and returns their Gram matrix with the sums that the second mode needs; the other solves the same
    rows again, from what was sent, and returns the sums of the third. The error comes from norms and these sums.
    Where the two shorter modes are too long to be sent, rounds of joins and sums do the same (``_cp_joined``)."""
    blocks = _Blocks(coo, rank)
    if not blocks.fits:
        return _cp_joined(blocks.coo, rank, iters, tol, seed, ridge)
    a, b = blocks.short
    size_a, size_b = blocks.sizes[a], blocks.sizes[b]
    start = blocks.spectral({a: rank, b: rank}, seed)
    fa, fb, last, error, solve = start[a], start[b], None, 0.0, None

    def rows_of(fa, fb, inverse):
        return lambda at, one, two, value, n: _summed(at, value[:, None] * fa[one] * fb[two], n) @ inverse

    for _ in range(iters):
        inverse = np.linalg.pinv((fa.T @ fa) * (fb.T @ fb) + ridge * np.eye(rank))
        solve = rows_of(fa, fb, inverse)

        def first(at, one, two, value, n, solve=solve, fb=fb):
            f = solve(at, one, two, value, n)
            return f.T @ f, _summed(one, value[:, None] * f[at] * fb[two], size_a)

        gram, sums = (x.reshape(-1, rank) for x in blocks.total(first, rank * rank, size_a * rank))
        fa = sums @ np.linalg.pinv(gram * (fb.T @ fb) + ridge * np.eye(rank))
        (sums,) = blocks.total(lambda at, one, two, value, n, solve=solve, fa=fa: [_summed(two, value[:, None] * solve(at, one, two, value, n)[at] * fa[one], size_b)], size_b * rank)
        sums = sums.reshape(-1, rank)
        fb = sums @ np.linalg.pinv(gram * (fa.T @ fa) + ridge * np.eye(rank))
        model2 = float((gram * (fa.T @ fa) * (fb.T @ fb)).sum())
        error = float(np.sqrt(max(0.0, blocks.norm2 - 2 * float((sums * fb).sum()) + model2) / blocks.norm2)) if blocks.norm2 else 0.0
        if last is not None and abs(last - error) < tol:
            break
        last = error
    return blocks.tables(solve or rows_of(fa, fb, np.zeros((rank, rank))), {a: fa, b: fb}), error


def _drawn(coo: DataFrame, mode: str, rank: int, seed: int) -> DataFrame:
    draws = [(F.pmod(F.xxhash64(mode, F.lit(r), F.lit(seed)), F.lit(1 << 20)) / float(1 << 19) - 1).alias(f"f{r}") for r in range(rank)]
    return cut(coo.select(mode).distinct().select(mode, F.array(*draws).alias("f")))


def _gram(factor: DataFrame, rank: int) -> np.ndarray:
    row = factor.agg(*[F.sum(F.col("f")[a] * F.col("f")[b]) for a in range(rank) for b in range(rank)]).first()
    return np.array(row, float).reshape(rank, rank)


def _cp_joined(coo: DataFrame, rank: int, iters: int, tol: float, seed: int, ridge: float) -> tuple[dict[str, DataFrame], float]:
    """The same by joins of the cells with two factor tables, which may have any length; starts from hashes."""
    factors = {m: _drawn(coo, m, rank, seed + n) for n, m in enumerate(MODES)}
    grams = {m: _gram(factors[m], rank) for m in MODES}
    norm2, last, error = float(coo.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0), None, 0.0
    for _ in range(iters):
        for mode in MODES:
            a, b = (m for m in MODES if m != mode)
            beside = coo.join(factors[a].withColumnRenamed("f", "fa"), a).join(factors[b].withColumnRenamed("f", "fb"), b)
            sums = beside.groupBy(mode).agg(F.array(*[F.sum(F.col("value") * F.col("fa")[r] * F.col("fb")[r]) for r in range(rank)]).alias("s"))
            inverse = np.linalg.pinv(grams[a] * grams[b] + ridge * np.eye(rank))
            rows = [F.aggregate(F.zip_with("s", F.array(*map(F.lit, map(float, col))), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y) for col in inverse.T]
            solved = cut(sums.select(mode, "s", F.array(*rows).alias("f")))
            factors[mode] = solved.drop("s")
            grams[mode] = _gram(solved, rank)
        inner = solved.agg(*[F.sum(F.col("s")[r] * F.col("f")[r]) for r in range(rank)]).first()
        model2 = float((grams["i"] * grams["j"] * grams["k"]).sum())
        error = float(np.sqrt(max(0.0, norm2 - 2 * sum(x or 0.0 for x in inner) + model2) / norm2)) if norm2 else 0.0
        if last is not None and abs(last - error) < tol:
            break
        last = error
    return factors, error


def cp_sweep(coo: DataFrame, ranks: Sequence[int], **how) -> DataFrame:
    """The relative error of each rank."""
    coo = cut(coo)  # one for all ranks
    return coo.sparkSession.createDataFrame([(r, cp_als(coo, r, **how)[1]) for r in ranks], "rank int, error double")


def tucker_ranks(sizes: Sequence[int], share: float = 0.6, caps: Sequence[int] = (15, 12, 12)) -> tuple[int, ...]:
    return tuple(max(1, min(int(n * share), c)) for n, c in zip(sizes, caps, strict=True))


def tucker_hooi(coo: DataFrame, ranks: Sequence[int], iters: int = 200, tol: float = 1e-8, seed: int = 42) -> tuple[dict[str, DataFrame], DataFrame, float]:
    """Tucker decomposition: orthonormal factors, core ``(a, b, c, value)`` and relative error.

    Starts from the singular vectors of the tensor laid out by mode and refines by orthogonal iteration until the error
    moves by less than ``tol``, or ``iters`` rounds. A round is three jobs without a shuffle over packed cells (see
    ``_Blocks``): the Gram matrix of the longest mode's rows, contracted with the other factors; then the contractions
    of the two others, each with the newest factors. A rank is cut to its mode's length and to the product of the others. Both
    shorter modes must be short enough to be sent (``ValueError`` otherwise): the core is no smaller problem."""
    rank = dict(zip(MODES, ranks, strict=True))
    blocks = _Blocks(coo, max(rank.values()) ** 2)
    if not blocks.fits:
        raise ValueError("two of the modes must be short enough to be sent to the tasks")
    rank = {m: max(1, min(rank[m], blocks.sizes[m])) for m in MODES}
    rank = {m: min(rank[m], int(np.prod([rank[o] for o in MODES if o != m]))) for m in MODES}
    (a, b), long = blocks.short, blocks.long
    ra, rb, rl, size_a, size_b = rank[a], rank[b], rank[long], blocks.sizes[a], blocks.sizes[b]
    start = blocks.spectral({a: ra, b: rb}, seed)
    ua, ub = (np.linalg.qr(start[m])[0] for m in (a, b))
    last, error, core, rows = None, 0.0, np.zeros((rl, ra, rb)), None

    def wide(at, one, two, value, n, ua, ub):
        """Rows of the longest mode, contracted with both factors."""
        out = np.zeros((n, ua.shape[1] * ub.shape[1]))
        for s in range(0, len(at), 1 << 14):
            e = s + (1 << 14)
            part = (value[s:e, None, None] * ua[one[s:e], :, None] * ub[two[s:e], None, :]).reshape(len(at[s:e]), -1)
            lo = at[s]
            out[lo : at[s:e][-1] + 1] += _summed(at[s:e] - lo, part, int(at[s:e][-1]) - int(lo) + 1)
        return out

    def mixed(index, size, left, right, value):
        """Rows of a short mode, contracted with the rows ``left`` and ``right`` of the others at each cell."""
        out = np.zeros((size, left.shape[1] * right.shape[1]))
        for s in range(0, len(index), 1 << 14):
            e = s + (1 << 14)
            out += _summed(index[s:e], (value[s:e, None, None] * left[s:e, :, None] * right[s:e, None, :]).reshape(len(index[s:e]), -1), size)
        return out

    for _ in range(iters):
        (gram,) = blocks.total(lambda at, one, two, value, n, ua=ua, ub=ub: [(w := wide(at, one, two, value, n, ua, ub)).T @ w], (ra * rb) ** 2)
        values, vectors = np.linalg.eigh(gram.reshape(ra * rb, ra * rb))
        values, vectors = values[::-1][:rl], vectors[:, ::-1][:, :rl]
        keep = vectors * np.where(values > 1e-14 * max(values[0], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        rows = lambda at, one, two, value, n, ua=ua, ub=ub, keep=keep: wide(at, one, two, value, n, ua, ub) @ keep
        (y,) = blocks.total(lambda at, one, two, value, n, rows=rows, ub=ub: [mixed(one, size_a, rows(at, one, two, value, n)[at], ub[two], value)], size_a * rl * rb)
        ua = np.linalg.svd(y.reshape(size_a, -1), full_matrices=False)[0][:, :ra]
        (y,) = blocks.total(lambda at, one, two, value, n, rows=rows, ua=ua: [mixed(two, size_b, rows(at, one, two, value, n)[at], ua[one], value)], size_b * rl * ra)
        ub = np.linalg.svd(y.reshape(size_b, -1), full_matrices=False)[0][:, :rb]
        core = (ub.T @ y.reshape(size_b, -1)).reshape(rb, rl, ra).transpose(1, 2, 0)
        error = float(np.sqrt(max(0.0, blocks.norm2 - float((core**2).sum())) / blocks.norm2)) if blocks.norm2 else 0.0
        if last is not None and abs(last - error) < tol:
            break
        last = error
    factors = blocks.tables(rows or (lambda at, one, two, value, n: np.zeros((n, rl))), {a: ua, b: ub})
    core = core.transpose([(long, a, b).index(m) for m in MODES])
    cells = [(*map(int, at), float(v)) for at, v in np.ndenumerate(core)]
    return factors, coo.sparkSession.createDataFrame([(x, y, z, v) for *at, v in cells for x, y, z in [at]], "a int, b int, c int, value double"), error


def reconstruct(factors: Mapping[str, DataFrame], cells: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """What the factors, and for a Tucker decomposition the core, make of the places ``(i, j, k)`` of ``cells``: the columns
    of ``cells`` and ``model``. A core is small: it goes into the rows of the third mode's table before the join."""
    out = cells
    third = factors["k"].withColumnRenamed("f", "fk")
    if core is not None:
        long = third.select("k", F.posexplode("fk").alias("c", "w")).join(core, "c").groupBy("k", "a", "b").agg(F.sum(F.col("w") * F.col("value")).alias("v"))
        third = long.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("a", "b", "v"))).alias("fk"))
    for m, table in (("i", factors["i"].withColumnRenamed("f", "fi")), ("j", factors["j"].withColumnRenamed("f", "fj")), ("k", third)):
        out = out.join(table, m)
    add = lambda s, x: s + x
    if core is None:
        model = F.aggregate(F.zip_with(F.zip_with("fi", "fj", lambda x, y: x * y), "fk", lambda x, y: x * y), F.lit(0.0), add)
    else:
        model = F.aggregate(F.transform("fk", lambda x: F.get("fi", x["a"]) * F.get("fj", x["b"]) * x["v"]), F.lit(0.0), add)
    return out.select(*cells.columns, model.alias("model"))


def tucker_sweep(coo: DataFrame, ranks: Sequence[int], feature_ranks: Sequence[int], **how) -> DataFrame:
    coo = cut(coo)  # one for all ranks
    return coo.sparkSession.createDataFrame([(r, tucker_hooi(coo, (*ranks[:2], r), **how)[2]) for r in feature_ranks], "feature_rank int, error double")


def loadings(factors: Mapping[str, DataFrame]) -> DataFrame:
    """Long factor table ``(mode, index, component, loading)``."""
    parts = [t.select(F.lit(m).alias("mode"), F.col(m).cast("string").alias("index"), F.posexplode("f").alias("component", "loading")) for m, t in factors.items()]
    return reduce(DataFrame.union, parts)


def component_variance(long: DataFrame) -> DataFrame:
    """Weight of each component (product of its columns' norms), share, running share."""
    norms = long.groupBy("mode", "component").agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("n"))
    weight = norms.groupBy("component").agg(F.exp(F.sum(F.ln(F.greatest("n", F.lit(1e-300))))).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    running = F.sum("weight").over(Window.orderBy(F.desc("weight"), "component").rowsBetween(Window.unboundedPreceding, 0))
    return weight.select("component", "weight", F.try_divide("weight", total).alias("share"), F.try_divide(running, total).alias("cumulative_share"))


def score_table(long: DataFrame, rank: int, names: DataFrame, mode: str = "i") -> DataFrame:
    """A row for each index of a mode: the columns of ``names`` (``index`` among them) and a score column for each component."""
    wide = long.where(F.col("mode") == mode).groupBy("index").agg(*[F.max(F.when(F.col("component") == c, F.col("loading"))).alias(f"c{c + 1}") for c in range(rank)])
    return names.join(wide, "index")


def top_loadings(long: DataFrame, mode: str = "i", n: int = 10) -> DataFrame:
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "index")
    return long.where(F.col("mode") == mode).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def component_sources(long: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Mean size of the feature loadings by component and source table (the name before the two underscores), and how many
    sources are above the threshold."""
    feats = long.where("mode = 'k'").withColumn("source", F.split("index", "__")[0])
    means = feats.groupBy("component", "source").agg(F.avg(F.abs("loading")).alias("mean_loading"))
    active = F.count_if(F.col("mean_loading") >= threshold).over(Window.partitionBy("component"))
    kind = F.when(F.col("active") >= 3, "all tables").when(F.col("active") == 2, "two tables").when(F.col("active") == 1, "one table").otherwise("none")
    return means.withColumn("active", active).withColumn("kind", kind)


def component_correlation(long: DataFrame, a: int, b: int, mode: str = "i") -> DataFrame:
    wide = long.where(F.col("mode") == mode).groupBy("index").agg(*[F.max(F.when(F.col("component") == c, F.col("loading"))).alias(n) for c, n in ((a, "x"), (b, "y"))])
    return wide.agg(F.corr("x", "y").alias("r"))


def tensor_summary(coo: DataFrame) -> DataFrame:
    return coo.agg(*[F.countDistinct(m).alias(f"size_{m}") for m in MODES], F.count("*").alias("cells"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
