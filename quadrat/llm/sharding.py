"""Sharding along a Hilbert curve through several metadata dimensions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.store import stage, unstage


def hilbert_index(coords: Column, dims: int, bits: int) -> Column:
    """Place on the Hilbert curve of a point, given as an array of ``dims`` ints of ``bits`` bits each.

    Works on the point one bit plane at a time, from the highest: undo the rotation of each sub-cube, then turn the
    Gray code that is left into a number. ``dims * bits`` must stay below 63. All steps are plain bit operations; each
    binds what the one before has found, so that nothing is worked out twice.
    """
    bind = lambda value, step: F.transform(F.array(value), step)[0]
    bit = lambda x, q: x.bitwiseAND(F.lit(q).cast("long")) != 0
    flipped = lambda x, m: x.bitwiseXOR(m)

    def rotate(q: int, dim: int):
        def step(x: Column) -> Column:
            low = F.lit(q - 1).cast("long")
            swap = x[0].bitwiseXOR(x[dim]).bitwiseAND(low)
            to = [x[i] for i in range(dims)]
            to[0] = F.when(bit(x[dim], q), flipped(x[0], low)).otherwise(flipped(x[0], swap))
            if dim:
                to[dim] = F.when(bit(x[dim], q), x[dim]).otherwise(flipped(x[dim], swap))
            return F.array(*to)

        return step

    def gray(x: Column) -> Column:
        found = [x[0]]
        for i in range(1, dims):
            found.append(found[-1].bitwiseXOR(x[i]))
        return F.array(*found)

    def unfolded(x: Column) -> Column:
        flip = F.lit(0).cast("long")
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(bit(x[dims - 1], 1 << b), F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
        return bind(flip, lambda t: F.array(*[x[i].bitwiseXOR(t) for i in range(dims)]))

    def woven(x: Column) -> Column:
        total = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(dims):
                total = total * 2 + F.shiftright(x[i], b).bitwiseAND(F.lit(1).cast("long"))
        return total

    x = F.transform(coords, lambda v: v.cast("long"))
    for b in range(bits - 1, 0, -1):
        for dim in range(dims):
            x = bind(x, rotate(1 << b, dim))
    return bind(bind(bind(x, gray), unfolded), woven)


def _quantised(df: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """A number of ``bits`` bits for each dimension, in the order of its values.

    A dimension of no more values than steps has one step for each, spread evenly. Of one with more, the values that cut all
    rows into equal parts are the borders of steps. Null takes step 0; a dimension of one value is step 0 throughout.
    """
    levels, out = 1 << bits, []
    for c in dims:
        values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().limit(levels + 1).collect()]
        if len(values) > levels:
            step = F.size(F.filter(_literals(df, c, _borders(df, c, levels)), lambda q: q <= F.col(c)))
        else:
            place = F.array_position(_literals(df, c, sorted(values)), F.col(c)) - 1
            step = F.floor(place * levels / max(1, len(values)))
        out.append(F.coalesce(step.cast("int"), F.lit(0)))
    return out


def _borders(df: DataFrame, name: str, parts: int) -> list:
    """The values at the places ``rows * i // parts`` of all rows in order, nulls left out; each once.

    Values are counted and dealt to tasks by range. Only the rows of each range go to the driver, to say at which place
    it begins; the values are numbered range by range."""
    counted = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    counted = stage(counted.repartitionByRange("v").withColumn("range", F.spark_partition_id()), "values")
    sizes = dict(counted.groupBy("range").agg(F.sum("n")).collect())
    before = dict(zip(sorted(sizes), accumulate((sizes[k] for k in sorted(sizes)), initial=0)))
    rows = sum(sizes.values())
    places = F.array(*[F.lit(rows * i // parts).cast("long") for i in range(1, parts)])
    start = F.create_map(*[F.lit(x) for k, n in before.items() for x in (k, n)])[F.col("range")]
    end = start + F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    found = counted.withColumn("end", end).where(F.exists(places, lambda p: (p < F.col("end")) & (p >= F.col("end") - F.col("n"))))
    borders = sorted(r.v for r in found.select("v").collect())
    unstage(counted)
    return borders


def _literals(df: DataFrame, name: str, values: Sequence) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{df.schema[name].dataType.simpleString()}>")


def curve_shards(df: DataFrame, dims: Sequence[str], shards: int = 40, bits: int = 5, ties: Sequence[str] = (), salts: int = 32) -> DataFrame:
    """Order the rows of ``df`` along a Hilbert curve through ``dims`` and cut the order into ``shards`` equal runs.

    Adds ``curve`` (index of the row's cell), ``shard`` and ``slot`` (place in the shard, gapless from 0). Shard sizes
    differ by one row at most. Rows near one another in all dimensions share few shards, so the smallest and largest
    values that a file keeps of each dimension exclude most files for a filter on any of them.

    The index is worked out for each cell, in as many tasks as there are shards, before the cells are put in one order.
    Only counts are gathered: one for each cell (at most ``2 ** (bits * len(dims))``, whatever the number of rows)
    and, below it, for each of ``salts`` hash classes of a cell. Rows are numbered within their class, which no cell
    however full brings into one task, and the counts turn that into the place in the whole. Within a cell rows lie by
    class, then by ``ties``; rows equal in all of ``ties`` may trade places.

    Null values take part as the lowest step. An empty table gives an empty result; with fewer rows than shards some
    shards stay empty.
    """
    named = [f"__q{i}" for i in range(len(dims))]
    rows = df.withColumns(dict(zip(named, _quantised(df, dims, bits), strict=True)))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*(ties or dims)), F.lit(salts)).cast("int"))
    order = [F.col(c) for c in ties] or [F.lit(0)]
    placed = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*named, "__salt").orderBy(*order)))
    classes = rows.groupBy(*named, "__salt").agg(F.count("*").alias("__n"))
    cells = classes.groupBy(*named).agg(F.sum("__n").alias("__cell")).repartition(shards, *named).withColumn("curve", hilbert_index(F.array(*named), len(dims), bits))
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("__before", F.sum("__cell").over(along) - F.col("__cell"))
    cells = cells.withColumn("__total", F.sum("__cell").over(Window.partitionBy(F.lit(0))))
    inside = Window.partitionBy(*named).orderBy("__salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = classes.join(cells, named).withColumn("__start", F.col("__before") + F.sum("__n").over(inside) - F.col("__n"))
    placed = placed.join(starts.select(*named, "__salt", "curve", "__start", "__total"), [*named, "__salt"])
    place = F.col("__start") + F.col("__in") - 1
    shard = F.expr(f"((__start + __in - 1) * {shards}) div __total")
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", place - first)
    return out.select(*df.columns, "curve", "shard", "slot")


def zone_map(sharded: DataFrame, dims: Sequence[str], shard: str = "shard") -> DataFrame:
    """Rows and smallest and largest value of each dimension by shard: what a reader needs to skip whole files."""
    return sharded.groupBy(shard).agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder for each shard, its rows in slot order."""
    sharded.repartition(shard).sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard ``documents`` along source, language and length, within a cell of these by hash class and id.

    The length is the UTF-8 size of the text plus 16; a null text has size 16 and checksum 0. Law ``rows``: the counts
    of two shards differ by one at most. A group of equal texts of one source and language is in one cell of the curve, so in
    neighbouring shards; copies under other sources lie with these, for a file's smallest and largest source to stay near one another.

    Returns ``(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve)``.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = curve_shards(rows, ["source", "lang", "size"], shards, ties=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
