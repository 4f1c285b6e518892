"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.components import connected_components
from quadrat.llm.store import blocks_for, frees_shuffles, stage, unstage

_BITS = 64
_SEED = 42
_CHUNK = 1 << 16
#: Spreads variants evenly over buckets; odd, so that the product modulo 2**64 loses nothing.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(int(_MIX), -1, 1 << 64))


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text, as an unsigned 64-bit number.

    Words are runs without ASCII white space, A-Z lower-cased; the features are the XXH64 (seed 42) of every run of
    ``width`` words joined by spaces, repeats included, or of the whole sequence where it is shorter. A bit is 1
    where over half of the features have it. Null, empty and blank texts give 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(_BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = [digest(joined[s:e], _SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        octets = np.array(part, ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 4) -> DataFrame:
    """All columns of ``docs`` but the text, with its fingerprint as a (signed) long in ``out``."""
    kept = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints.view(np.int64))], [*kept, out])

    schema = docs.select(*kept, F.lit(0).cast("long").alias(out)).schema
    return docs.select(*kept, text).mapInArrow(run, schema)


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks of at most ``radius`` set bits."""
    one = np.uint64(1) << np.arange(_BITS, dtype=np.uint64)
    masks, last = [np.zeros(1, np.uint64)], np.zeros(1, np.uint64)
    for _ in range(radius):
        wider = (last[:, None] ^ one[None, :]).ravel()
        last = np.unique(wider[np.bitwise_count(wider) > np.bitwise_count(last).max()])
        masks.append(last)
    return np.concatenate(masks)


def ball_links(prints: DataFrame, fp: str = "fp", distance: int = 4, bucket_entries: int = 1 << 21, passes: int = 6, batch: int = 2048) -> DataFrame:
    """Links ``(a, b)`` that join exactly the fingerprints which chains of at most ``distance`` differing bits join.

    Two fingerprints within ``distance`` bits have a point in common that lies within ``distance / 2`` bits of both
    (rounded up, where it is odd). So every distinct fingerprint emits all its variants within that radius, the
    variants are dealt to buckets, and those that fingerprints share are found by sorting a bucket. All fingerprints
    around a shared point are then within ``distance`` (or one bit more, where it is odd) of one another: each is
    verified against the smallest of them, which for an even distance already gives every link of the component;
    within a bucket the links are reduced to one for each fingerprint. No group is ever expanded into its pairs.

    A task packs the variants of ``batch`` fingerprints into one binary row for each bucket: sorted 64-bit points, and
    the 16-bit number of the mask that leads back to the owner. The number of buckets follows the number of fingerprints, so that one bucket
    holds about ``bucket_entries`` points at any size of the table. The buckets are worked off in ``passes`` jobs,
    whose shuffle files go away after each, since the variants are thousands of times as many as the fingerprints.
    """
    if distance % 2:
        raise ValueError("distance must be even: the two halves meet in the middle")
    spark = prints.sparkSession
    few = stage(prints.select(F.col(fp).alias("fp")).where("fp IS NOT NULL").distinct(), "distinct")
    count = few.count()
    distinct = stage(few.repartition(blocks_for(count, 4 * batch), "fp"), "fingerprints")  # a file, and so a task, for each
    unstage(few)
    masks = ball(distance // 2)
    bits = max(0, int(np.ceil(np.log2(max(1, count) * len(masks) / bucket_entries))))
    shift = np.uint64(_BITS - bits)

    def scatter(step: int, steps: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, batch):
                    owners = whole.column(0).slice(at, batch).to_numpy(zero_copy_only=False).view(np.uint64)
                    points = ((owners[:, None] ^ masks[None, :]) * _MIX).ravel()
                    mine = np.flatnonzero((points >> shift) % np.uint64(steps) == step) if bits else np.arange(len(points))
                    points = points[mine]
                    order = np.argsort(points)
                    points, mask = points[order], (mine[order] % len(masks)).astype(np.uint16)
                    bucket = (points >> shift).astype(np.int64) if bits else np.zeros(len(points), np.int64)
                    cuts = np.flatnonzero(np.diff(bucket)) + 1
                    edges = [0, *cuts.tolist(), len(points)] if len(points) else []
                    spans = list(zip(edges, edges[1:], strict=False))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(bucket[s]) for s, _ in spans], pa.int64()),
                            pa.array([points[s:e].tobytes() for s, e in spans], pa.binary()),
                            pa.array([mask[s:e].tobytes() for s, e in spans], pa.binary()),
                        ],
                        ["bucket", "points", "mask"],
                    )

        return run

    def gather(group: pa.Table) -> pa.Table:
        points = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group["points"]])
        mask = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in group["mask"]])
        a, b = _stars(points, (points * _UNMIX) ^ masks[mask], distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    steps = min(passes, 1 << bits)
    found = []
    with frees_shuffles(spark):
        for step in range(steps):
            packed = distinct.mapInArrow(scatter(step, steps), "bucket long, points binary, mask binary")
            found.append(stage(packed.groupBy("bucket").applyInArrow(gather, "a long, b long"), "links"))
    unstage(distinct)
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def _stars(points: np.ndarray, owners: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the owners of equal points: each owner, and the smallest owner that it is tied to here."""
    order = np.argsort(points, kind="stable")
    points, owners = points[order], owners[order]
    new = np.concatenate(([True], points[1:] != points[:-1]))
    run = np.cumsum(new) - 1
    shared = np.bincount(run)[run] > 1
    if not shared.any():
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    owners, run = owners[shared], run[shared]
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    hubs = np.repeat(np.minimum.reduceat(owners, starts), np.diff([*starts, len(owners)]))
    close = (owners != hubs) & (np.bitwise_count(owners ^ hubs) <= distance)
    names, ends = np.unique(np.stack([owners[close], hubs[close]]), return_inverse=True)
    ends = ends.reshape(2, -1)
    root = np.arange(len(names))
    while True:  # names are sorted, so the smallest place is the smallest fingerprint
        low = np.minimum(root[ends[0]], root[ends[1]])
        before = root.copy()
        for end in ends:
            np.minimum.at(root, end, low)
            np.minimum.at(root, before[end], low)
        root = root[root]
        if (root == before).all():
            break
    tied = root != np.arange(len(names))
    return names[tied], names[root[tied]]


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """``(fp, root)``: the smallest fingerprint that each distinct one is linked to, itself included."""
    links = ball_links(prints, "fp", distance)
    roots = connected_components(links)
    unstage(links)
    distinct = prints.select("fp").distinct()
    return distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row for each row of ``docs``: its id, its fingerprint and its class of near duplicates.

    Documents are linked where their fingerprints differ in at most ``distance`` bits; a class is a connected
    component and is named by its smallest id. Equal fingerprints are joined once, before any search, so a group of
    copies costs as much as one document. Null and empty texts have fingerprint zero and are linked like any other.
    A null id stays null and names a class only if the class has no other. Repeated rows are returned as often as
    they come; columns of ``docs`` besides id and text play no part. An empty table gives an empty result.

    Returns ``(<doc_id>, fp long, component_id)``.
    """
    prints = stage(fingerprints(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", "fp", width), "prints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(_classes(prints, distance), "fp")
    names = least.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = least.join(names, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(doc_id), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, distance: int = 4) -> DataFrame:
    """Keep one document of each class of near duplicates: that with the smallest id, ids before null, and of equal ids
    that with the smallest hash of the text. Of rows that agree in id and text one stays. Null, empty and blank texts
    have fingerprint zero and are one class with whatever is linked to it; texts of any length are read whole. Columns
    pass through, whatever their names; an empty table gives an empty result."""
    keyed = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("a"), F.xxhash64(text, doc_id).alias("b"))
    named = docs.select(F.col(doc_id).alias("id"), F.xxhash64(doc_id, text).alias("a"), F.xxhash64(text, doc_id).alias("b"), F.col(text).alias("text"))
    prints = stage(fingerprints(named, "text", "fp", width), "prints")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("a"), F.col("b"))
    least = prints.groupBy("fp").agg(F.min(first).alias("least")).join(_classes(prints, distance), "fp")
    kept = least.groupBy("root").agg(F.min("least").alias("least")).select("least.a", "least.b")
    only = keyed.join(kept, ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    return only.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
