"""Removal of long passages that occur more than once, found at difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.store import frees_shuffles, stage, unstage

#: Perfect difference sets: every distance modulo the period is the difference of two members. Fixed values.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (1, 5, 11, 24, 25, 27),
}
_PRIME = (1 << 61) - 1
_LOW = np.uint64(_PRIME)
#: Drawn once, for all runs of a job on all machines; another draw gives the same results but for chance.
_BASE, _KEY = 0x11F6B5C3A9D2E487, b"anchors and windows"
_RAISED = -1  # the place of an entry that stands for others of its task
_DOCS = 2048


class Rolling:
    """Hashes of every run of ``width`` words of a text.

    A word is a keyed 64-bit hash, reduced modulo the prime ``2**61 - 1``; a run is a polynomial over its words modulo
    that prime, at a base drawn once. So two different runs agree with a chance of about ``width / 2**61`` over the
    draw, whatever the texts (and words, two different ones, with 2**-61): modulo a prime there are no inputs that
    collide for every base. A prefix of ``read`` holds the running polynomial; a run is its end less its start."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def read(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8, key=_KEY).digest(), "little") % _PRIME
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def runs(self, numbers: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Horner's rule over all runs at once, a word at a time."""
        key = np.zeros(len(at), np.uint64)
        for i in range(width):
            key = _mod(_times(key, _BASE) + numbers[at + i])
        key ^= key >> np.uint64(29)  # spreads the 61 bits over 64, one to one
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(32))


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` (below 2**63) modulo the prime."""
    x = (x & _LOW) + (x >> np.uint64(61))
    return np.where(x >= _LOW, x - _LOW, x)


def _times(x: np.ndarray, y: int) -> np.ndarray:
    """Products modulo the prime, by halves of 32 and 29 bits that fit 64 bits."""
    high, low = np.uint64(y >> 32), np.uint64(y & 0xFFFFFFFF)
    x1, x0 = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    middle = _mod(x1 * low) + _mod(x0 * high)  # times 2**32
    middle = _mod(middle)
    # 2**64 is 8 modulo the prime; 2**32 * middle is split where it passes bit 61.
    folded = (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _mod(_mod(x1 * high * np.uint64(8)) + _mod(folded) + _mod(x0 * low))


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, unchanged."""
    return (text or "").encode().split()


def _repeats(docs: DataFrame, keys: Callable, width: int, entries: int, bucket_entries: int = 1 << 21) -> DataFrame:
    """Where the keys of documents occur a second time anywhere: ``(doc_id, twin, places binary)``, several rows each.

    ``keys(rolling, row) -> (numbers, places)`` gives a document's words as numbers, and where its keys, runs of
    ``width`` words, start. A task hashes and sorts the keys of some thousand
    documents. Those it holds twice are settled on the spot and it sends one entry for all of them, so a passage that
    a third of all documents share sends one entry a task batch; the others travel with their places. Keys are dealt
    to as many buckets as ``entries`` asks for, and a bucket is sorted as a whole. What it finds goes back as one row
    for each batch that sent to it, and the rows of a batch are put together again, one for each document.
    """
    bits = int(np.ceil(np.log2(max(1, entries / bucket_entries))))
    shift = np.uint64(64 - bits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "batch", "keys", "owner", "place", "ids", "twins"]

    def row(batch, name, bucket, key, owner, place):
        there, owner = np.unique(owner, return_inverse=True)
        picked = pa.array(there)
        return (bucket, name, key.tobytes(), owner.astype(np.uint16).tobytes(), place.astype(np.int32).tobytes(), batch.column("doc_id").take(picked), batch.column("twin").take(picked))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for whole in batches:
            for at in range(0, whole.num_rows, _DOCS):
                batch = whole.slice(at, _DOCS)
                found = [keys(rolling, *(batch.column(c)[i].as_py() for c in batch.schema.names[2:])) for i in range(batch.num_rows)]
                place = np.concatenate([p for _, p in found])
                owner = np.repeat(np.arange(len(found)), [len(p) for _, p in found])
                if not len(place):
                    continue
                firsts = np.cumsum([0, *[len(n) for n, _ in found]])
                key = rolling.runs(np.concatenate([n for n, _ in found]), firsts[owner] + place, width)
                order = np.argsort(key)
                key, place, owner = key[order], place[order], owner[order]
                new = np.concatenate(([True], key[1:] != key[:-1]))
                settled = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
                rows, told = [], repr((batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist())).encode()
                name = int.from_bytes(hashlib.sha256(told).digest()[:8], "big", signed=True)
                if settled.any():
                    rows.append(row(batch, name, -1 - int(key[0] >> np.uint64(2)), key[settled], owner[settled], place[settled]))
                sent, sent_place = new, np.where(settled, _RAISED, place)
                key, owner, place = key[sent], owner[sent], sent_place[sent]
                bucket = (key >> shift).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(key)]
                rows += [row(batch, name, int(bucket[s]), key[s:e], owner[s:e], place[s:e]) for s, e in zip(edges, edges[1:], strict=False)]
                cols = list(zip(*rows, strict=True))
                ids, twins = (pa.ListArray.from_arrays(np.cumsum([0, *map(len, c)]).astype(np.int32), pa.concat_arrays(c)) for c in cols[5:])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:2]), *(pa.array(c, pa.binary()) for c in cols[2:5]), ids, twins], names)

    def gather(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key = [np.frombuffer(k.as_py(), np.uint64) for k in group["keys"]]
        sizes, key = list(map(len, key)), np.concatenate(key)
        place = np.concatenate([np.frombuffer(p.as_py(), np.int32) for p in group["place"]])
        if group["bucket"][0].as_py() < 0:
            hit = np.ones(len(key), bool)
        else:
            order = np.argsort(key)
            ordered = key[order]
            same = np.concatenate(([False], ordered[1:] == ordered[:-1], [False]))
            hit = np.empty(len(key), bool)
            hit[order] = same[1:] | same[:-1]
            hit &= place != _RAISED
        batches, ids, twins, places, sizes_out, at = [], [], [], [], [0], 0
        for n, name, owner, who, twin in zip(sizes, group["batch"], group["owner"], group["ids"], group["twins"], strict=True):
            mine = np.flatnonzero(hit[at : at + n])
            owner, where = np.frombuffer(owner.as_py(), np.uint16)[mine], place[at : at + n][mine]
            at += n
            if not len(mine):
                continue
            order = np.argsort(owner, kind="stable")
            owner, where = owner[order], where[order]
            edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            there = pa.array(owner[edges[:-1]])
            batches.append(name.as_py())
            ids.append(who.values.take(there))
            twins.append(twin.values.take(there))
            places += [where[s:e].tobytes() for s, e in zip(edges, edges[1:], strict=False)]
            sizes_out.append(len(places))
        none = group["ids"].combine_chunks().values.slice(0, 0)
        values = (pa.concat_arrays([*ids, none]), pa.concat_arrays([*twins, pa.array([], pa.int64())]), pa.array(places, pa.binary()))
        lists = [pa.ListArray.from_arrays(np.array(sizes_out, np.int32), v) for v in values]
        return pa.table([pa.array(batches, pa.int64()), *lists], ["batch", "ids", "twins", "places"])

    def regroup(batch: pa.Table) -> pa.Table:
        ids, twins, places = (batch[c].combine_chunks().flatten() for c in ("ids", "twins", "places"))
        first, parts = {}, []
        for i, (key, found) in enumerate(zip(zip(ids.to_pylist(), twins.to_pylist(), strict=True), places.to_pylist(), strict=True)):
            if key not in first:
                first[key] = (len(parts), i)
                parts.append([])
            parts[first[key][0]].append(found)
        kept = pa.array([i for _, i in first.values()], pa.int64())
        return pa.table({"doc_id": ids.take(kept), "twin": twins.take(kept), "places": pa.array([b"".join(p) for p in parts], pa.binary())})

    packed = docs.mapInArrow(scatter, f"bucket long, batch long, keys binary, owner binary, place binary, ids array<{kind}>, twins array<bigint>")
    found = packed.groupBy("bucket").applyInArrow(gather, f"batch long, ids array<{kind}>, twins array<bigint>, places array<binary>")
    return found.groupBy("batch").applyInArrow(regroup, f"doc_id {kind}, twin long, places binary")


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Attach each document's places, gathered to one list; documents without any get null."""
    lists = places.groupBy("doc_id", "twin").agg(F.collect_set("places").alias("places")).withColumnsRenamed({"doc_id": "__d", "twin": "__t"})
    return docs.join(lists, docs["doc_id"].eqNullSafe(F.col("__d")) & (docs["twin"] == F.col("__t")), "left").drop("__d", "__t")


def drop_repeats(docs: DataFrame, window: int = 35, period: int = 21, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word that lies in a run of ``window`` words which also starts anywhere else.

    Words are runs without ASCII white space, unchanged. Wherever two equal runs of ``window`` words lie, some place
    less than ``period`` words into both is a cover place of both (its word number modulo the period is in the
    difference cover). So only runs of ``window - period + 1`` words at cover places are hashed; those that occur
    twice are the anchors. Extending an anchor gives the windows around it; these are hashed whole and those that
    occur twice are removed, so the outcome is that of comparing all windows, but for a chance of about ``window /
    2**61`` for each pair of windows that two different ones have one hash (see ``Rolling``). The input decides, not
    what is left of it.

    Rows that agree in id and text are copies of one another like any two documents with equal texts. A null text has
    no words. Texts shorter than the window are kept. The words of a text must fit one task's memory; lists of places
    never exceed the words of their document. An empty table gives an empty result; other columns play no part.

    Returns ``(<doc_id>, n_words, n_removed, kept_text, kept_sha256)``, a row for each row of ``docs``.
    """
    cover, width = np.array(COVERS[period]), window - period + 1
    if width < 1:
        raise ValueError("the window must be as long as the period at least")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("twin"), F.col(text).alias("text"))
    kind = named.schema["doc_id"].dataType.simpleString()

    def anchors(rolling: Rolling, text: str | None):
        words = words_of(text)
        if len(words) < window:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = (np.arange(0, len(words), period)[:, None] + cover[None, :]).ravel()
        at = at[at <= len(words) - width]
        return rolling.read(words), at

    def windows(rolling: Rolling, text: str | None, places: list[bytes]):
        words = words_of(text)
        at = np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in places])).astype(np.int64)
        starts = np.zeros(len(words) + 2, np.int64)
        np.add.at(starts, np.maximum(0, at - (window - width)), 1)
        np.add.at(starts, np.minimum(at, len(words) - window) + 1, -1)
        at = np.flatnonzero(np.cumsum(starts)[: len(words) - window + 1])
        return rolling.read(words), at

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                words, gone = words_of(text.as_py()), 0
                if places.is_valid:
                    at = np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in places.as_py()]))
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + window, -1)
                    covered = np.cumsum(depth[:-1]) > 0
                    gone = int(covered.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(~covered)])
                else:
                    kept = b" ".join(words)
                out.append((len(words), gone, kept.decode(), hashlib.sha256(kept).hexdigest()))
            cols = zip(*out, strict=True) if out else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    with frees_shuffles(docs.sparkSession):
        n_words = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        entries = max(1, int(n_words / 5 * len(cover) / period))  # about: only the number of buckets depends on it
        found = stage(_repeats(named, anchors, width, entries), "anchors")
        near = _with_places(named, found).where("places IS NOT NULL")
        again = stage(_repeats(near.select("doc_id", "twin", "text", "places"), windows, window, entries), "windows")
        unstage(found)
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return _with_places(named, again).mapInArrow(remove, schema).withColumnRenamed("doc_id", doc_id)
