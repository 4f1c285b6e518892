"""How document filters overlap and depend on their order, from one pass of a byte transducer over the texts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_A, _B, _C, _D, _E = (1 << i for i in range(5))
#: Texts are read in slices of about this many bytes.
_SLICE = 4 << 20

#: Classes of bytes: bits of a word, a capital, the first byte of a code point, a symbol.
_WORD, _CAPITAL, _POINT, _SYMBOL = 1, 2, 4, 8


def _class(b: int) -> int:
    found = 0 if b == 32 or 9 <= b <= 13 else _WORD
    found |= _CAPITAL if 65 <= b <= 90 else 0
    found |= 0 if 0x80 <= b < 0xC0 else _POINT
    return found | (_SYMBOL if chr(b) in "#$%&*|" else 0)


CLASSES = np.array([_class(b) for b in range(256)], np.uint8)
#: What the transducer tells at a byte, by its state (was the byte before in a word) and the byte's class: a word starts
#: here (1), a word ended before here (2).
TOLD = np.array([[(1 if c & _WORD and not inside else 0) | (2 if inside and not c & _WORD else 0) for c in range(16)] for inside in (0, 1)], np.uint8)


class WordTable:
    """A hash table of word spans, open addressing, filled many words at a time.

    A word's key is its owner (document) with a 64-bit hash of its bytes. It goes to the first slot, from its hash on, that is free or holds
    an equal word; equal means the same owner and the same bytes, compared, so different words of one hash stay apart.
    """

    def __init__(self, raw: np.ndarray):
        """``raw``: bytes followed by at least eight more."""
        self.raw = raw
        self.eights = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        self.masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

    def _part(self, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """Bytes ``8 * k`` to ``8 * k + 7`` of the words, zero beyond their end."""
        return self.eights[starts + 8 * k] & self.masks[np.minimum(sizes - 8 * k, 8)]

    def _hashes(self, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray) -> np.ndarray:
        key = owners.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + sizes.astype(np.uint64)
        for k in range(8):
            left = np.flatnonzero(sizes > 8 * k)
            if not len(left):
                break
            key[left] = (key[left] ^ self._part(starts[left], sizes[left], k)) * np.uint64(0x9E3779B97F4A7C15)
            key[left] ^= key[left] >> np.uint64(32)
        for i in np.flatnonzero(sizes > 64).tolist():
            told = hashlib.blake2b(self.raw[starts[i] : starts[i] + sizes[i]].data, digest_size=8).digest()
            key[i] ^= np.uint64(int.from_bytes(told, "little"))
        return key

    def _same(self, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (sizes[a] == sizes[b]) & (owners[a] == owners[b])
        for k in range(8):
            left = np.flatnonzero(same & (sizes[a] > 8 * k))
            if not len(left):
                break
            size = sizes[a[left]]
            same[left] = self._part(starts[a[left]], size, k) == self._part(starts[b[left]], size, k)
        for i in np.flatnonzero(same & (sizes[a] > 64)).tolist():
            at, other, n = starts[a[i]], starts[b[i]], sizes[a[i]]
            same[i] = at == other or bool(np.array_equal(self.raw[at : at + n], self.raw[other : other + n]))
        return same

    def distinct(self, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, n_owners: int) -> np.ndarray:
        """How many different words each owner has."""
        sizes = ends - starts
        mask = (1 << max(4, (2 * len(starts)).bit_length())) - 1
        slots = (self._hashes(starts, sizes, owners) & np.uint64(mask)).astype(np.int64)
        table, left = np.full(mask + 1, -1, np.int64), np.arange(len(starts))
        while len(left):
            at = slots[left]
            free = table[at] < 0
            table[at[free]] = left[free]  # of several for one slot the last stays, the others compare with it
            other = ~self._same(starts, sizes, owners, left, table[at])
            left = left[other]
            slots[left] = (slots[left] + 1) & mask
        return np.bincount(owners[table[table >= 0]], minlength=n_owners)


def measured(texts: list[bytes]) -> np.ndarray:
    """For each text words, different words, capitals, code points and symbols, a row each."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)  # a space after each text
    classes = CLASSES[raw]
    inside = np.concatenate((np.zeros(1, np.uint8), classes[:-1] & _WORD))
    told = TOLD[inside, classes]
    starts, stops = np.flatnonzero(told & 1), np.flatnonzero(told & 2)
    owners = np.searchsorted(ends, starts, side="right")
    firsts = np.concatenate(([0], ends[:-1]))
    count = lambda bit: np.add.reduceat(classes & bit != 0, firsts, dtype=np.int64)
    words = np.bincount(owners, minlength=len(texts))
    # the last text's sum runs over the padding, and each text's over the space behind it
    points = count(_POINT) - 1
    points[-1] -= 8
    return np.stack([words, WordTable(raw).distinct(starts, stops, owners, len(texts)), count(_CAPITAL), points, count(_SYMBOL)], 1)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, part, print, failed)``: the language ("" for null), the text's SHA-256 (that of the empty text for null)
    and the filters A to D that it fails, as bits 1, 2, 4 and 8.

    A: under 200 words; B: fewer different words than half the words; C: over 3 capitals (A-Z) in 100 code points; D: a
    symbol of ``#$%&*|``. An empty text fails A alone. A text must fit one task's memory.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            sizes = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(sizes // _SLICE)) + 1).tolist(), whole.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                batch = whole.slice(s, e - s)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                words, different, capitals, points, symbols = measured(texts).T
                failed = _A * (words < 200) + _B * (100 * different < 50 * words) + _C * (100 * capitals > 3 * points) + _D * (symbols > 0)
                prints = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), prints, pa.array(failed, pa.int32())], ["doc_id", "part", "print", "failed"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(scan, f"doc_id {kind}, part string, print binary, failed int")


def _by_failures(rows: DataFrame, labels: DataFrame, doc_id: str, quality: str, toxic: str) -> DataFrame:
    """``(part, failed, n, good, toxic)``: documents by language and failed filters, E (bit 16) among them.

    Texts are compared by their SHA-256. Documents of one text are summed by language and label before they meet, so a
    text that a third of all documents share sends a few rows a task.
    """
    marks = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max((F.col(quality) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    keys = ["part", "print", "failed", "good", "toxic"]
    known = marked.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))  # one row for an id that is repeated
    summed = known.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    smallest = F.min("first").over(Window.partitionBy("print"))
    spared = F.col("n_null") + F.when(F.col("first") == smallest, F.col("n_first")).otherwise(0)
    split = summed.withColumn("spared", spared).select("part", "good", "toxic", F.explode(F.array(F.struct("failed", F.col("spared").alias("n")), F.struct((F.col("failed") + _E).alias("failed"), (F.col("n") - F.col("spared")).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.failed").alias("failed")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def interaction_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """What each of the filters A to E removes, in every order of the five, by language.

    A to D are those of ``failures``; E fails a document whose text that of a smaller id equals, removed or not. Rows
    without an id neither fail E nor make others fail it; of an id's rows with one text none is a copy of the other. A
    document is good or toxic if any of its labels is 1; without labels it is neither. Languages that are null or empty
    are one part. An empty table gives an empty result. Only ids, languages, digests and bits are shuffled, and all
    orders are read from the 32 sums of each part.

    Returns for each part, order and step ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley)``.
    """
    sums = _by_failures(failures(docs, doc_id, text, lang), labels, doc_id, quality, toxic)
    cells = sums.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))  # 32 at most
    bits = {c: 1 << i for i, c in enumerate(FILTERS)}
    orders = [{"filter_order": order, "step": k + 1, "own": bits[order[k]], "before": sum(bits[c] for c in order[:k])} for order in map("".join, permutations(FILTERS)) for k in range(5)]
    each = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    steps = cells.select("part", "cells", F.inline(each))
    own, before = F.col("own"), F.col("before")

    def total(of: str, test) -> F.Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda n, x: n + F.when(test(x["failed"]), x[of]).otherwise(0))

    fails = lambda x: x.bitwiseAND(own) != 0
    removed = lambda x: fails(x) & (x.bitwiseAND(before) == 0)
    out = steps.select(
        "part", "filter_order", "step", "own",
        total("n", lambda x: x.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda x: fails(x) & (x.bitwiseAND(before) != 0)).alias("redundant"), total("n", lambda x: x == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
