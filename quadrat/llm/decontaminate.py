"""Benchmark passages found in documents by a broadcast hash set of word n-grams, and their removal."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.store import stage, unstage

#: One broadcast holds the windows of at most this many bytes of text; more windows take more passes.
SENT = 16 << 20
#: Texts are read in slices of about this many bytes.
_SLICE = 4 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_GAPS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_UPPER + _GAPS, _LOWER + b" " * len(_GAPS))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


class WindowSet:
    """A hash set of windows, sequences of words, each with the items that hold it.

    Words of any window are numbered from 1, others are 0. A window's hash is a polynomial over its numbers; a table of
    bits tells quickly that a hash is none of the set's, and what passes is looked up by its numbers, so hits are exact.
    """

    def __init__(self, pairs: list[tuple[bytes, int]]):
        """``pairs``: a window's words joined by a space, and the number of an item."""
        self.words: dict[bytes, int] = {}
        self.items: dict[bytes, list[int]] = {}
        for window, item in pairs:
            numbers = np.array([self.words.setdefault(w, len(self.words) + 1) for w in window.split(b" ")], np.int32)
            self.items.setdefault(numbers.tobytes(), []).append(item)
        self.bits = np.uint64(64 - max(10, len(self.items).bit_length() + 5))
        self.seen = {}
        for window in self.items:
            numbers = np.frombuffer(window, np.int32)
            if len(numbers) not in self.seen:
                self.seen[len(numbers)] = np.zeros(1 << (64 - int(self.bits)), bool)
            self.seen[len(numbers)][self._hashes(numbers, len(numbers)) >> self.bits] = True

    @staticmethod
    def _hashes(numbers: np.ndarray, width: int) -> np.ndarray:
        n = len(numbers) - width + 1
        key = np.zeros(n, np.uint64)
        for i in range(width):
            key = (key + numbers[i : i + n].astype(np.uint64)) * _SPREAD
        return key ^ (key >> np.uint64(29))

    def hits(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each text its windows, as first word and number of words, and their items."""
        ends = np.cumsum([len(t) + 1 for t in texts])  # a word that no window has stands between texts
        numbers = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for end, t in zip(ends.tolist(), texts, strict=True):
            numbers[end - 1 - len(t) : end - 1] = np.fromiter(map(self.words.get, t, repeat(0)), np.int32, len(t))
        found = [([], set()) for _ in texts]
        for width, seen in self.seen.items():
            if len(numbers) < width:
                continue
            for at in np.flatnonzero(seen[self._hashes(numbers, width) >> self.bits]).tolist():
                if items := self.items.get(numbers[at : at + width].tobytes()):
                    owner = int(np.searchsorted(ends, at, side="right"))
                    found[owner][0].append((at - (int(ends[owner - 1]) if owner else 0), width))
                    found[owner][1].update(items)
        return found


def _windows(benchmark: DataFrame, width: int, item_id: str, text: str) -> DataFrame:
    """Distinct ``(window, item)``: all runs of ``width`` words; a shorter text is one window."""
    named = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column("text")[i].as_py())
                made = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(made), pa.binary()), pa.repeat(batch.column("item")[i], len(made))], ["window", "item"])

    return named.mapInArrow(cut, T.StructType([T.StructField("window", T.BinaryType()), T.StructField("item", named.schema["item"].dataType)])).distinct()


def _blocks(windows: DataFrame, sent: int) -> tuple[DataFrame, int]:
    """The windows dealt to blocks that hold ``sent`` bytes at most (or one pair), and how many there are."""
    size = F.octet_length("window") + 64
    total, pairs = windows.agg(F.sum(size), F.count("*")).first()
    blocks = max(1, -(-2 * (total or 0) // sent)) if (total or 0) > sent else 1
    while True:
        dealt = windows.withColumn("block", F.pmod(F.xxhash64("window", F.col("item").cast("string")), F.lit(blocks)))
        most = dealt.groupBy("block").agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] or 0
        if most <= sent or blocks >= 16 * pairs:
            return dealt, blocks
        blocks *= 2


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None, sent: int = SENT
) -> DataFrame:
    """Which words of documents lie in windows of benchmark items.

    A window is ``width`` consecutive words of an item, or all words of an item that has fewer. Documents are read once
    where they lie and nothing of them is shuffled. The windows, and not the documents, are sent to the tasks: their size
    is counted first, and where they pass ``sent`` bytes they are dealt to blocks, each of which is one more pass in the
    same chain of tasks.

    Null texts and texts without words have no words and no hits. Rows that repeat an item's id are parts of one item. An
    item without an id marks words but is not counted or named. Repeated documents are judged alike, a row each. An empty
    table of items leaves all documents clean; an empty table of documents gives an empty result. A text must fit
    one task's memory.

    Returns ``(row, text, n_words, hits, items)``: the columns ``carry`` (all, if None) of the document as a struct, its
    text (only with ``carry=None``), the hit words as ``array<struct<start, length>>`` (runs, by start), and the ids of
    items as strings, sorted.
    """
    windows = stage(_windows(benchmark, width, item_id, item_text), "windows")
    dealt, blocks = _blocks(windows, sent)
    out = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(text).alias("text"))
    out = out.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,length:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        pairs = dealt.where(F.col("block") == block).select("window", F.col("item").cast("string").alias("item")).collect()
        names = sorted({p["item"] for p in pairs if p["item"] is not None})
        number = {name: i for i, name in enumerate(names)}
        known = WindowSet([(bytes(p["window"]), number.get(p["item"], -1)) for p in pairs])
        kept = [f for f in out.schema if carry is None or block < blocks - 1 or f.name != "text"]
        out = out.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast((known, names)), [f.name for f in kept]), T.StructType(kept))
    unstage(windows)
    return out


def _scan(sent, kept: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = sent.value
        for whole in batches:
            if not whole.num_rows:
                continue
            sizes = np.cumsum(pc.binary_length(whole.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(sizes // _SLICE)) + 1).tolist(), whole.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                batch = whole.slice(s, e - s)
                texts = [words_of(t) for t in batch.column("text").to_pylist()]
                hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for i, (spans, mine) in enumerate(known.hits(texts)):
                    if spans:
                        hits[i] = _joined([*spans, *((r["start"], r["length"]) for r in hits[i])])
                        items[i] = sorted({*items[i], *(names[k] for k in mine if k >= 0)})
                cols = {"row": batch.column("row"), "text": batch.column("text"), "n_words": pa.array(map(len, texts), pa.int64())}
                cols |= {"hits": pa.array(hits, whole.schema.field("hits").type), "items": pa.array(items, whole.schema.field("items").type)}
                yield pa.RecordBatch.from_arrays([cols[c] for c in kept], kept)

    return scan


def _joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words that do not touch."""
    runs: list[list[int]] = []
    for start, length in sorted(spans):
        if runs and start <= runs[-1][0] + runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], start + length - runs[-1][0])
        else:
            runs.append([start, length])
    return [{"start": s, "length": n} for s, n in runs]


def _without(text: str | None, runs: list[dict[str, int]]) -> str | None:
    """``text`` without its words in ``runs``, each run from its first word's first to its last word's last letter."""
    if not runs:
        return text
    raw = text.encode()
    flat = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    steps = np.diff(np.concatenate(([False], flat, [False])).astype(np.int8))
    starts, ends, kept, at = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), [], 0
    for run in runs:
        kept.append(raw[at : starts[run["start"]]])
        at = ends[run["start"] + run["length"] - 1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents without benchmark passages: all columns of ``docs``, with the hit words cut out of the text
    (``remove="spans"``) or without the documents that have any (``remove="documents"``). Null texts stay null; clean
    texts stay as they are."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove: spans or documents")
    found = contamination(docs, benchmark, width, text, item_id, item_text)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select("row.*")
    without = F.udf(_without, "string", useArrow=True)
    return found.select(F.col("row").withField(f"`{text}`", without("text", "hits")).alias("row")).select("row.*")


def audit(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", sent: int = SENT) -> DataFrame:
    """``(<doc_id>, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs``; the digest is that of
    the items' ids, sorted as strings and joined by commas. See ``contamination`` for the cases."""
    found = contamination(docs, benchmark, width, text, item_id, item_text, [doc_id], sent)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, run: n + run["length"])
    return found.select(
        F.col("row").getField(doc_id).alias(doc_id), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
