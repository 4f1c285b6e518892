"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, with a softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose words are split and hashed together; a longer text is taken alone, whole.
_SLICE = 1 << 22
#: Bytes of different words whose n-grams are held at once.
_GRAMS = 1 << 20


@dataclass(frozen=True)
class Shape:
    """What is hashed: whole words, their character n-grams with edge marks, and, all as one feature, word pairs whose
    second word repeats the first. Every occurrence counts once; what it says of a class is learned."""

    buckets: int = 1 << 18
    grams: tuple[int, ...] = (3, 4)

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(owners, buckets)``: the places in ``words`` of all features, and their buckets."""
        owners = [np.arange(len(words), dtype=np.int32)]
        found = [np.fromiter((crc32(b"<" + w + b">") for w in words), np.uint32, len(words))]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        letters = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)[: sizes.sum()]
        word = np.repeat(owners[0], sizes)
        left = np.cumsum(sizes)[word] - np.arange(len(letters))
        for n in self.grams:
            starts = np.flatnonzero(left >= n)
            h = np.full(len(starts), 0x811C9DC5 ^ n, np.uint32)  # FNV-1a, of all n-grams at once
            for i in range(n):
                h = (h ^ letters[starts + i]) * np.uint32(0x01000193)
            owners.append(word[starts])
            found.append(h ^ (h >> np.uint32(15)))
        return np.concatenate(owners), np.concatenate(found) & np.uint32(self.buckets - 1)

    @property
    def repeat(self) -> int:
        """The bucket of the word pair whose second word equals the first."""
        return crc32(b"= =") & (self.buckets - 1)


def split(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(words, places, owners)``: the different words of some texts and, for every word of every text in order, its
    place in ``words`` and the number of its text. Words are runs without ASCII white space; null texts have none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, owners = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), owners.filter(some).to_numpy()


def features(text: str | None, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its features that fall in each. A text without words has none."""
    words, places, _ = split(pa.array([text], pa.large_string()))
    owners, buckets = shape.of_words(words)
    times = np.bincount(places, minlength=len(words)).astype(np.float64)
    repeats = float(np.count_nonzero(places[1:] == places[:-1]))
    ids, at = np.unique(np.append(buckets, np.uint32(shape.repeat)), return_inverse=True)
    counts = np.bincount(at, np.append(times[owners], repeats), len(ids))
    ids, counts = ids[counts > 0], counts[counts > 0]
    return ids, (counts / max(1.0, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the logit of each class, and the bias: the trained vectors times the softmax layer."""

    shape: Shape
    table: np.ndarray
    bias: np.ndarray

    def _of_words(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its features' rows, and their number."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
        parts = np.split(np.arange(len(words)), np.flatnonzero(np.diff(ends // _GRAMS)) + 1)
        out = [np.empty((0, self.table.shape[1] + 1))]
        for part in (p for p in parts if len(p)):
            owners, buckets = self.shape.of_words(words[part[0] : part[-1] + 1])
            columns = [np.bincount(owners, self.table[buckets, c], len(part)) for c in range(self.table.shape[1])]
            out.append(np.stack([*columns, np.bincount(owners, minlength=len(part))], 1))
        return np.concatenate(out)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probabilities of the classes, a row for each text. What a text gets does not depend on the others."""
        sizes = pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
        group = np.cumsum(sizes) // _SLICE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        return np.concatenate([np.empty((0, len(self.bias))), *(self._score(texts.slice(s, e - s)) for s, e in zip(cuts, cuts[1:], strict=False) if e > s)])

    def _score(self, texts: pa.Array) -> np.ndarray:
        words, places, owners = split(texts)
        sums = self._of_words(words)
        again = owners[1:][(places[1:] == places[:-1]) & (owners[1:] == owners[:-1])]
        pair = np.append(self.table[self.shape.repeat], 1.0)
        total = np.stack([np.bincount(owners, column[places], len(texts)) for column in sums.T], 1).astype(np.float64)
        total += np.bincount(again, minlength=len(texts))[:, None] * pair
        logits = total[:, :-1] / np.maximum(1.0, total[:, -1:]) + self.bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)


def train(sample: list[tuple[np.ndarray, np.ndarray, int]], classes: int, shape: Shape, dim: int = 8, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over single documents, the rate falling to zero. Deterministic under a seed."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (shape.buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
    steps, step = max(1, epochs * len(sample)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(sample)):
            ids, share, label = sample[i]
            pace = rate * (1 - step / steps)
            step += 1
            rows = vectors[ids]
            mean = share @ rows
            logits = mean @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            # Steps are scaled so that none moves a document's own logits by more than about twice its error.
            pull = layer @ error / max(1.0, float((layer * layer).sum()))
            layer -= pace * 0.25 / max(1.0, float(mean @ mean)) * np.outer(mean, error)
            bias -= pace * 0.02 * error
            vectors[ids] = rows - pace / float(share @ share) * np.outer(share, pull)
    return Model(shape, vectors @ layer, bias)


def fit(docs: DataFrame, labels: DataFrame, classes: int, sample: int = 4000, shape: Shape | None = None, calibrate: bool = False, **how) -> Model:
    """Train on at most ``sample`` labelled documents, taken in hash order of their ids.

    ``labels`` has ``(doc_id, label)`` with labels 0 to ``classes - 1``; rows with a null in either are ignored, and of
    repeated ids the smallest label counts, and of documents with one id that with the smallest hash of the text. The sample is a stated bound: its features, and nothing else, reach the
    driver. With ``calibrate`` a fifth of the sample is set aside, and the logits are scaled so that it is as probable
    as can be: averages of many features are surer than the softmax that they were trained with says. Without any labelled document the model gives every class the same probability.
    """
    shape = shape or Shape()
    named = labels.select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("__label")).where("__id IS NOT NULL AND __label IS NOT NULL")
    chosen = named.groupBy("__id").agg(F.min("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("__label").alias("__label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), shape) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(2), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())],
                ["id", "label", "ids", "share"],
            )

    got = rows.mapInArrow(run, "id string, label int, ids binary, share binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["ids"]))
    sampled = [(np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["share"], np.float32), r["label"]) for r in got]
    if not calibrate or len(sampled) < 50:
        return train(sampled, classes, shape, **how)
    model = train([s for i, s in enumerate(sampled) if i % 5], classes, shape, **how)
    logits = np.array([share @ model.table[ids] + model.bias for ids, share, _ in sampled[::5]], np.float64)
    truth = np.array([label for *_, label in sampled[::5]])

    def surprise(scale: float) -> float:
        odds = logits * scale
        top = odds.max(1)
        return float(np.mean(top + np.log(np.exp(odds - top[:, None]).sum(1)) - odds[np.arange(len(truth)), truth]))

    scale = min((0.5 * 2 ** (i / 2) for i in range(11)), key=surprise)
    return Model(shape, model.table * np.float32(scale), model.bias * np.float32(scale))


def probabilities(docs: DataFrame, model: Model, text: str = "text", out: str = "probabilities") -> DataFrame:
    """All columns of ``docs`` and an array with the probability of each class, from the whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # of fixed size
    shape = model.shape
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_model = Model(shape, *held.value)
        for batch in batches:
            odds = held_model.score(batch.column(text))
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(odds) + 1) * odds.shape[1], pa.int32()), pa.array(odds.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.array().cast("array<double>")).schema)
