"""Phrases whose words keep together, grown best first from prefix counts."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.store import stage, unstage

#: At most this many prefixes are sent to the tasks in one round, and words of the vocabulary; the others wait for the next.
FRONTIER = 1 << 18
#: Words of at most this many places are held by a task at once.
_PLACES = 1 << 21
#: Texts are read in slices of about this many bytes.
_SLICE = 4 << 20
#: Frequent words are numbered in so many parts at once.
_PARTS = 1024
_STOPS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _STOPS + b"\t", bytes(range(97, 123)) + b"." * len(_STOPS) + b" ")


def _encoded(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, words, counts, codes)``: the texts of a task and language as numbers of its own list of words, 4 bytes each;
    0 stands between pieces, word i of the list is i + 1."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")

    def write(held: dict) -> pa.RecordBatch:
        langs, words, counts, codes = [], [], [], []
        for name, (known, parts) in held.items():
            code = np.concatenate(parts)
            langs.append(name)
            words.append([w.decode() for w in list(known)[1:]])
            counts.append(np.bincount(code, minlength=len(known))[1:])
            codes.append(code.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), pa.array(codes, pa.binary())], ["lang", "words", "counts", "codes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = {}, 0
        for whole in batches:
            if not whole.num_rows:
                continue
            sizes = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = [0, *(np.flatnonzero(np.diff(sizes // _SLICE)) + 1).tolist(), whole.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                batch, texts = whole.slice(s, e - s), defaultdict(list)
                for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    texts[name].append(t)
                for name, mine in texts.items():
                    if name not in held:
                        held[name] = (defaultdict(count().__next__), [])
                        held[name][0][b"."]
                    known, parts = held[name]
                    words = b".".join([*mine, b""]).translate(_FOLD).replace(b".", b" . ").split()
                    parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    places += len(words)
                if places > _PLACES:
                    yield write(held)
                    held, places = {}, 0
        if held:
            yield write(held)

    return named.mapInArrow(scan, "lang string, words array<string>, counts array<bigint>, codes binary")


def _recoded(code: np.ndarray, ids: np.ndarray) -> bytes:
    """``code`` in other numbers; 0 several times together is one, and so is a word between two of them, which is in no phrase."""
    out = ids[code]
    around = np.concatenate(([0], out, [0])).astype(np.int32)
    out = np.where((around[:-2] > 0) | (around[2:] > 0), out, 0)
    return out[(out > 0) | np.concatenate(([True], out[:-1] > 0))].tobytes()


def _numbered(encoded: DataFrame, units: DataFrame, sent: int) -> DataFrame:
    """``(lang, codes)``: the same texts in the numbers of ``units``; other words and the ends of pieces are 0.

    Up to ``sent`` words of ``units`` are sent to the tasks; of more, each row gets those of its own words by a join."""

    def out(batch: pa.RecordBatch, i: int, ids: np.ndarray) -> pa.RecordBatch:
        code = np.frombuffer(batch.column("codes")[i].as_py(), np.int32)
        return pa.RecordBatch.from_arrays([batch.column("lang").slice(i, 1), pa.array([_recoded(code, ids)], pa.binary())], ["lang", "codes"])

    if units.limit(sent + 1).count() <= sent:
        book = defaultdict(dict)
        for lang, word, number in zip(*units.select("lang", "phrase", "id").toArrow().to_pydict().values(), strict=True):
            book[lang][word] = number
        known = encoded.sparkSession.sparkContext.broadcast(dict(book))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    mine = known.value.get(batch.column("lang")[i].as_py(), {})
                    yield out(batch, i, np.array([0, *(mine.get(w, 0) for w in batch.column("words")[i].as_py())], np.int32))

        return encoded.select("lang", "words", "codes").mapInArrow(scan, "lang string, codes binary")

    entries = encoded.select("row", "lang", F.posexplode("words").alias("place", "phrase")).join(units.select("lang", "phrase", "id"), ["lang", "phrase"])
    lists = entries.groupBy("row").agg(F.collect_list(F.struct("place", "id")).alias("known")).withColumnsRenamed({"row": "__row"})

    def scan_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known, ids = batch.column("known")[i].values, np.zeros(batch.column("n")[i].as_py() + 1, np.int32)
                ids[known.field("place").to_numpy() + 1] = known.field("id").to_numpy()
                yield out(batch, i, ids)

    return encoded.join(lists, F.col("row") == F.col("__row")).select("lang", "codes", F.size("words").alias("n"), "known").mapInArrow(scan_joined, "lang string, codes binary")


class Trie:
    """The prefixes of one language that a round grows, with what leads to them. Words are numbered from 1; on each level
    a node is a place in the sorted keys of that level, a key being the node above times the number of words plus the word."""

    def __init__(self, phrases: list[tuple[int, list[int]]], whole: bool):
        """``phrases``: number and words, by their ids. ``whole``: all frequent phrases as long as the longest here are here."""
        self.whole, self.words = whole, np.array(sorted({w for _, words in phrases for w in words}), np.int32)
        place = {w: i + 1 for i, w in enumerate(self.words.tolist())}
        coded = [(node, [place[w] for w in words]) for node, words in phrases]
        self.width, self.levels = len(self.words) + 1, []
        above = {(): 0}
        for m in range(1, max(len(w) for _, w in coded) + 1):
            keys = {tuple(w[:m]): above[tuple(w[: m - 1])] * self.width + w[m - 1] for _, w in coded if len(w) >= m}
            order = np.array(sorted(set(keys.values())), np.int64)
            above = {p: int(np.searchsorted(order, key)) for p, key in keys.items()}
            grown = np.full(len(order), -1, np.int32)
            for node, w in coded:
                if len(w) == m:
                    grown[above[tuple(w)]] = node
            self.levels.append((order, grown))

    def walk(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the node that the words from each place on lead to (-1: none), and its number if it is to grow."""
        numbers = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1).astype(np.int32)
        numbers = np.where(self.words[numbers] == codes, numbers + 1, 0)
        at = np.where(numbers > 0, 0, -1).astype(np.int32)
        for m, (order, grown) in enumerate(self.levels, 1):
            nodes = np.full(len(numbers), -1, np.int32)
            live = np.flatnonzero((at[: len(numbers) - m + 1] >= 0) & (numbers[m - 1 :] > 0))
            key = at[live].astype(np.int64) * self.width + numbers[m - 1 :][live]
            found = np.minimum(np.searchsorted(order, key), len(order) - 1)
            hit = order[found] == key
            nodes[live[hit]] = found[hit]
            yield m, nodes, np.where(nodes >= 0, grown[nodes], np.int32(-1))
            at = nodes


def _grown(coded: DataFrame, tries: dict[str, Trie]) -> DataFrame:
    """``(node, word, n, left)`` of each task: how often each node is followed by each word. With ``word`` 0: the word that stands before
    all of a node's places (0 if there are several or none)."""
    sent = coded.sparkSession.sparkContext.broadcast(tries)

    def count_row(codes: np.ndarray, trie: Trie) -> Iterator[pa.RecordBatch]:
        around = np.concatenate((codes, np.zeros(6, np.int32)))  # so that the last place has none after it, and the first none before
        for m, nodes, grown in trie.walk(codes):
            at = np.flatnonzero(grown >= 0)
            if m > 1 and len(at):
                node = grown[at]
                order = np.argsort(node, kind="stable")
                node, before = node[order], around[at[order] - 1]
                firsts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                least = np.minimum.reduceat(before, firsts)
                left = np.where(least == np.maximum.reduceat(before, firsts), least, 0)
                yield row(node[firsts], np.zeros(len(firsts), np.int32), np.zeros(len(firsts), np.int32), left)
            at = at[around[at + m] > 0]
            if trie.whole and m > 1:
                at = at[nodes[np.minimum(at + 1, len(nodes) - 1)] >= 0]  # a frequent phrase has a frequent end
            if len(at):
                key, n = np.unique(grown[at].astype(np.int64) << 32 | around[at + m], return_counts=True)
                yield row((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32), np.zeros(len(key), np.int32))

    def row(*cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], ["node", "word", "n", "left"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if trie := sent.value.get(batch.column("lang")[i].as_py()):
                    yield from count_row(np.frombuffer(batch.column("codes")[i].as_py(), np.int32), trie)

    return coded.mapInArrow(scan, "node int, word int, n int, left int")


def _floor(a: Column, left: Column, right: Column, n: Column) -> Column:
    """``floor(1000 * a * n / (left * right))``, exact to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    above = (wide(a) * 1000).cast("decimal(20,0)") * wide(n)
    return F.call_function("div", above, wide(left) * wide(right))


def _scored(fresh: DataFrame, counted: DataFrame) -> DataFrame:
    """The lowest cut of each phrase. Where the count of an end is not known it is taken as the phrase's, the least that it
    can be, so the score is a bound; ``exact`` is false then."""
    words = F.split("phrase", " ")
    cut = fresh.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.withColumns({"end": F.array_join(F.slice(words, F.col("k") + 1, F.col("m")), " "), "l": F.element_at("prefixes", F.col("k"))})
    ends = counted.select("lang", F.col("phrase").alias("end"), F.col("a").alias("r"))
    known = cut.join(ends, ["lang", "end"], "left")
    r = F.coalesce("r", "a")
    lowest = F.min(F.struct(_floor(F.col("a"), F.col("l"), r, F.col("n")).alias("score"), "k", "l", r.alias("r"))).alias("low")
    same = ["lang", "phrase", "m", "a", "n", "prefixes"]
    found = known.groupBy(*same).agg(lowest, F.every(F.col("r").isNotNull()).alias("exact"))
    return found.select(*same, "exact", "low.score", "low.l", "low.r")


def _first(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _picked(state: DataFrame, best: DataFrame | None, pending: DataFrame | None, top: int, longest: int, frontier: int) -> DataFrame:
    """The ``frontier`` best prefixes to grow, with the number of those of their language that wait; first those that the ends of
    pending phrases wait for."""
    waiting = state.where((F.col("m") < longest) & ~F.col("grown")).drop("grown")
    bound = _floor(F.lit(1), F.col("prefixes")[0], F.lit(1), F.col("n"))
    picked = waiting.withColumns({"bound": bound, "wanted": F.lit(False)})
    if best is not None:
        bars = best.where(F.col("rank") == top).select("lang", F.col("score").alias("bar"))
        picked = picked.join(bars, "lang", "left").where("bar IS NULL OR bound >= bar").drop("bar")
    if pending is not None:
        split = F.split("phrase", " ")
        ends = pending.join(bars, "lang", "left").where("bar IS NULL OR score >= bar").select("lang", F.explode(F.transform(F.sequence(F.lit(2), F.col("m")), lambda k: F.slice(split, k, F.col("m")))).alias("end"))
        starts = ends.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("end")), lambda k: F.array_join(F.slice("end", 1, k), " "))).alias("phrase")).distinct()
        picked = picked.unionByName(waiting.join(starts, ["lang", "phrase"], "left_semi").withColumns({"bound": bound, "wanted": F.lit(True)}))
        picked = picked.groupBy("lang", "phrase", "m", "a", "n", "prefixes", "ids", "bound").agg(F.max("wanted").alias("wanted"))
    held = waiting.groupBy("lang").agg(F.count("*").alias("waiting"))
    return picked.orderBy(F.desc("wanted"), F.desc("bound"), "lang", "phrase").limit(frontier).join(held, "lang").select("lang", "phrase", "m", "a", "n", "prefixes", "ids", "waiting")


def collocations(docs: DataFrame, top: int = 2000, min_count: int = 100, longest: int = 5, text: str = "text", lang: str = "lang", frontier: int = FRONTIER) -> DataFrame:
    """The best ``top`` phrases of 2 to ``longest`` words in each language.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs.
    A phrase is a candidate if it occurs ``min_count`` times within pieces. Cut after k words, into parts that occur l and r
    times, it scores ``floor(1000 * a * n / (l * r))``, n being the words of the language; its lowest cut counts. A candidate
    that lies in a longer candidate which occurs as often is dropped. As counts only fall with length, one word more decides
    that: a phrase is dropped if the same word stands before all its occurrences, or after them.

    The search is best first. Growing a prefix cannot score over ``1000 * n / f(first word)``, as its end occurs at least as
    often as the whole. A round grows the ``frontier`` best prefixes: they are sent to the tasks, which read the coded
    corpus once and count what follows them and whether one word stands before them; more prefixes wait for the next round. A phrase
    is settled once it has been grown and the counts of its ends are known. Where an end starts with a word that is not worth growing, it
    is grown too if the phrase may be among the first. The search ends when no prefix of a language has a bound of at least
    the score of its last kept phrase, so ties are settled. Counts are of all texts. What is sent to a task is bounded by
    ``frontier``; nothing is told apart by hashes.

    Null and empty texts have no words; a null language is ``und``. Repeated documents count as often as they are there.
    Other columns play no part. An empty table gives an empty result. A text must fit one task's memory.

    Returns ``(lang, rank, phrase, a, l, r, n, score)``.
    """
    encoded = stage(_encoded(docs, lang, text).withColumn("row", F.monotonically_increasing_id()), "encoded")
    sizes = encoded.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    words = encoded.select("lang", F.inline(F.arrays_zip("words", "counts"))).groupBy("lang", "words").agg(F.sum("counts").alias("a")).where(F.col("a") >= min_count)
    part = F.pmod(F.xxhash64("lang", "words"), F.lit(_PARTS)).cast("int")
    number = F.row_number().over(Window.partitionBy("part").orderBy("lang", "words")) * _PARTS + F.col("part")
    units = words.join(sizes, "lang").withColumn("part", part).withColumn("id", number.cast("int"))
    units = stage(units.select("lang", F.col("words").alias("phrase"), F.lit(1).alias("m"), "a", "n", F.array("a").alias("prefixes"), F.array("id").alias("ids"), "id"), "units")
    coded = stage(_numbered(encoded, units, frontier), "coded")
    unstage(encoded)
    state = stage(units.drop("id").withColumn("grown", F.lit(False)), "state")  # all phrases whose count is known
    best, pending, whole = None, None, defaultdict(lambda: True)
    while True:
        chosen = stage(_picked(state, best, pending, top, longest, frontier), "chosen")
        table = chosen.toArrow()
        if not table.num_rows:
            break
        nodes = stage(docs.sparkSession.createDataFrame(table.append_column("node", pa.array(np.arange(table.num_rows), pa.int32()))), "nodes")
        unstage(chosen)
        phrases, langs = defaultdict(list), table["lang"].to_pylist()
        for node, (name, ids) in enumerate(zip(langs, table["ids"].to_pylist(), strict=True)):
            phrases[name].append((node, ids))
        here = Counter(langs)
        for name, there in zip(langs, table["waiting"].to_pylist(), strict=True):
            whole[name] = whole[name] and here[name] == there
        for name in set(whole) - set(here):
            whole[name] = False
        found = _grown(coded, {name: Trie(mine, whole[name]) for name, mine in phrases.items()}).groupBy("node", "word")
        found = stage(found.agg(F.sum("n").alias("times"), F.min("left").alias("least"), F.max("left").alias("most")).where((F.col("times") >= min_count) | (F.col("word") == 0)), "found")
        del table, phrases, langs
        children = found.where("word > 0").select("node", "word", "times").join(units.select(F.col("id").alias("word"), F.col("phrase").alias("last")), "word")
        fresh = stage(children.join(nodes, "node").select(
            "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), (F.col("m") + 1).alias("m"), F.col("times").alias("a"), "n",
            F.concat("prefixes", F.array("times")).alias("prefixes"), F.concat("ids", F.array("word")).alias("ids"), F.lit(False).alias("grown"),
        ), "fresh")
        around = found.groupBy("node").agg(F.max(F.when(F.col("word") > 0, F.col("times"))).alias("longer"), F.max(F.when((F.col("word") == 0) & (F.col("least") == F.col("most")), F.col("most"))).alias("before"))
        alone = F.coalesce(F.col("longer") == F.col("a"), F.lit(False)) | F.coalesce(F.col("before") > 0, F.lit(False))
        settled = nodes.where("m > 1").join(around, "node", "left").where(~alone).select("lang", "phrase", "m", "a", "n", "prefixes")
        settled = settled.unionByName(fresh.where(F.col("m") == longest).select(settled.columns))
        if pending is not None:
            settled = settled.unionByName(pending.select(settled.columns))
        marked = state.join(nodes.select("lang", "phrase", F.lit(True).alias("now")), ["lang", "phrase"], "left").withColumn("grown", F.col("grown") | F.coalesce("now", F.lit(False))).drop("now")
        following = stage(marked.unionByName(fresh), "state")
        scored = stage(_scored(settled, following), "scored")
        for t in (found, nodes, state, fresh):
            unstage(t)
        state = following
        exact = scored.where("exact").select("lang", "phrase", "a", "l", "r", "n", "score")
        newest = stage(_first(exact if best is None else exact.unionByName(best.drop("rank")), top), "best")
        if best is not None:
            unstage(best)
        best, pending = newest, scored.where("NOT exact")
        pending = pending if pending.limit(1).count() else None
    for t in (chosen, coded, state):
        unstage(t)
    if best is None:
        return units.select("lang", F.lit(1).cast("long").alias("rank"), "phrase", "a", F.col("a").alias("l"), F.col("a").alias("r"), "n", F.col("a").alias("score")).where("false")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
