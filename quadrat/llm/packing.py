"""Packing token sequences into windows: minimum bin slack by bitset subset sums."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.store import blocks_for, stage

END_OF_DOCUMENT = 1
_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, deal long"


#: White space beyond which the fast reader is not asked: its pattern engine runs out of stack at some 10**5 of it.
_WIDE = re.compile(r"\s{1000}")


def byte_bpe(name: str = "byte_bpe_50k", folder: str | None = None):
    """``encode(text) -> ids`` for a public byte-level BPE vocabulary, by default read from where the machine that runs
    the task has it installed; ``folder`` names another place.

    The ids are those that ``tokenizers`` gives with ``<name>.json``. They are read by ``tiktoken`` from the ranks of
    the same vocabulary, which takes a quarter of the time, except for texts with a thousand white-space characters in
    a row, which ``tokenizers`` reads itself. A test compares the two on texts of a million characters of every class.
    As in ``tokenizers``, the text of the special token stands for its id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    find = (lambda file: f"{folder}/{file}") if folder else public_tokenizers.path
    special = "<|endoftext|>"
    with open(find(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
    exact = Tokenizer.from_file(find(f"{name}.json"))

    def encode(text: str) -> list[int]:
        if _WIDE.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all") if special in text else fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, window: int = 2048, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Tokenise whole texts and cut each into full windows and one remainder.

    Null texts count as empty; every document ends with id 1; texts are read whole, however long. ``deal`` spreads the pieces over groups, also those of
    rows that are equal. Returns ``(doc_id, start, length, ids_crc32, doc_tokens, deal)``.
    """
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = byte_bpe(vocabulary, folder), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out = whole.slice(at, 512), []
                for i, body in enumerate(batch.column(1)):
                    ids = np.array([*encode(body.as_py() or ""), END_OF_DOCUMENT], "<u4")
                    row += 1
                    for start in range(0, len(ids), window):
                        part = ids[start : start + window]
                        out.append((i, start, len(part), zlib.crc32(part), len(ids), row))
                if out:
                    i, *rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select(doc_id, text).mapInArrow(run, _SCHEMA.format(id=kind))


def fill(counts: np.ndarray, room: int) -> list[int]:
    """Lengths out of a multiset that together come closest to ``room`` from below.

    ``counts[n]`` is how many pieces of length ``n`` there are. The bits of an integer stand for the sums within
    reach; each further length shifts it by the length, doubling the number of copies while they last. The work ends
    with the first length that reaches ``room`` itself. Going back through the integers kept from before each shift
    gives how many copies of each length were used.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for n in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, many = min(int(counts[n]), room // n), 1
        while left:
            many = min(many, left)
            grown = reach | (reach << (n * many)) & mask
            if grown != reach:
                trail.append((n, many, reach))
                reach = grown
            left -= many
            many *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, []
    for n, many, before in reversed(trail):
        if not before >> total & 1:
            used += [n] * many
            total -= n * many
    return used


def min_bin_slack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Every bin opens with the longest piece left; the rest fill what room it has."""
    counts = np.bincount(lengths, minlength=window + 1)
    order = np.argsort(lengths, kind="stable")
    ends = np.cumsum(counts)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    longest, number = window, 0
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return bins, offsets
        counts[longest] -= 1
        used = [longest, *fill(counts, window - longest)]
        offset = 0
        for i, n in enumerate(used):
            if i:
                counts[n] -= 1
            piece = order[ends[n] - 1 - counts[n]]
            bins[piece], offsets[piece] = number, offset
            offset += n
        number += 1


def pack_documents(docs: DataFrame, window: int = 2048, group: int = 8192, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens with little padding.

    Full windows are sequences of their own. The remainders are dealt evenly to groups of about ``group`` pieces, a
    number that the table's size does not change, and each group is packed by minimum bin slack. Only the last
    sequence of a group can have notable slack. Repeated rows are packed as often as they come; a null id stays null;
    an empty table gives an empty result; columns besides id and text play no part.

    Returns ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, a row for each piece.
    """
    cut = stage(pieces(docs, window, doc_id, text, vocabulary, folder).withColumn("part", F.spark_partition_id()), "pieces")
    rest = cut.where(F.col("length") < window)
    groups = blocks_for(rest.count(), group)
    full = cut.where(F.col("length") == window)
    full = full.withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("part", "deal"), F.lit(groups))).drop("part", "deal")
    kept = [c for c in dealt.columns if c != "grp"]

    def pack(table: pa.Table) -> pa.Table:
        bins, offsets = min_bin_slack(table["length"].to_numpy(), window)
        ids = (table["grp"][0].as_py() << 32 | bins) * 2 + 1
        return pa.table([*(table[c] for c in kept), pa.array(ids), pa.array(offsets)], [*kept, "sequence_id", "offset"])

    schema = dealt.drop("grp").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    packed = dealt.groupBy("grp").applyInArrow(pack, schema)
    return full.select(packed.columns).union(packed).withColumnRenamed("doc_id", doc_id)
