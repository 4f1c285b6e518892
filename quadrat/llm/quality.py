"""Quality scores from labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import subword

ACCEPTED = 0.7


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels are kept for testing: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """Add ``held_out``, ``score`` (probability of quality 1, from the text alone) and ``predicted`` (0 or 1).

    The model learns from at most ``sample`` labelled documents that are not held out; ids, languages and sources are
    no input. Null and blank texts get the score of the bias alone; texts of any length are read whole. A null id
    counts as not held out. Repeated rows are scored each; an empty table gives an empty result; without any usable
    label every score is 0.5. Other columns pass through, but those of the three names are replaced.
    """
    scored = _scored(docs, labels, sample)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return scored.select(*kept, held_out(F.col("row").getField("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``row``, all of a document, and ``score``."""
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    model = subword.fit(docs, known, 2, sample)
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return subword.probabilities(packed, model, "text", "odds").select("row", F.element_at("odds", 2).alias("score"))


def keep_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """The documents that the classifier accepts (see ``quality_scores``), with their own columns, whatever their names.

    Null, empty and blank texts are accepted or not as the bias says. Repeated rows go or stay together; an empty table
    gives an empty result.
    """
    return _scored(docs, labels, sample).where(F.col("score") >= ACCEPTED).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
