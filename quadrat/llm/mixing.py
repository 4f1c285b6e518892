"""Mixing domains to target weights with soft membership."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import subword
from quadrat.llm.store import stage

#: Domains of the label table, in the order of their labels: quality 0, quality 1 and not toxic, quality 1 and toxic.
DOMAINS = ("low", "good", "toxic")
TARGETS = {"low": 0.05, "good": 0.90, "toxic": 0.05}


def domain_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)``: the place in ``DOMAINS`` of each labelled document."""
    label = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 0, 1).when(F.col("toxic") == 1, 2)
    return labels.select("doc_id", label.alias("label"))


def domain_posteriors(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """``docs`` (without a column ``posterior`` of its own) and ``posterior``: the probability of each domain, from a
    calibrated classifier that learns from at most ``sample`` labelled documents."""
    model = subword.fit(docs, domain_labels(labels), len(DOMAINS), sample, calibrate=True)
    return subword.probabilities(docs.drop("posterior"), model, "text", "posterior")


def fit_rates(members: DataFrame, targets: Mapping[str, float], budget: float | None = None, max_rate: float = float("inf"), tolerance: float = 1e-3, settled: float = 1e-5) -> tuple[DataFrame, list[float]]:
    """Nonnegative rates whose expected tokens by domain come closest to the targets.

    ``members`` has ``tokens`` and ``posterior``. With ``a = tokens * posterior`` the sum of ``rate * a`` over all
    documents should be ``budget * target``; the squared error of the shares is minimised over ``0 <= rate <=
    max_rate``, with a small weight on the tokens' squared distance from rate 1, so that documents move no further than the targets
    ask. The default budget is the number of tokens there are.

    With that weight the best rates are ``1 - pull . posterior``, held to the bounds, for one number of ``pull`` a domain. These are
    found by steps of Newton on the dual problem, which is smooth and convex, with the curvature of the documents
    that are not at a bound. The weight begins at 1 and is made ten times smaller at a time, each time from the error that was left.
    So the number of rounds does not depend on how slowly documents move to their bounds.

    Ends when all shares are within ``tolerance`` of their targets, or at the optimum: when a whole gradient step, held to the
    bounds, would move less than ``settled`` of the budget. In the latter case the targets cannot be met by these documents,
    and a ``RuntimeWarning`` names the shares that come closest.

    A round sums a dozen numbers over all documents and sends ``pull`` back: nothing else is gathered, and nothing is written.

    Returns ``members`` with ``rate``, and the shares of the domains reached.
    """
    k, goal = len(targets), np.array(list(targets.values()), float)
    goal = goal / goal.sum()
    at = lambda i: F.element_at("posterior", i + 1)
    by = lambda x: reduce(Column.__add__, [at(i) * F.lit(float(v)) for i, v in enumerate(x)])
    held = lambda rate: F.least(F.greatest(rate, F.lit(0.0)), F.lit(max_rate))
    ends = [(i, j) for i in range(k) for j in range(i + 1)]
    total = members.agg(F.sum("tokens")).first()[0]
    if not total:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * k
    budget = float(budget or total)

    def sums(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares at these rates, the curvature of what is between the bounds, and the documents' part of the dual."""
        rows = members.select("tokens", "posterior", (1 - by(pull)).alias("free")).withColumn("rate", held(F.col("free")))
        loose = F.when(F.col("rate") == F.col("free"), F.col("tokens")).otherwise(0)
        value = F.col("tokens") * F.col("rate") * (F.col("free") - F.col("rate") / 2)
        *row, dual = rows.agg(*[F.sum(F.col("rate") * F.col("tokens") * at(i)) for i in range(k)], *[F.sum(loose * at(i) * at(j)) for i, j in ends], F.sum(value)).first()
        curve = np.zeros((k, k))
        for (i, j), v in zip(ends, row[k:]):
            curve[i, j] = curve[j, i] = v / budget
        return np.array(row[:k]) / budget, curve, dual / budget

    weight, pull = 1.0, np.zeros(k)
    found, curve, dual = sums(pull)
    while np.abs(found - goal).max() >= tolerance:
        for _ in range(50):
            slope = goal + weight * pull - found
            if np.abs(slope).max() <= max(tolerance / 100, 1e-9) * min(1.0, 10 * float(np.abs(found - goal).max())):
                break
            step = -np.linalg.solve(curve + weight * np.eye(k), slope)
            worth, length = goal @ pull + weight * pull @ pull / 2 + dual, 1.0
            while True:
                new = pull + length * step
                following = sums(new)
                if goal @ new + weight * new @ new / 2 + following[2] <= worth + 1e-4 * length * (slope @ step) + 1e-12 * max(1.0, abs(worth)) or length < 1e-6:
                    break
                length /= 4
            pull, (found, curve, dual) = new, following
            if np.abs(found - goal).max() < tolerance:
                break
        error = found - goal
        if np.abs(error).max() < tolerance:
            break
        if weight <= settled:
            rate = held(1 - by(pull))
            left = members.agg(F.sum(F.col("tokens") * F.abs(held(rate - by(error)) - rate))).first()[0]
            if left / budget < settled or weight < settled / 1000:
                warnings.warn(f"targets {goal.tolist()} cannot be met: the closest shares of the budget are {found.tolist()}", RuntimeWarning, stacklevel=2)
                break
        weight, pull = weight / 10, pull * 10
        found, curve, dual = sums(pull)
    return members.withColumn("rate", held(1 - by(pull))), (found / max(found.sum(), 1e-12)).tolist()


def tokens(text: Column) -> Column:
    """Words of a text: runs without ASCII white space. None for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None, sample: int = 4000, max_rate: float = float("inf"), tolerance: float = 1e-3) -> DataFrame:
    """Give every document a rate, so that the expected tokens of the domains stand in the ratio of ``targets``.

    The rate is how often a document should be seen: 0 leaves it out, 2.5 means twice or three times. Domains are
    those of the label table (``DOMAINS``); an unlabelled document belongs to all of them, with the probabilities that
    the classifier gives. Targets that the documents cannot meet are approached as far as rates up to ``max_rate`` go, with a warning.

    A null or blank text has no tokens and moves like the average of the labelled documents. Repeated rows have rates
    of their own; an empty table gives an empty result; texts of any length are read whole. Other columns pass through,
    but those named ``tokens``, ``posterior`` and ``rate`` are replaced. ``labels`` without any usable row give equal
    posteriors.

    Returns the columns of ``docs`` with ``tokens``, ``posterior`` and ``rate``; without the text, which the fit does
    not need again, unless asked for by a join on the id.
    """
    members = domain_posteriors(docs, labels, sample).withColumn("tokens", tokens(F.col("text"))).drop("text")
    return fit_rates(stage(members, "members"), targets, budget, max_rate, tolerance=tolerance)[0]


def copies(rate: Column, *keys: str) -> Column:
    """How often a document is taken: the rate, rounded up with the probability of its fraction, by a hash of ``keys``."""
    chance = F.pmod(F.xxhash64(*keys, F.lit("mixing")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + chance).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, **how) -> DataFrame:
    """The documents repeated by their rates (see ``mix``), with their own columns, whatever their names. A document with
    rate 1 or more always stays. Rows that agree in id and text have one rate; null ids and texts are ids and texts like
    any other; an empty table gives an empty result."""
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("twin"))
    rated = mix(docs.select("doc_id", "text", F.xxhash64("text").alias("twin")), labels, targets, **how)
    rates = rated.groupBy(F.col("doc_id").alias("i"), F.col("twin").alias("t")).agg(F.max("rate").alias("rate"))
    found = keyed.join(rates, F.col("id").eqNullSafe(F.col("i")) & (F.col("twin") == F.col("t"))).withColumn("n", copies(F.col("rate"), "id", "twin"))
    taken = found.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
