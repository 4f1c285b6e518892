"""Standard names: fuzzy matches, overrides, junk, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.text import name_key, similarity, token_sorted, with_weighted_ratio


#: Parts of either side where all pairs are scored.
_SIDES = 8


def _first_grams(c: Column, threshold: float) -> Column:
    """The bigrams of a padded name, numbered where they repeat, that come first by hash: as many as must hold a shared one.

    A name of length n has n + 1 bigrams, and an edit spoils two. Names whose ratio reaches the threshold are at most
    (1 - threshold) * n edits apart, n the longer length, so that more than all but ``2 * (1 - threshold) * n + 1`` are
    shared, and one of these is among the first so many of both sides. From a threshold of 50 on there always is one.
    """
    padded = F.concat(F.lit("\x01"), c, F.lit("\x02"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    numbered = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    keys = F.array_sort(F.transform(numbered, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    first = F.floor((1.0 - threshold / 100.0) * 2 * F.length(c) + 1e-9).cast("int") + 1
    return F.transform(F.slice(keys, F.lit(1), first), lambda k: k["g"])


def fuzzy_match(names: DataFrame, refs: DataFrame, threshold: float = 85.0, name: str = "name", ref: str = "ref", subsets: bool = False) -> DataFrame:
    """The most similar reference of each distinct name and the score of the next one, ties to the first in order.

    Scores below the threshold are null. Above it none is lost: candidates are joined on bigrams of the keys, as they are
    and with words sorted, chosen so that any pair that reaches the threshold shares one, and with ``subsets`` also on
    words. Below a threshold of 50 no such choice exists, and all pairs of the distinct names are scored: both sides are dealt
    to ``_SIDES`` parts by hash, and every two parts meet under one key of the join.
    """

    def under(mark: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.concat(F.lit(mark), k))

    def keyed(df: DataFrame, col: str, left: bool) -> DataFrame:
        one = df.select(col).where(F.col(col).isNotNull()).distinct()
        if threshold < 50:
            own = F.pmod(F.xxhash64(col), F.lit(_SIDES))
            other = F.sequence(F.lit(0).cast("long"), F.lit(_SIDES - 1).cast("long"))
            return one.withColumn("__k", F.explode(F.transform(other, lambda o: F.concat_ws(":", own if left else o, o if left else own))))
        sets = [under(f"{form.__name__}:", _first_grams(form(F.col(col)), threshold)) for form in (name_key, token_sorted)]
        if subsets:
            sets.append(under("word:", F.split(name_key(F.col(col)), " ")))
        return one.withColumn("__k", F.explode(F.array_distinct(F.concat(*sets))))

    pairs = keyed(names, name, True).join(keyed(refs, ref, False), "__k").select(name, ref).distinct()
    scored = pairs.withColumn("score", similarity(F.col(name), F.col(ref), subsets))
    return _top(scored, names.select(name).where(F.col(name).isNotNull()).distinct(), [name], ref, threshold)


def _near(names: DataFrame, refs: DataFrame, name: str, ref: str, threshold: float) -> DataFrame:
    """Pairs of distinct names that may reach the threshold by ``with_weighted_ratio``, none lost from 70 on.

    Strings with a common subsequence of length L and an edit ratio of q are ``2 * L * (1 / q - 1)`` edits apart, and every edit breaks
    one of the L - 1 places where two of its letters stand side by side. So they share a bigram if L is over
    ``1 / (3 - 2 / q)``, and a name that does not has at most ``2 / q - 1`` times that length: a short one. A pair reaches
    the threshold by an edit ratio of at least that, of the keys, their sorted words or a window of these; or it shares a
    word. So candidates share a word or a bigram, or one of them is short, and these share a letter. A name of n letters
    looks for fewer than all its bigrams, the rarest among the references first: as many as there may be unshared, and one.
    """
    q = threshold / 100.0
    least = int(1 / (3 - 2 / q) + 1e-9)
    short = int(least * (2 / q - 1) + 1e-9)

    def keyed(df: DataFrame, col: str) -> DataFrame:
        one = df.select(F.col(col).alias("s")).where(F.length(name_key(F.col(col))) > 0).distinct()
        return one.select("s", F.explode(F.array_distinct(F.array(name_key(F.col("s")), token_sorted(F.col("s"))))).alias("key"))

    def grams(df: DataFrame) -> DataFrame:
        pieces = F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring("key", i, F.lit(2)))
        return df.where(F.length("key") > 1).select("s", "key", F.explode(F.array_distinct(pieces)).alias("gram"))

    def looked_for(df: DataFrame, counts: DataFrame) -> DataFrame:
        n = F.length("key")
        shared = F.greatest(F.ceil(n * q / (2 - q) * (3 - 2 / q) - 1 - 1e-9), F.lit(1))
        order = Window.partitionBy("s", "key").orderBy(F.coalesce("times", F.lit(0)), "gram")
        return grams(df).join(counts, "gram", "left").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n - 1 - shared + 1).select("s", "gram").distinct()

    left, right = keyed(names, name), keyed(refs, ref)
    counts = grams(right).groupBy("gram").agg(F.count("*").alias("times"))
    all_left, all_right = (grams(t).select("s", "gram").distinct() for t in (left, right))
    words = [t.select("s", F.explode(F.split("key", " ")).alias("gram")).distinct() for t in (left, right)]
    letters = [t.select("s", F.explode(F.filter(F.split("key", ""), lambda c: c != "")).alias("gram"), (F.length("key") <= short).alias("short")).distinct() for t in (left, right)]
    few = [t.where("short").select("s", "gram") for t in letters]
    sides = [(looked_for(left, counts), all_right), (all_left, looked_for(right, counts)), words, (few[0], letters[1].select("s", "gram")), (letters[0].select("s", "gram"), few[1])]
    met = [a.select(F.col("s").alias(name), "gram").join(b.select(F.col("s").alias(ref), "gram"), "gram").select(name, ref) for a, b in sides]
    return reduce(DataFrame.union, met).distinct()


def fuzzy_match_weighted(names: DataFrame, refs: DataFrame, threshold: float = 85.0, name: str = "name", ref: str = "ref") -> DataFrame:
    """As ``fuzzy_match``, by ``with_weighted_ratio``: the whole, its sorted words, its set of words, and where one name is much
    longer the best window of it. Candidates lose no pair that reaches the threshold, which is 70 at least (``ValueError``
    below). Null names are left out; names without letters have no match."""
    if threshold < 70:
        raise ValueError("below 70 no choice of candidates is known to lose none")
    scored = with_weighted_ratio(_near(names, refs, name, ref, threshold), name, ref)
    return _top(scored, names.select(name).where(F.col(name).isNotNull()).distinct(), [name], ref, threshold)


def fuzzy_match_blocked(pairs: DataFrame, refs: DataFrame, threshold: float = 80.0, block: str = "state", name: str = "district", ref: str = "ref", subsets: bool = False) -> DataFrame:
    """As ``fuzzy_match``, against all references of the same block; names of a block without references are matched
    with the references of every block. Adds ``source`` (block or all) and ``status``."""
    distinct = pairs.select(block, name).where(F.col(name).isNotNull()).distinct()
    known = refs.select(F.col(block)).distinct()
    inside = distinct.join(refs.select(block, ref).distinct(), block).withColumn("score", similarity(F.col(name), F.col(ref), subsets))
    inside = _top(inside, distinct.join(known, block, "left_semi"), [block, name], ref, threshold).withColumn("source", F.lit("block"))
    rest = distinct.join(known, block, "left_anti")
    outside = fuzzy_match(rest, refs, threshold, name, ref, subsets)
    outside = rest.join(outside, name).select(*inside.columns[:-1], F.lit("all").alias("source"))
    return inside.unionByName(outside).withColumn("status", F.when(F.col(ref).isNull(), "unmatched").otherwise("matched"))


def _top(scored: DataFrame, wanted: DataFrame, keys: list[str], ref: str, threshold: float) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), ref)
    good = scored.where(F.col("score") >= threshold)
    first = good.withColumns({"__n": F.row_number().over(order), "runner_up": F.lead("score").over(order)}).where("__n = 1").drop("__n")
    return wanted.join(first, keys, "left").select(*keys, ref, "score", "runner_up")


def apply_overrides(df: DataFrame, overrides: DataFrame, col: str, scope: str | None = None) -> DataFrame:
    """Replace values by a dictionary ``(scope, old, new)``; with ``scope`` only within its value, else everywhere.

    The dictionary is a dimension: Spark broadcasts it where its size allows.
    """
    if scope:
        book = overrides.select(F.col("scope").alias(scope), F.col("old").alias(col), F.col("new").alias("__new")).dropDuplicates([scope, col])
        found = df.join(book, [scope, col], "left")
    else:
        found = df.join(overrides.select(F.col("old").alias(col), F.col("new").alias("__new")).dropDuplicates([col]), col, "left")
    return found.withColumn(col, F.coalesce("__new", col)).select(*df.columns)


def apply_pair_overrides(df: DataFrame, overrides: DataFrame, state: str = "state", name: str = "district") -> DataFrame:
    """Replace pairs of parent and name by a dictionary ``(old_state, old_name, new_state, new_name)``; a null new value keeps
    the old one. Of several entries for a pair one counts."""
    book = overrides.select(F.col("old_state").alias(state), F.col("old_name").alias(name), F.col("new_state").alias("__s"), F.col("new_name").alias("__n")).dropDuplicates([state, name])
    found = df.join(book, [state, name], "left")
    return found.withColumns({state: F.coalesce("__s", state), name: F.coalesce("__n", name)}).select(*df.columns)


def remap(df: DataFrame, mapping: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rewrite a column by ``(old, new)`` and count: distinct old values that were there, and rows changed."""
    book = mapping.where("NOT (old <=> new)").select(F.col("old").alias(col), F.col("new").alias("__new")).dropDuplicates([col])
    found = df.join(book, col, "left")
    changed = F.col("__new").isNotNull()
    counts = found.agg(F.countDistinct(F.when(changed, F.col(col))).alias("values_found"), F.count_if(changed).alias("rows_changed"))
    return found.withColumn(col, F.coalesce("__new", col)).select(*df.columns), counts


def drop_junk(df: DataFrame, col: str, values: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Without rows whose value is null, blank, in the list, or matches a pattern (upper and lower case alike)."""
    keep = F.col(col).isNotNull() & (F.trim(col) != "")
    if values:
        keep &= ~F.col(col).isin(*values)
    for p in patterns:
        keep &= ~F.col(col).rlike(f"(?i){p}")
    return df.where(keep)


def keep_canonical(df: DataFrame, col: str, ref: DataFrame) -> DataFrame:
    return df.join(ref.select(F.col(ref.columns[0]).alias(col)).distinct(), col, "left_semi")


def match_report(matches: DataFrame, keys: Sequence[str], name: str, ref: str) -> DataFrame:
    """For each standard name: how many originals lead to it, and which, in order."""
    return matches.where(F.col(ref).isNotNull()).groupBy(*keys, ref).agg(F.count("*").alias("originals"), F.array_join(F.sort_array(F.collect_set(name)), ",").alias("names"))


def match_counts(matches: DataFrame, ref: str) -> DataFrame:
    return matches.agg(F.count_if(F.col(ref).isNotNull()).alias("matched"), F.count_if(F.col(ref).isNull()).alias("unmatched"))


def region_inventory(pairs: DataFrame, state: str = "state", district: str = "district") -> DataFrame:
    """For each state: number of districts and their names in order."""
    return pairs.groupBy(state).agg(F.countDistinct(district).alias("districts"), F.array_join(F.sort_array(F.collect_set(district)), ",").alias("names"))


def pair_counts(tables: Mapping[str, DataFrame], state: str = "state", district: str = "district") -> DataFrame:
    """Distinct (state, district) pairs of each table, and of all together under ``all``."""
    named = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("table"), state, district).distinct() for n, df in tables.items()])
    each = named.groupBy("table").agg(F.count("*").alias("pairs"))
    return each.unionByName(named.select(state, district).distinct().agg(F.lit("all").alias("table"), F.count("*").alias("pairs")))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key and whether both sides have it, or the left or the right alone."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(1)), right.select(*keys).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    return a.join(b, list(keys), "full").select(*keys, side.alias("side"))


def change_log(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Distinct rewritten values with the similarity of old and new, and their rows."""
    return pairs.where(~F.col(before).eqNullSafe(F.col(after))).groupBy(before, after).agg(F.count("*").alias("rows")).withColumn("score", similarity(F.col(before), F.col(after)))
