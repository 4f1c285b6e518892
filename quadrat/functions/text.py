"""Column expressions for names: keys, title case, encoding repair, noise removal, similarity."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def name_key(c: Column) -> Column:
    """Lower case, white space runs one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def title(c: Column) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest ("5th" becomes "5Th")."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def basic_name(c: Column) -> Column:
    """Noise characters to spaces, then title case."""
    return title(F.trim(F.regexp_replace(F.translate(F.lower(F.trim(c)), "*?().,-_", " " * 8), r"\s+", " ")))


def nfc(c: Column) -> Column:
    """Unicode composition, which Spark has no function for. Meant for distinct names."""

    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")

    return F.pandas_udf(compose, "string")(c)


def repair_encoding(c: Column) -> Column:
    """Undo UTF-8 read as Latin-1 where that is possible, and fold dashes to a hyphen."""
    again = F.when(c.rlike(r"^[\x00-\xFF]*$"), F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string")))
    return F.regexp_replace(F.coalesce(again, c), "[–—−]", "-")


def fix_encoding(c: Column) -> Column:
    """Repair, composition and dash folding."""
    return nfc(repair_encoding(c))


def clean_text(c: Column, strict: bool = False) -> Column:
    """Noise characters to spaces; ``strict`` keeps lower-case letters, digits, spaces and hyphens only."""
    kept = F.regexp_replace(F.lower(c), r"[^a-z0-9 -]", " ") if strict else F.regexp_replace(c, r"[*?()\[\].,_/\\]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalise_region(c: Column) -> Column:
    """Repair and composition, drop parentheses, collapse spaces, strip noise at the ends but keep hyphens, title case."""
    plain = F.regexp_replace(F.regexp_replace(fix_encoding(c), r"[()]", " "), r"\s+", " ")
    return title(F.regexp_replace(plain, r"^[\s*?.,_-]+|[\s*?.,_-]+$", ""))


def ratio(a: Column, b: Column) -> Column:
    """``100 * (1 - levenshtein / longer length)``; 100 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.try_divide((longest - F.levenshtein(a, b)) * 100.0, longest), F.lit(100.0))


def token_sorted(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(name_key(c), " ")), " ")


def word_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the words that both have, and those with the rest of either side behind them; 0 where
    no word is shared."""
    x, y = (F.array_sort(F.array_distinct(F.split(name_key(c), " "))) for c in (a, b))
    joined = lambda *parts: F.array_join(F.concat(*parts), " ")
    both = F.array_intersect(x, y)
    left, right = joined(both, F.array_except(x, y)), joined(both, F.array_except(y, x))
    return F.when(F.size(both) > 0, F.greatest(ratio(joined(both), left), ratio(joined(both), right), ratio(left, right))).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column, subsets: bool = False) -> Column:
    """The larger of the ratios of the keys as they are and with their words sorted; with ``subsets`` also 0.95 of the
    ratio of their sets of words, which is high where one name holds the other."""
    plain = F.greatest(ratio(name_key(a), name_key(b)), ratio(token_sorted(a), token_sorted(b)))
    return F.greatest(plain, word_set_ratio(a, b) * 0.95) if subsets else plain


def _bits(name: str) -> dict[str, int]:
    """For each letter its places in ``name``, a bit each."""
    places: dict[str, int] = {}
    for i, c in enumerate(name):
        places[c] = places.get(c, 0) | 1 << i
    return places


def _common(places: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of ``other`` and the name of ``places``: a row of the usual table is one number."""
    full = row = (1 << size) - 1
    for c in other:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def _best_window(short: str, long: str) -> float:
    places, n, best = _bits(short), len(short), 0.0
    for i in range(1 - n, len(long)):
        window = long[max(i, 0) : i + n]
        if best * (n + len(window)) < 200.0 * len(window):  # it might be better
            best = max(best, 200.0 * _common(places, n, window) / (n + len(window)))
    return best


@F.pandas_udf(T.IntegerType())
def _common_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _common(_bits(x), len(x), y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def _window_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    def best(x, y):
        if x is None or y is None:
            return None
        if not x or not y:
            return 100.0 if x == y else 0.0
        if len(x) == len(y):
            return max(_best_window(x, y), _best_window(y, x))
        return _best_window(*sorted((x, y), key=len))

    return pd.Series([best(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two names, which Spark has no function for. Meant for pairs of distinct names."""
    return _common_lengths(a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    """``200 * common / (both lengths)``: as ``ratio``, where a replaced letter counts as one removed and one put in; 100 for two empty strings."""
    return F.coalesce(F.try_divide(common_length(a, b) * 200.0, F.length(a) + F.length(b)), F.when(a.isNotNull() & b.isNotNull(), F.lit(100.0)))


def window_ratio(a: Column, b: Column) -> Column:
    """The best ``edit_ratio`` of the shorter string with a window of the longer, as long as the shorter or cut off at an end; with
    equal lengths either may be the one with windows. 0 if one is empty, 100 if both are."""
    return _window_ratios(a, b)


def with_weighted_ratio(df: DataFrame, a: str, b: str, score: str = "score") -> DataFrame:
    """Add the best of several similarities of two names, each with its weight, 0 to 100; 0 if one has no letters, null if one is null.

    Compared are the keys as they are, with words sorted, and as sets of words (words that both have count once; 100 where all of one
    side's are among the other's). Sorted words and sets weigh 0.95. Where one key is 1.5 times as long as the other or
    longer, instead of the last two the shorter one is held against windows of the longer: as they are, weight 0.9 (0.6 from 8 times on), and with
    words sorted or without the words that both have, 0.95 of that; a word that both have makes the latter 100.
    """
    words = lambda k: F.array_sort(F.filter(F.split(k, " "), lambda w: w != ""))
    kept = lambda cost, total: F.coalesce(100.0 - F.try_divide(cost * 100.0, total), F.lit(100.0))
    c = F.col
    # step by step, so that no part is computed twice
    out = df.select("*", name_key(c(a)).alias("__x"), name_key(c(b)).alias("__y")).withColumns({"__u": words("__x"), "__v": words("__y")})
    out = out.withColumns({"__both": F.array_intersect("__u", "__v"), "__lw": F.array_except("__u", "__v"), "__rw": F.array_except("__v", "__u")})
    out = out.withColumns({f"__{n}": F.array_join(f"__{w}", " ") for n, w in (("us", "u"), ("vs", "v"), ("l", "lw"), ("r", "rw"))})
    out = out.withColumns({"__shared": F.length(F.array_join("__both", " ")), "__gap": F.when(F.size("__both") > 0, 1).otherwise(0), "__longer": F.try_divide(F.greatest(F.length("__x"), F.length("__y")), F.least(F.length("__x"), F.length("__y")))})
    much = c("__longer") >= 1.5
    out = out.withColumns({
        "__plain": edit_ratio(c("__x"), c("__y")), "__sorted": F.when(~much, edit_ratio(c("__us"), c("__vs"))), "__apart": F.when(~much, F.length("__l") + F.length("__r") - 2 * common_length(c("__l"), c("__r"))),
        "__window": F.when(much, window_ratio(c("__x"), c("__y"))), "__words": F.when(much & (c("__gap") == 0), F.greatest(window_ratio(c("__us"), c("__vs")), window_ratio(c("__l"), c("__r")))),
    })
    with_l, with_r = (c("__shared") + c("__gap") + F.length(x) for x in ("__l", "__r"))
    of_sets = F.when((c("__gap") == 1) & (F.least(F.length("__l"), F.length("__r")) == 0), 100.0).when(c("__gap") == 0, kept(c("__apart"), with_l + with_r)).otherwise(
        F.greatest(kept(c("__apart"), with_l + with_r), kept(c("__gap") + F.length("__l"), c("__shared") + with_l), kept(c("__gap") + F.length("__r"), c("__shared") + with_r))
    )
    scale = F.when(c("__longer") < 8, 0.9).otherwise(0.6)
    long = F.greatest("__plain", c("__window") * scale, F.when(c("__gap") == 1, 100.0).otherwise(c("__words")) * 0.95 * scale)
    found = F.when(c("__x").isNull() | c("__y").isNull(), F.lit(None)).when(c("__longer").isNull(), 0.0).when(~much, F.greatest("__plain", F.greatest("__sorted", of_sets) * 0.95)).when(much, long)
    return out.select(*df.columns, found.alias(score))


def short_number(c: Column) -> Column:
    """1234 as 1.2K, 2500000 as 2.5M."""
    return F.when(F.abs(c) >= 1e6, F.format_string("%.1fM", c / 1e6)).when(F.abs(c) >= 1e3, F.format_string("%.1fK", c / 1e3)).otherwise(F.format_string("%.0f", c.cast("double")))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100.0)
