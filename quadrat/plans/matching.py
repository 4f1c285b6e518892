"""Name matching by weighted ratios, and the SQL that scores all pairs the same way."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import features, names
from quadrat.plans.panels import table
from quadrat.plans.registry import query as _query


def _common(a: str, b: str) -> str:
    row = f"list_reduce(range(1, len({a}) + 1), lambda done, j: list_append(done, CASE WHEN ({a})[j] = c THEN row[j] + 1 ELSE greatest(row[j + 1], done[j]) END), [0::BIGINT])"
    return f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0 ELSE list_last(list_reduce(string_split({b}, ''), lambda row, c: {row}, list_transform(range(0, len({a}) + 1), lambda z: 0::BIGINT))) END"


def _edit(a: str, b: str) -> str:
    return f"coalesce(({_common(a, b)}) * 200.0::DOUBLE / nullif(len({a}) + len({b}), 0), 100)"


def _windows(a: str, b: str) -> str:
    """Ratios of ``a`` with the windows of ``b``."""
    w = f"substr({b}, greatest(i, 1)::BIGINT, (least(i + len({a}) - 1, len({b})) - greatest(i, 1) + 1)::BIGINT)"
    return f"list_max(list_transform(range(2 - len({a}), len({b}) + 1), lambda i: {_edit(a, w)}))"


def _window(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 100 WHEN least(len({a}), len({b})) = 0 THEN 0 WHEN len({a}) < len({b}) THEN {_windows(a, b)} WHEN len({a}) > len({b}) THEN {_windows(b, a)} ELSE greatest({_windows(a, b)}, {_windows(b, a)}) END"


def weighted_sql(pairs: str) -> str:
    """CTEs that end in ``scored(name, ref, score)`` for all of ``pairs(name, ref)``."""
    kept = lambda cost, total: f"coalesce(100 - ({cost}) * 100.0::DOUBLE / nullif({total}, 0), 100)"
    with_l, with_r = "(shared + gap + len(l))", "(shared + gap + len(r))"
    mixed = f"CASE WHEN gap = 0 THEN {kept('apart', f'{with_l} + {with_r}')} ELSE greatest({kept('apart', f'{with_l} + {with_r}')}, {kept('gap + len(l)', f'shared + {with_l}')}, {kept('gap + len(r)', f'shared + {with_r}')}) END"
    return f"""keyed AS (SELECT name, ref, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS x, trim(regexp_replace(lower(ref), '\\s+', ' ', 'g')) AS y FROM {pairs}),
 worded AS (SELECT *, list_sort(string_split(x, ' ')) AS u, list_sort(string_split(y, ' ')) AS v FROM keyed),
 split AS (SELECT *, list_sort(list_distinct(list_filter(u, lambda t: list_contains(v, t)))) AS common, list_sort(list_distinct(list_filter(u, lambda t: NOT list_contains(v, t)))) AS left_words, list_sort(list_distinct(list_filter(v, lambda t: NOT list_contains(u, t)))) AS right_words FROM worded),
 sides AS (SELECT *, array_to_string(u, ' ') AS us, array_to_string(v, ' ') AS vs, array_to_string(left_words, ' ') AS l, array_to_string(right_words, ' ') AS r, len(array_to_string(common, ' ')) AS shared, CASE WHEN len(common) > 0 THEN 1 ELSE 0 END AS gap,
   greatest(len(x), len(y))::DOUBLE / nullif(least(len(x), len(y)), 0) AS longer FROM split),
 parts AS (SELECT *, {_edit('x', 'y')} AS plain, {_edit('us', 'vs')} AS sorted, len(l) + len(r) - 2 * ({_common('l', 'r')}) AS apart,
   CASE WHEN longer >= 1.5 THEN {_window('x', 'y')} END AS win, CASE WHEN longer >= 1.5 AND gap = 0 THEN greatest({_window('us', 'vs')}, {_window('l', 'r')}) END AS win_words FROM sides),
 scored AS (SELECT name, ref, CASE WHEN longer IS NULL THEN 0
   WHEN longer < 1.5 THEN greatest(plain, greatest(sorted, CASE WHEN gap = 1 AND (len(l) = 0 OR len(r) = 0) THEN 100 ELSE {mixed} END) * 0.95::DOUBLE)
   ELSE greatest(plain, win * (CASE WHEN longer < 8 THEN 0.9::DOUBLE ELSE 0.6 END), (CASE WHEN gap = 1 THEN 100 ELSE win_words END) * 0.95::DOUBLE * (CASE WHEN longer < 8 THEN 0.9::DOUBLE ELSE 0.6 END)) END AS score FROM parts)"""


#: Names of parts against the same with letters dropped, words turned round or left out, and words put in front.
_PAIRS = """n AS (SELECT DISTINCT p_name AS name FROM part),
 r AS (SELECT DISTINCT unnest([replace(name, 'i', ''), split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1), 'the ' || name || ' of parts', replace(split_part(name, ' ', 2), 'e', 'a')]) AS ref FROM n), pairs AS (SELECT name, ref FROM n, r)"""


@_query(f"""WITH {_PAIRS}, {weighted_sql('pairs')}, k AS (SELECT name, ref, score, row_number() OVER w AS place, lead(score) OVER w AS runner_up FROM scored WHERE score >= 85 WINDOW w AS (PARTITION BY name ORDER BY score DESC, ref))
SELECT n.name, k.ref, round(k.score, 6) AS score, round(k.runner_up, 6) AS runner_up FROM n LEFT JOIN k ON k.name = n.name AND place = 1""")
def fuzzy_weighted(s, d):
    """Part names matched with longer, turned and misspelt forms of them."""
    left = table(s, d, "part").select(F.col("p_name").alias("name")).distinct()
    word = lambda i: F.split("name", " ")[i]
    forms = F.array(F.replace("name", F.lit("i"), F.lit("")), F.concat_ws(" ", word(1), word(0)), F.concat(F.lit("the "), "name", F.lit(" of parts")), F.replace(word(1), F.lit("e"), F.lit("a")))
    right = left.select(F.explode(forms).alias("ref")).distinct()
    return features.rounded(names.fuzzy_match_weighted(left, right, 85.0))
