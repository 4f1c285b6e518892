"""Queries of the name chain and of the repairs, on names that the tables' own are dirtied into."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import text
from quadrat.operators import features, names, quality
from quadrat.plans.panels import ENROL, enrol, table
from quadrat.plans.registry import query

R = features.rounded

_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z]+|[^a-z]+'), lambda x: upper(left(x, 1)) || substr(x, 2)), '')"


@query(f"SELECT c_custkey, {_TITLE.format('''trim(regexp_replace(translate(' *' || c_mktsegment || '-' || c_name || ' ?.', '*?().,-_', '        '), '\\s+', ' ', 'g'))''')} AS name FROM customer")
def basic_names(s, d):
    noisy = F.concat(F.lit(" *"), "c_mktsegment", F.lit("-"), "c_name", F.lit(" ?."))
    return table(s, d, "customer").select("c_custkey", text.basic_name(noisy).alias("name"))


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name || '[' || c_mktsegment || ']_,x', '[*?()\\[\\].,_/\\\\]+', ' ', 'g'), '\\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(regexp_replace(lower(c_name || '[' || c_mktsegment || ']_,x'), '[^a-z0-9 -]', ' ', 'g'), '\\s+', ' ', 'g')) AS strict FROM customer""")
def noise_removed(s, d):
    noisy = F.concat("c_name", F.lit("["), "c_mktsegment", F.lit("]_,x"))
    return table(s, d, "customer").select("c_custkey", text.clean_text(noisy).alias("plain"), text.clean_text(noisy, strict=True).alias("strict"))


@query("SELECT c_custkey, c_name || 'é - ' || c_mktsegment AS name FROM customer")
def encoding_repaired(s, d):
    """UTF-8 read as Latin-1, a letter with its accent apart, a long dash."""
    key = F.col("c_custkey") % 2
    broken = F.when(key == 0, F.concat("c_name", F.lit("Ã© - "), "c_mktsegment")).otherwise(F.concat("c_name", F.lit("é – "), "c_mktsegment"))
    return table(s, d, "customer").select("c_custkey", text.fix_encoding(broken).alias("name"))


@query(f"""SELECT DISTINCT {_TITLE.format("n_name || ' ' || c_mktsegment || '-e'")} AS name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def normalised_regions(s, d):
    """Distinct names alone go through the Unicode step."""
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    noisy = rows.select(F.concat(F.lit(" *"), "n_name", F.lit("  ("), "c_mktsegment", F.lit("-e) .")).alias("raw")).distinct()
    return noisy.select(text.normalise_region(F.col("raw")).alias("name")).distinct()


def _spelt(s, d):
    """Nations as segments' customers spell them: every other segment swaps two letters, one segment is not in the references."""
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    spelt = F.when(F.length("c_mktsegment") % 2 == 0, F.replace("n_name", F.lit("NATION"), F.lit("NATOIN"))).otherwise(F.concat(F.lower("n_name"), F.lit(" town")))
    return rows.select("c_custkey", F.col("c_mktsegment").alias("state"), spelt.alias("district"))


def _references(s, d):
    rows = table(s, d, "customer").where("c_mktsegment <> 'MACHINERY'").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_mktsegment").alias("state"), F.concat(F.lit("Nation "), F.substring("n_name", 8, 9)).alias("ref")).distinct()


def _ratio_sql(a, b):
    return f"(greatest(length({a}), length({b})) - levenshtein({a}, {b})) * 100.0::DOUBLE / greatest(length({a}), length({b}))"


_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_SPELT = """spelt AS (SELECT c_custkey, c_mktsegment AS state, CASE WHEN length(c_mktsegment) % 2 = 0 THEN replace(n_name, 'NATION', 'NATOIN') ELSE lower(n_name) || ' town' END AS district FROM customer JOIN nation ON c_nationkey = n_nationkey),
 refs AS (SELECT DISTINCT c_mktsegment AS state, 'Nation ' || substr(n_name, 8, 9) AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY')"""
_MATCHED = f"""{_SPELT}, names AS (SELECT DISTINCT state, district FROM spelt),
 pairs AS (SELECT n.state, n.district, r.ref, 'block' AS source FROM names n JOIN refs r USING (state) UNION SELECT n.state, n.district, r.ref, 'all' FROM names n CROSS JOIN (SELECT DISTINCT ref FROM refs) r WHERE n.state NOT IN (SELECT state FROM refs)),
 keyed AS (SELECT *, trim(regexp_replace(lower(district), '\\s+', ' ', 'g')) AS x, trim(regexp_replace(lower(ref), '\\s+', ' ', 'g')) AS y FROM pairs),
 scored AS (SELECT *, greatest({_ratio_sql('x', 'y')}, {_ratio_sql(_SORTED.format('x'), _SORTED.format('y'))}) AS score FROM keyed),
 best AS (SELECT state, district, ref, source, score, lead(score) OVER w AS runner_up, row_number() OVER w AS n FROM scored WHERE score >= 65 WINDOW w AS (PARTITION BY state, district ORDER BY score DESC, ref)),
 matched AS (SELECT n.state, n.district, b.ref, b.score, b.runner_up, CASE WHEN n.state IN (SELECT state FROM refs) THEN 'block' ELSE 'all' END AS source, CASE WHEN b.ref IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM names n LEFT JOIN best b ON b.state = n.state AND b.district = n.district AND b.n = 1)"""


def _matched(s, d):
    return names.fuzzy_match_blocked(_spelt(s, d), _references(s, d), 65.0)


@query(f"WITH {_MATCHED} SELECT state, district, ref, round(score, 6) AS score, round(runner_up, 6) AS runner_up, source, status FROM matched")
def fuzzy_blocked(s, d):
    return R(_matched(s, d))


_WORDSET = f"""{_SPELT}, names AS (SELECT DISTINCT district AS name FROM spelt), r AS (SELECT DISTINCT ref FROM refs), keyed AS (SELECT name, ref, list_distinct(string_split(lower(name), ' ')) AS x, list_distinct(string_split(lower(ref), ' ')) AS y, lower(name) AS a, lower(ref) AS b FROM names, r),
 parts AS (SELECT *, list_sort(list_intersect(x, y)) AS i, list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS dx, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS dy FROM keyed),
 joined AS (SELECT name, ref, a, b, array_to_string(i, ' ') AS t0, array_to_string(list_concat(i, dx), ' ') AS t1, array_to_string(list_concat(i, dy), ' ') AS t2, len(i) AS n FROM parts),
 scored AS (SELECT name, ref, greatest({_ratio_sql('a', 'b')}, {_ratio_sql(_SORTED.format('a'), _SORTED.format('b'))}, CASE WHEN n > 0 THEN 0.95::DOUBLE * greatest({_ratio_sql('t0', 't1')}, {_ratio_sql('t0', 't2')}, {_ratio_sql('t1', 't2')}) ELSE 0 END) AS score FROM joined),
 best AS (SELECT name, ref, score, lead(score) OVER w AS runner_up, row_number() OVER w AS n FROM scored WHERE score >= 60 WINDOW w AS (PARTITION BY name ORDER BY score DESC, ref))
SELECT names.name, ref, round(score, 6) AS score, round(runner_up, 6) AS runner_up FROM names LEFT JOIN best ON best.name = names.name AND n = 1"""


@query(f"WITH {_WORDSET}")
def fuzzy_word_sets(s, d):
    """Matches in all references, with the ratio of the sets of words."""
    return R(names.fuzzy_match(_spelt(s, d).select(F.col("district").alias("name")), _references(s, d), 60.0, subsets=True))


@query(f"WITH {_MATCHED} SELECT state, ref, count(*) AS originals, string_agg(DISTINCT district, ',' ORDER BY district) AS names FROM matched WHERE ref IS NOT NULL GROUP BY state, ref")
def match_report(s, d):
    return names.match_report(_matched(s, d), ["state"], "district", "ref")


@query(f"WITH {_MATCHED} SELECT count(ref) AS matched, count(*) - count(ref) AS unmatched FROM matched")
def match_counts(s, d):
    return names.match_counts(_matched(s, d), "ref")


@query(f"WITH {_MATCHED}, c AS (SELECT spelt.district AS before, ref AS after, count(*) AS rows FROM spelt JOIN matched USING (state, district) WHERE ref IS NOT NULL AND ref <> spelt.district GROUP BY 1, 2) SELECT before, after, rows, round(greatest({_ratio_sql('lower(before)', 'lower(after)')}, {_ratio_sql(_SORTED.format('lower(before)'), _SORTED.format('lower(after)'))}), 6) AS score FROM c")
def change_log(s, d):
    pairs = _spelt(s, d).join(_matched(s, d).where("ref IS NOT NULL").select("state", "district", "ref"), ["state", "district"])
    return R(names.change_log(pairs.select(F.col("district").alias("before"), F.col("ref").alias("after")), "before", "after"))


@query("SELECT c_custkey, CASE n_name WHEN 'NATION_2' THEN 'Two' WHEN 'NATION_3' THEN 'Three' ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def flat_overrides(s, d):
    book = s.createDataFrame([("NATION_2", "Two"), ("NATION_3", "Three")], "old string, new string")
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return names.apply_overrides(rows.select("c_custkey", F.col("n_name").alias("name")), book, "name")


@query("SELECT count(DISTINCT c_mktsegment) FILTER (c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')) AS values_found, count(*) FILTER (c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')) AS rows_changed FROM customer")
def remap_counts(s, d):
    book = s.createDataFrame([("HOUSEHOLD", "Home"), ("MACHINERY", "Industry"), ("BUILDING", "BUILDING"), ("none such", "x")], "old string, new string")
    return names.remap(table(s, d, "customer").select(F.col("c_mktsegment").alias("segment")), book, "segment")[1]


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)")
def canonical_rows(s, d):
    nation = table(s, d, "nation").select("n_nationkey", "n_name")
    rows = table(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    listed = table(s, d, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return names.keep_canonical(rows, "n_name", listed)


@query("SELECT count(*) AS before, count(*) FILTER (l_quantity > 10) AS after, count(*) FILTER (l_quantity <= 10 OR l_quantity IS NULL) AS removed FROM lineitem")
def guarded_step(s, d):
    """Rows before and after a cleaning step, which may only remove some."""
    rows = table(s, d, "lineitem").select("l_quantity")
    found = quality.guard_counts(rows, rows.where("l_quantity > 10"))
    return s.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query(f"WITH {ENROL}, c AS (SELECT DISTINCT r_name AS state, n_name AS district FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0), e AS (SELECT DISTINCT state, district FROM enrol) SELECT 'customers' AS \"table\", count(*) AS pairs FROM e UNION ALL SELECT 'suppliers', count(*) FROM c UNION ALL SELECT 'all', count(*) FROM (FROM e UNION FROM c)")
def inventory_pair_counts(s, d):
    places = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("state"), F.col("n_name").alias("district"))
    suppliers = table(s, d, "supplier").where("s_acctbal > 0").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return names.pair_counts({"customers": enrol(s, d), "suppliers": suppliers})


_DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'not a day' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS day FROM orders"


def _days(s, d):
    day = F.when(F.col("o_orderkey") % 7 == 0, "not a day").otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return table(s, d, "orders").select("o_orderkey", day.alias("day"))


@query(f"SELECT o_orderkey, CAST(try_strptime(day, '%d-%m-%Y') AS DATE) AS day FROM ({_DATES})")
def coerced_dates(s, d):
    return quality.coerce_date(_days(s, d), "day", "dd-MM-yyyy")


@query(f"SELECT count(*) AS rows, count(*) FILTER (try_strptime(day, '%d-%m-%Y') IS NULL) AS invalid FROM ({_DATES})")
def invalid_dates(s, d):
    return quality.invalid_dates(_days(s, d), "day", "dd-MM-yyyy")


_HOLES = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events"


def _holes(s, d):
    return table(s, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))


@query(f"SELECT event_id, coalesce(event_type, 'Unknown') AS event_type, round(coalesce(value, 0), 6) AS value FROM ({_HOLES})")
def missing_filled(s, d):
    return R(quality.handle_missing(_holes(s, d), "fill"))


@query(f"SELECT event_id, event_type, round(value, 6) AS value FROM ({_HOLES}) WHERE value IS NOT NULL")
def missing_dropped(s, d):
    return R(quality.handle_missing(_holes(s, d), "drop", ["event_type"]))


@query(f"WITH h AS ({_HOLES}) SELECT event_id, round(coalesce(value, (SELECT median(value) FROM h)), 6) AS value FROM h")
def median_filled(s, d):
    return R(features.fill_median(_holes(s, d).select("event_id", "value"), ["value"]))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 0 ELSE round(value, 6) END AS value FROM events")
def finite_features(s, d):
    """Infinities and NaN as 0."""
    key = F.col("event_id") % 4
    broken = F.when(key == 0, F.lit(float("nan"))).when(key == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return R(features.clean_features(table(s, d, "events").select("event_id", broken.alias("value")), ["value"]))


@query("SELECT c_custkey, n_name AS district FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0")
def named_regions(s, d):
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey") % 3
    blank = F.when(key == 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).when(key == 1, "   ")
    return features.named_regions(rows.select("c_custkey", blank.alias("district")), "district")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def equal_values(s, d):
    return features.where_equal(table(s, d, "lineitem"), l_returnflag="R", l_linestatus="F").select("l_orderkey", "l_linenumber")
