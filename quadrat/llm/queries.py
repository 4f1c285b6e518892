"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import ann, collocations, decontaminate, filters, lines, mixing, packing, pii, quality, sharding, simhash, substrings, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, tokens and domain probabilities of every document."""
    rated = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    shares = [F.element_at("posterior", i + 1).alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)]
    return rated.select("doc_id", "tokens", *shares, "rate", mixing.copies(F.col("rate"), "doc_id").alias("copies"))


def op2_small_world_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, by inner product."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    found = lines.fuzzy_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 35 words that occur twice."""
    return substrings.drop_repeats(_table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest scores of every twentieth vector, by integer inner product."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, cut from one Hilbert curve through source, language, length and id."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.size("secrets").cast("long").alias("n_secrets"), pii.written(F.col("secrets")).alias("secrets"),
        (F.size("spans") + F.size("secrets")).cast("long").alias("n_found"),
    )


def op9_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), 2048)


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = quality.quality_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_best_first_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words keep together best."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), top=2000, min_count=100, longest=5)


def op12_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ten words of benchmark items."""
    return decontaminate.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return filters.interaction_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_QUERIES = (
    op1_soft_membership_mixing,
    op2_small_world_neighbours,
    op3_fuzzy_lines,
    op4_difference_cover,
    op5_term_at_a_time,
    op6_hilbert_shards,
    op7_simhash_near_dedup,
    op8_weak_supervision_pii,
    op9_min_bin_slack,
    op10_subword_quality,
    op11_best_first_phrases,
    op12_benchmark_windows,
    op13_filter_interactions,
)

#: Integer inner products of every twentieth vector with all others.
_OP5 = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: All windows of 35 words, counted.
_OP4 = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS passage FROM starts
), repeated AS (
  SELECT doc_id, i FROM windows WHERE passage IN (SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM repeated) GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, words.w, gone.gone,
    CASE WHEN gone.gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone.gone, j)), lambda j: w[j]) END AS k
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

#: All phrases of one to five words, counted; every cut of every candidate.
_OP11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), starts AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m
), f AS (
  SELECT lang, list_slice(w, i, i + m - 1) AS p, m, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT f.lang, f.p, f.a, f.m, unnest(range(1, f.m)) AS k FROM f WHERE f.m >= 2
), scored AS (
  SELECT c.lang, c.p, c.m, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.k) JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, c.k + 1, c.m)
), lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM scored) WHERE o = 1
), inside AS (
  SELECT DISTINCT f.lang, list_slice(f.p, i, j) AS p, f.a FROM f, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) WHERE f.m >= 2 AND i <= j AND j <= f.m AND j - i + 1 < f.m
), kept AS (
  SELECT * FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = lowest.lang AND inside.p = lowest.p AND 100 * inside.a >= 100 * lowest.a)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

#: Windows of ten words, or of all words of shorter items, compared as texts.
_OP12 = """
WITH folded AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), cut AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS passage FROM cut
), starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n
), hits AS (
  SELECT r, i, starts.n, item_id FROM (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS passage FROM starts) starts JOIN wanted ON starts.n = wanted.n AND starts.passage = wanted.passage
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

#: Failures of each document, then every order one filter at a time.
_OP13 = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
  SELECT t, min(doc_id) AS first FROM docs GROUP BY t
), words AS (
  SELECT docs.*, first, regexp_extract_all(docs.t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs JOIN firsts ON docs.t = firsts.t
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)
  ] AS f
  FROM words LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own FROM orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails,
    len(list_filter(range(1, step), lambda k: f[instr('ABCDE', filter_order[k])])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS n_failed
  FROM cells, steps
), summed AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND n_failed = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM counted GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_difference_cover": _OP4, "op5_term_at_a_time": _OP5, "op11_best_first_phrases": _OP11, "op12_benchmark_windows": _OP12, "op13_filter_interactions": _OP13}
