"""The registered queries of this subpackage: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common, jaccard, langid, lm, mixing, neardup, packing, repeats, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a document: sources in the flattest mix that passes none more than twice as often as another."""
    found = mixing.mixed(common.table(spark, sf_dir, "documents"), most_passes=2.0)
    return found.select("doc_id", "source", "epoch", "mix_weight", "n_tokens", "mix_block")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its score, from labels outside the held-out fifth, and its worst sentence."""
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of each vector whose id is divisible by 20, ties to smaller ids."""
    rows = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the likeliest language, learned outside the held-out fifth."""
    return langid.language_id(common.table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its links at a cosine of 0.95 or more and its component."""
    return neardup.near_duplicates(common.table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: log10 probabilities by tokens alone and by the mixed bigram model (the README has figures for trigrams)."""
    return lm.deleted_interpolation(common.table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its four-word shingles and the component that links at 0.85 make."""
    return jaccard.similar(common.table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in sequences of at most 4096 tokens."""
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what its 50-byte strings that also start in a smaller doc_id take away."""
    return repeats.suffix_array_dedup(common.table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what its windows of 20 words that start earlier take away."""
    return repeats.substring_dedup(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_language_id": op4_language_id,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Of what SQL can express over whole tables; the rest is tested against brute-force versions.
VALID = "vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_exact_top_k": f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {VALID})
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.v, b.v) AS score FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0))
WHERE rank <= 20""",
    "op5_embedding_near_dedup": f"""
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE {VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a AS id, b AS r FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.vec_id, coalesce(n, 0) AS n_links, least(coalesce(m, d.vec_id), d.vec_id) AS component_id, least(coalesce(m, d.vec_id), d.vec_id) = d.vec_id AS kept
FROM embeddings AS d LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = d.vec_id LEFT JOIN (SELECT id, min(r) AS m FROM reach GROUP BY id) ON id = d.vec_id""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) < 4 THEN list_filter([array_to_string(l, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT a AS id, b AS r FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(m, d.doc_id), d.doc_id) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(r) AS m FROM reach GROUP BY id) ON id = d.doc_id""",
    "op9_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * 549) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 500)) AS o FROM d)),
w AS (SELECT doc_id, o + p AS p, md5_number(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, o, h, unnest(range(0, least(500, len(h) // 2 - 49))) AS p FROM pieces)),
m AS (SELECT s, min(doc_id) AS lowest FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS after, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN m USING (s) WHERE doc_id > lowest),
gone AS (SELECT doc_id, sum(least(50, coalesce(after - p, 50))) AS n, count(*) FILTER (before IS NULL OR p - before > 50) AS spans FROM r GROUP BY doc_id),
gaps AS (SELECT doc_id, coalesce(before + 50, 0) AS lo, p AS hi FROM r WHERE before IS NULL OR p - before > 50 UNION ALL SELECT doc_id, max(p) + 50, NULL FROM r GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN hi IS NULL THEN substr(h, 2 * lo + 1) ELSE substr(h, 2 * lo + 1, 2 * (hi - lo)) END, '' ORDER BY lo) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS l FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(l[p:p + 19], ' ')) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS p FROM w)),
repeats AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p + j) AS g FROM repeats, (SELECT unnest(range(0, 20)) AS j) GROUP BY doc_id)
SELECT w.doc_id, len(l) AS n_words, len(coalesce(g, [])) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(l, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id""",
}
