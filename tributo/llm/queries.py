"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_count import token_counts
from .common import prepared, read
from .decontaminate import contamination
from .filter_audit import audit
from .lm_score import lm_scores
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality import quality_scores
from .repeats import remove_repeats
from .secrets import scan_secrets
from .simhash import simhash_duplicates
from .top_k import embeddings_top_k
from .toxicity import toxicity_scores
from .whitening import whiten


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    match = F.when(~F.col("contaminated"), "none").when(F.col("reparameterised"), "reparameterised").otherwise("exact")
    return found.select("doc_id", "contaminated", "n_windows", F.array_join(F.col("items").cast("array<string>"), ",").alias("item_ids"), match.alias("match"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), length=200)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2, threshold=80)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary())


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_top_k(read(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read(spark, sf_dir, "documents"), k=3, radius=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    run = lambda f: lambda spark, sf_dir: f(prepared(spark), sf_dir)
    own = (op1_quality, op2_decontaminate, op3_toxicity, op4_repeats, op5_secrets, op6_near_duplicates, op7_lm_score, op8_token_counts, op9_top_k, op10_mixing, op11_filter_audit, op12_whitening, op13_simhash)
    return {f.__name__: run(f) for f in own}


def oracle_sql() -> dict[str, str]:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "op6_near_duplicates": f"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
            ), s AS (
                SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
            ), e AS (SELECT doc_id, unnest(s) AS e FROM s), pair AS (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2
            ), link AS (
                SELECT x, y FROM pair JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)
            ), edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link), reach(d, r) AS (
                SELECT doc_id, doc_id FROM s UNION SELECT edge.y, reach.r FROM reach JOIN edge ON edge.x = reach.d
            )
            SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
            FROM s JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY 1) m ON m.d = s.doc_id
        """,
        "op9_top_k": """
            WITH whole AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scored AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN len(q.v) = 0 OR len(c.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END AS BIGINT) AS score
                FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
            ), ranked AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
            )
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
        """,
        "op11_filter_audit": """
            WITH words AS (
                SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
            ), failed AS (
                SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                       100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c,
                       regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS e FROM words
            ), marked AS (
                SELECT f.part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
                       || CASE WHEN e THEN 'E' ELSE '' END AS fails, coalesce(l.good, FALSE) AS good, coalesce(l.bad, FALSE) AS bad
                FROM failed f LEFT JOIN (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS bad FROM labels GROUP BY 1) l ON l.doc_id = f.doc_id
            ), kinds AS (
                SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM marked GROUP BY ALL
            ), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
                SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letter p, letter q, letter r, letter s, letter t
                WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
            ), steps AS (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders), told AS (
                SELECT part, o AS filter_order, step, substr(o, step, 1) AS x, n, good, bad, contains(fails, substr(o, step, 1)) AS fail,
                       len(list_filter(string_split(substr(o, 1, step - 1), ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone, fails = substr(o, step, 1) AS sole
                FROM kinds, steps
            ), each AS (
                SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
                       coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
                       coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (fail AND NOT gone), 0) AS toxic_lost
                FROM told GROUP BY ALL
            )
            SELECT part, filter_order, step, x AS filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
                   CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
                   CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
            FROM each
        """,
    }
