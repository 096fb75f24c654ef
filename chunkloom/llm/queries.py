"""One query for each corpus operator, over its whole table, with the parameters of
its contract; and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .balltree import top_k
from .common import crc_of_id, read_table
from .exact_dedup import exact_dedup
from .langid import identify
from .mixing import SCHEDULES, WEIGHTS, mix
from .packing import pack
from .quality import classify
from .simhash import near_duplicates
from .tokenfile import round_trip
from .urls import PATTERNS, host_rule, judge_urls

#: Host rules of the URL contract.
HOST_RULES = (
    host_rule("block", "com/en/"),
    host_rule("allow", "example.com/en/7"),
    host_rule("allow", "net/de/"),
    host_rule("block", "example.net/de/8"),
    host_rule("block", "org/es/"),
)


def op1_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op2_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), [*HOST_RULES, *PATTERNS])


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("row_id")


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op8_cross_parsing_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = identify(read_table(spark, sf_dir, "documents"))
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ball_tree_topk,
        op2_rule_ensemble_quality,
        op3_simhash_near_dedup,
        op4_url_rules,
        op5_curriculum_mix,
        op6_exact_dedup,
        op7_nnls_packing,
        op8_cross_parsing_langid,
        op9_token_files,
        op10_license_scan,
    )
}

_TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


def _url_sql() -> str:
    def fits(r):
        return f"regexp_matches(host || path, '{r.pattern.replace(chr(39), chr(39) * 2)}')"

    ranked = sorted([*HOST_RULES, *PATTERNS], key=lambda r: (-r.rank, r.name or ""))
    named = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ranked if r.name)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ranked)
    return f"""
WITH cut AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path, CASE {named} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM cut"""


def _mix_sql(documents: str = "documents") -> str:
    n = len(WEIGHTS)
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    r0 = " ".join(f"WHEN {i} THEN CAST({k[0][1]} AS DOUBLE)" for i, k in enumerate(SCHEDULES))
    r1 = " ".join(f"WHEN {i} THEN CAST({k[1][1]} AS DOUBLE)" for i, k in enumerate(SCHEDULES))
    return f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM {documents}),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source),
capped AS (
  SELECT *, CASE nth % {n} {weight} END AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM totals),
levels AS (
  SELECT *, cap / weight AS ratio,
    ((SELECT sum(source_size) FROM totals) - (sum(cap) OVER w - cap))
      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW w AS (ORDER BY cap / weight, nth)),
targets AS (
  SELECT source, source_size, nth,
    least(cap, coalesce((SELECT max(level) FROM levels WHERE level <= ratio), 0.0) * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.nth, CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, CAST({' + '.join(f'greatest(0, least(size, wanted - before - {e} * source_size))' for e in range(3))} AS BIGINT) AS taken,
    before / target AS share, CASE nth % {n} {r0} END AS r0, CASE nth % {n} {r1} END AS r1
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE WHEN share <= 0 THEN 0.0 WHEN share <= 1
    THEN 0.0 + 2.0 * (share - 0.0) / (r0 + sqrt(r0 * r0 + 2 * (r1 - r0) * (share - 0.0))) ELSE 1.0 END, 9) END AS position
FROM took"""


ORACLE: dict[str, str] = {
    "op1_ball_tree_topk": _TOPK_SQL,
    "op4_url_rules": _url_sql(),
    "op5_curriculum_mix": _mix_sql(),
    "op6_exact_dedup": """
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_license_scan": licenses.oracle(),
}
