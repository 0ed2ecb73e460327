"""The queries of this folder, as (spark, sf_dir) -> DataFrame, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, fim, html_extract, lm_score, mixing, pii, quality, simhash_dedup, substring_dedup, token_align, toxicity, warc
from .common import shared_path, table, written


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, a row each. Null and empty texts hold none; see contaminated() for ties and repeated rows."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document. A null text counts as empty: no spans, and the digest of the empty string."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; "" for a null or empty page."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled. A null html is an empty payload; rows that share the smallest page_id of a payload are all responses."""
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(written(warc.read_records(spark, path, with_payload=False), "records"))
    r = F.col("response")
    refers = F.regexp_extract(r["refers_to"], r"urn:page:(-?\d+)", 1)
    return captures.select(
        F.col("metadata.page_id").alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"),
        r["kind"].alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; an empty or null text has the score of no feature, and a null id is held out."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated text. Null and empty texts lose none; rows without an id take no part."""
    return substring_dedup.documents_with_repeats(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes. Null texts have size 0 and are never taken; a null source comes last."""
    mixed = mixing.mix_sources(mixing.word_counts(table(spark, sf_dir, "documents")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; empty and null texts are scored too, and a null id is held out."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and blank texts have fingerprint zero."""
    return simhash_dedup.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; null, zero and non-finite vectors link with nothing."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of every document under the network and under word counts; a null text is its end alone, and a null id is held out."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers in every document; null and empty texts have none."""
    return token_align.alignment(table(spark, sf_dir, "documents"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put together for filling in; a null text is empty and stays plain."""
    return fim.fim_digests(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_html, op4_warc, op5_toxicity, op6_line_dedup, op7_mix, op8_quality, op9_simhash, op10_embeddings, op11_lm_score, op12_token_align, op13_fim)}


#: Five hex digits of a SHA-1 are four digits of base 32.
OP4 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
  v AS (SELECT *, list_transform(range(32), lambda i: (CAST('0x' || x[1 + 5 * (i // 4) : 5 + 5 * (i // 4)] AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS digits FROM d)
  SELECT page_id, payload_bytes, array_to_string(list_transform(digits, lambda n: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[n + 1]), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM v"""
#: Every pair of vectors, and what can be reached along the links.
OP10 = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), fit AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
  reached AS (SELECT vec_id, vec_id AS c FROM e UNION SELECT b, c FROM reached JOIN links ON a = vec_id),
  n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a), comp AS (SELECT vec_id, min(c) AS c FROM reached GROUP BY vec_id)
  SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM comp LEFT JOIN n USING (vec_id)"""


#: Units as a list, so that cuts are slices of it.
OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
  h AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || x[1 + 8 * i : 8 + 8 * i] AS BIGINT)) AS h, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM d),
  c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
  p AS (SELECT *, array_to_string(u[1 : a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 : n], '') AS suf FROM c)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op10_embeddings": OP10, "op13_fim": OP13}
