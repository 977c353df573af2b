"""One query for each corpus operator, over its whole table with production parameters, and SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolloom.llm import bpe, embed_dedup, fingerprint, langid, license_scan, line_dedup, mixing, near_dedup, pii, substring
from rolloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


@_query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link(read(spark, sf_dir, "embeddings"))


ORACLE["op2_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(u, v) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = c.u LEFT JOIN n ON vec_id = n.u"""


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"))


ORACLE["op3_line_dedup"] = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
t AS (SELECT doc_id, source, line, i, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
b AS (SELECT k, min(doc_id) AS first FROM t WHERE k <> '' GROUP BY k
      HAVING count(DISTINCT source) + CAST(count(*) > count(source) AS INT) >= 8),
m AS (SELECT t.*, coalesce(doc_id <> first, false) AS gone FROM t LEFT JOIN b USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang is the declared language, source the host; documents have no address."""
    return langid.identify(read(spark, sf_dir, "documents")).drop("th")


@_query
def op4_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.of_pages(read(spark, sf_dir, "pages")).drop("th")


@_query
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(read(spark, sf_dir, "documents"))


@_query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept marks one document of each component of near copies, none where all are parts of larger documents."""
    return near_dedup.link(read(spark, sf_dir, "documents")).drop("th")


@_query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"))


@_query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


@_query
def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


ORACLE["op9_substring"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t),
s AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM p),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g WHERE least < doc_id),
x AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
k AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone FROM t LEFT JOIN x USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]), ' ')) AS kept_sha256
FROM k"""


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


ORACLE["op10_license_scan"] = license_scan.oracle()
