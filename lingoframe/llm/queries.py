"""The queries of this subpackage over the driver tables, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoframe.llm import aliases, attention, bpe, compression, fixity, quality, shards, simhash, suffixes, tokenstore


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged and lost records of a drill replica of all pages, found by descending the Merkle trees."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    primary = fixity.written(fixity.warc_records(pages), "primary")
    return fixity.audit(primary, fixity.damaged(primary, pages))


_BLOCK_SQL = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR)
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(h) AS VARCHAR)
  || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10)"""

OP1_SQL = f"""
WITH marked AS (SELECT *, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark FROM pages),
good AS (SELECT page_id, mark, {_BLOCK_SQL} AS block FROM (SELECT *, html AS h FROM marked)),
bad AS (SELECT page_id, sha256({_BLOCK_SQL}) AS digest FROM (SELECT *, html || '?' AS h FROM marked WHERE mark IN ('07', '70'))),
records AS (
  SELECT CAST(page_id // {fixity.FILE_RECORDS} AS BIGINT) AS file, page_id, mark, CAST(strlen(block) AS BIGINT) AS length, sha256(block) AS digest FROM good),
placed AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS start FROM records)
SELECT file, start, page_id, length, p.digest AS expected, bad.digest AS found,
       CASE WHEN bad.digest IS NULL THEN 'missing' ELSE 'corrupt' END AS status
FROM placed p LEFT JOIN bad USING (page_id) WHERE mark IN ('07', '70', '0d', 'd0')
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again and compared."""
    return bpe.encode(_documents(spark, sf_dir), keep=["doc_id"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard; documents of the same text stay together."""
    rows = _documents(spark, sf_dir).select("doc_id", F.md5("text").alias("group_key"), F.octet_length("text").cast("long").alias("n_bytes"))
    return shards.assign(rows, "group_key", "n_bytes")


OP3_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, md5(text) AS group_key, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents),
groups_ AS (SELECT group_key, CAST(sum(n_bytes) AS BIGINT) AS size FROM rows_ GROUP BY group_key),
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, group_key) AS i FROM groups_),
step AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(range({shards.SHARDS}), lambda x: CAST(0 AS BIGINT)) AS loads, CAST(0 AS BIGINT) AS shard
  UNION ALL
  SELECT r.i,
         list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + r.size ELSE x END),
         CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT)
  FROM step s JOIN ranked r ON r.i = s.i + 1)
SELECT doc_id, group_key, n_bytes, size AS group_size, CAST(shard AS INTEGER) AS shard
FROM rows_ JOIN ranked USING (group_key) JOIN step USING (i)
"""

def op4_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, shares and posterior, and whether it stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(_documents(spark, sf_dir), labels, keep=["doc_id"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of each contaminated document with each benchmark text."""
    return suffixes.matches(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the groups of near duplicates, and which one of each stays."""
    return simhash.duplicate_groups(_documents(spark, sf_dir)).select("doc_id", "group_id", "is_kept")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of every document's compressed token ids, written to the shared folder: its index and where it lies."""
    return tokenstore.stored(_documents(spark, sf_dir))


def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's compression ratios and whether it stays."""
    return compression.compression_bands(_documents(spark, sf_dir), keep=["doc_id"])


def op9_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's component of aliases and whether its URL is blocked."""
    return aliases.url_decisions(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likelihood under a model trained on all of them."""
    return attention.language_model_scores(_documents(spark, sf_dir))


def _customary_sql(url: str) -> str:
    for pattern, new in aliases.CUSTOMARY:
        url = f"regexp_replace({url}, '{pattern}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return url


def _any_sql(url: str, rules: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({url}, '{r}')" for r in rules) + ")"


def _link_sql(pattern: str) -> str:
    return f"regexp_extract(html, '{pattern.replace(chr(39), chr(39) * 2)}', 1)"


def _resolved_sql(link: str) -> str:
    scheme = "[A-Za-z][-+.A-Za-z0-9]*:"
    site = f"regexp_extract(url, '^{scheme}//[^/?#]*')"
    bare = "regexp_replace(url, '[?#].*$', '')"
    folder = f"coalesce(nullif(regexp_extract({bare}[length({site}) + 1:], '^.*/'), ''), '/')"
    path = f"CASE WHEN starts_with({link}, '/') THEN regexp_extract({link}, '^[^?#]*') ELSE {folder} || regexp_extract({link}, '^[^?#]*') END"
    parts = f"list_prepend('', string_split(regexp_replace(regexp_replace({path}, '^/', ''), '(^|/)([.][.]?)$', '\\1\\2/'), '/'))"
    short = f"list_reduce({parts}, lambda a, b: CASE b WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || b END)"
    return f"""CASE WHEN {link} = '' OR regexp_matches({link}, '^{scheme}') OR {site} = '' THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract(url, '^[^:]*:') || {link}
    WHEN starts_with({link}, '?') THEN {bare} || {link} WHEN starts_with({link}, '#') THEN regexp_replace(url, '#.*$', '') || {link} ELSE {site} || {short} || regexp_extract({link}, '[?#].*$') END"""


OP9_SQL = f"""
WITH RECURSIVE written_ AS (
  SELECT url, replace(trim(coalesce(nullif({_link_sql(aliases.CANONICAL[0])}, ''), {_link_sql(aliases.CANONICAL[1])})), '&amp;', '&') AS canon, replace(trim({_link_sql(aliases.REFRESH)}), '&amp;', '&') AS refresh FROM pages WHERE url IS NOT NULL),
targets AS (
  SELECT url, {_customary_sql("url")} AS usual, {_resolved_sql("canon")} AS canon, {_resolved_sql("refresh")} AS refresh FROM written_),
edges AS (
  SELECT url AS src, usual AS dst FROM targets UNION SELECT url, canon FROM targets UNION SELECT url, refresh FROM targets
  UNION SELECT canon, {_customary_sql("canon")} FROM targets UNION SELECT refresh, {_customary_sql("refresh")} FROM targets),
good AS (SELECT * FROM edges WHERE src <> '' AND dst <> '' AND src <> dst),
links AS (SELECT src, dst FROM good UNION SELECT dst, src FROM good),
reach AS (SELECT src AS node, src AS other FROM links UNION SELECT r.node, l.dst FROM reach r JOIN links l ON r.other = l.src),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
blocked AS (
  SELECT root, min(node) AS by_ FROM roots WHERE {_any_sql("node", aliases.BLOCK)} AND NOT {_any_sql("node", aliases.ALLOW)} GROUP BY root),
rows_ AS (SELECT page_id, url, {_any_sql("url", aliases.BLOCK)} AS b, {_any_sql("url", aliases.ALLOW)} AS a FROM pages),
placed AS (
  SELECT page_id, url, a, b, root, CASE WHEN root IS NOT NULL THEN by_ WHEN b AND NOT a THEN url END AS by_
  FROM rows_ LEFT JOIN roots ON url = node LEFT JOIN blocked USING (root))
SELECT page_id, url, coalesce(root, url) AS component,
       CASE WHEN a THEN 'allowed' WHEN b THEN 'blocked' WHEN by_ IS NOT NULL THEN 'alias_blocked' ELSE 'clear' END AS decision, by_ AS blocked_by
FROM placed
"""

QUERIES = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_quality_bayes": op4_quality_bayes,
    "op5_decontamination": op5_decontamination,
    "op6_simhash_groups": op6_simhash_groups,
    "op7_token_store": op7_token_store,
    "op8_compression_bands": op8_compression_bands,
    "op9_url_aliases": op9_url_aliases,
    "op10_lm_scores": op10_lm_scores,
}
ORACLES = {"op1_warc_fixity": OP1_SQL, "op3_sharding": OP3_SQL, "op9_url_aliases": OP9_SQL}
