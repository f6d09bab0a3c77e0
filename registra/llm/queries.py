"""One query for each operator of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprints, langid, line_dedup, mixing, ngram_join, token_counts, toxicity, urlfilter
from .common import sha256_hex


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _remainder(id_: str, n: int):
    return F.pmod(F.crc32(F.col(id_).cast("string").cast("binary")), F.lit(n))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(_texts(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_texts(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return mixing.mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: A conversation whose texts look like the template's marks.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_windows(chat.format_windows(turns, vocabulary=token_counts.VOCABULARY), in_order=True)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_texts(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark").select("item_id", "text")).withColumnRenamed("id", "doc_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    profiles = langid.learn(docs.filter(_remainder("id", 4) != 2))
    out = langid.predict(docs, profiles)
    return out.select(F.col("id").alias("doc_id"), (_remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.fit(docs, labels.filter(_remainder("id", 5) != 0))
    return toxicity.score(docs, model).select("row.id", "score", "predicted").select(F.col("id").alias("doc_id"), (_remainder("id", 5) == 0).alias("held_out"), "score", "predicted")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), rules).withColumnRenamed("id", "page_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(_texts(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1,
    "op2_line_dedup": op2,
    "op3_mixing": op3,
    "op4_chat_format": op4,
    "op5_fingerprints": op5,
    "op6_decontamination": op6,
    "op7_language_id": op7,
    "op8_toxicity": op8,
    "op9_url_filter": op9,
    "op10_token_counts": op10,
}

_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w)"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE {_SHINGLES},
t AS MATERIALIZED (SELECT doc_id, x FROM (SELECT doc_id, x, count(*) OVER (PARTITION BY x) AS held FROM (SELECT doc_id, unnest(s) AS x FROM s)) WHERE held > 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(root) FROM r WHERE r.id = doc_id) AS component_id FROM s""",
    "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> doc_id AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op6_decontamination": rf"""
WITH {_SHINGLES},
wi AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
si AS (SELECT item_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM wi),
h AS (SELECT doc_id, item_id, count(*) AS n FROM (SELECT doc_id, unnest(s) AS x FROM s) JOIN (SELECT item_id, unnest(s) AS x FROM si) USING (x) GROUP BY ALL)
SELECT doc_id, item_id, len(s)::BIGINT AS n_item, n::BIGINT AS n_shared, n / len(s) AS containment FROM h JOIN si USING (item_id) WHERE n * 100 >= len(s) * 75""",
    "op9_url_filter": r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM p),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
}
