"""Registered queries of the operators, and the SQL counterparts of those that SQL can express.

Each query applies its operator with production parameters to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import bpe, chat, embeddings, license, minhash, mix, negatives, packing, pii, quality, runs, secret, urls
from paperlake.llm.sql import NEGATIVES_SQL, RUNS_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_table(_table(spark, sf_dir, "documents")).drop("found")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled_urls(spark))
    return urls.judged(_table(spark, sf_dir, "pages"), model).withColumn("score", F.round("score", 6))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.pii_table(_table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret.secret_digest(secret.secret_table(_table(spark, sf_dir, "documents")))


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(_table(spark, sf_dir, "documents"), size=4)


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.perspectives(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.withColumn("mask", spans)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return packing.pack_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return runs.run_digest(runs.periodic_runs(docs, text=runs.rewritten(F.col("doc_id"), F.col("text"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_quality, op2_licenses, op3_mix, op4_bpe, op5_urls, op6_vectors, op7_personal_data, op8_secrets,
              op9_near_documents, op10_perspectives, op11_hard_negatives, op12_packing, op13_periodic_runs, pipeline)
}

QUALITY_SQL = """
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], chr(31)) AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) r(k) GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, coalesce('v' || lang, 'n') AS lang, coalesce('v' || source, 'n') AS source,
         CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN rep USING (rid)
), m AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS word_len
  FROM c
), v AS (
  UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, word_len FROM m WHERE NOT base_failed)
  ON symbols, dup_lines, repeats, word_len INTO NAME rate VALUE val
), s AS (
  SELECT lang, source, rate, count(*) AS n,
         val // (1 << greatest(length(bin(val)) - 6, 0)) * (1 << greatest(length(bin(val)) - 6, 0)) AS bucket
  FROM v GROUP BY lang, source, rate, bucket
), lev AS (
  SELECT 1 AS lev, lang, source, rate, bucket, n FROM s
  UNION ALL SELECT 2, lang, '', rate, bucket, sum(n) FROM s GROUP BY lang, rate, bucket
  UNION ALL SELECT 3, '', '', rate, bucket, sum(n) FROM s GROUP BY rate, bucket
), q AS (
  SELECT lev, lang, source, rate, any_value(total) AS n,
         min(bucket) FILTER (upto * 100 >= total * 25) AS low, min(bucket) FILTER (upto * 100 >= total * 75) AS high
  FROM (SELECT *, sum(n) OVER (PARTITION BY lev, lang, source, rate ORDER BY bucket) AS upto,
               sum(n) OVER (PARTITION BY lev, lang, source, rate) AS total FROM lev)
  GROUP BY lev, lang, source, rate
), pick AS (
  SELECT a.lang, a.source, a.rate,
         CASE WHEN a.n >= 50 THEN a.low WHEN b.n >= 50 THEN b.low ELSE c.low END AS low,
         CASE WHEN a.n >= 50 THEN a.high WHEN b.n >= 50 THEN b.high ELSE c.high END AS high
  FROM q a JOIN q b ON b.lev = 2 AND b.lang = a.lang AND b.rate = a.rate
           JOIN q c ON c.lev = 3 AND c.rate = a.rate
  WHERE a.lev = 1
), lim AS (
  SELECT lang, source,
         max(high + greatest((high - low) * 4, 40)) FILTER (rate = 'symbols') AS symbols_max,
         max(high + greatest((high - low) * 4, 400)) FILTER (rate = 'dup_lines') AS dup_lines_max,
         max(high + greatest((high - low) * 4, 250)) FILTER (rate = 'repeats') AS repeats_max,
         max(high + greatest((high - low) * 4, 120)) FILTER (rate = 'word_len') AS word_len_max,
         max(low - greatest((high - low) * 4, 200)) FILTER (rate = 'word_len') AS word_len_min
  FROM pick GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= symbols_max, true) AND coalesce(dup_lines <= dup_lines_max, true)
       AND coalesce(repeats <= repeats_max, true) AND coalesce(word_len <= word_len_max, true)
       AND coalesce(word_len >= word_len_min, true) AS kept
FROM m LEFT JOIN lim USING (lang, source)
"""

MIX_SQL = """
WITH d AS (
  SELECT *, coalesce('v' || source, 'n') AS key,
         coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS tag FROM documents
), s AS (
  SELECT key, sum(length(coalesce(text, ''))) AS chars FROM d GROUP BY key
), r AS (
  SELECT key, CASE WHEN chars > 0 THEN
    (power(CAST(chars AS DOUBLE), 0.7) / sum(power(CAST(chars AS DOUBLE), 0.7)) OVER ())
    * CAST(sum(chars) OVER () AS DOUBLE) / chars ELSE 0.0 END AS rate FROM s
), p AS (
  SELECT key, rate, CAST(greatest(ceil(rate / 16.0), 1) AS INT) AS parts FROM r
), u AS (
  SELECT d.*, rate / parts AS mean, part,
         CAST(CAST('0x' || substr(md5('7|' || tag || '|' || part), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN p USING (key), LATERAL (SELECT unnest(range(1, parts + 1)) AS part)
), steps AS (
  SELECT mean, k, sum(CASE WHEN k = 0 THEN exp(-mean) ELSE exp(k * ln(mean) - mean - lgamma(k + 1)) END)
         OVER (PARTITION BY mean ORDER BY k) AS total
  FROM (SELECT DISTINCT mean FROM u WHERE mean > 0), range(81) t(k)
), n AS (
  SELECT doc_id, text, lang, source, n_chars, part,
         (SELECT count(*) FROM steps WHERE steps.mean = u.mean AND steps.total <= u.u) AS n FROM u
), c AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(sum(n) AS BIGINT) AS n FROM n
  GROUP BY doc_id, text, lang, source, n_chars
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, n)) AS INT) AS copy_no FROM c
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text
  FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (
  SELECT t.*, perspective, CASE WHEN t.conv_id IS NULL THEN CAST(floor(coalesce(turn, -1) / 256) AS BIGINT) ELSE 0 END AS part,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user name=' || replace(regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'),
                '\|(\\*)>', '|\\\1>', 'g'), chr(10), '\n') || '|>' END || chr(10) || text || chr(10) AS seg
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), e AS (
  SELECT *, sum(length(seg)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text) AS upto FROM s
)
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(seg, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg((upto - 1 - length(text)) || ':' || (upto - 1), ',' ORDER BY turn NULLS FIRST, role, text)
         FILTER (role = perspective), '') AS mask
FROM e GROUP BY conv_id, perspective, part
"""

ORACLES: dict[str, str] = {
    "op1_quality": QUALITY_SQL, "op3_mix": MIX_SQL, "op10_perspectives": CHAT_SQL, "op11_hard_negatives": NEGATIVES_SQL,
    "op13_periodic_runs": RUNS_SQL,
}
