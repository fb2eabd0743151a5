"""Registered queries: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontaminate, filter_audit, jaccard_join, language, licenses, line_rules, packing, resampling, secrets_scan, sharding,
    simhash, token_files, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"))


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(documents(spark, sf_dir), n=4, percent=85)


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, good: of good quality and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


@query("op3_importance_resampling")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), good_labels(spark, sf_dir))


# Lines are normalised as in the operator; verdict by documents per (host, line).
OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
tri AS (SELECT doc_id, p, words[p] || ' ' || words[p+1] || ' ' || words[p+2] AS run FROM w, unnest(range(1, len(words) - 1)) AS t(p)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, run) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM again) GROUP BY doc_id),
ln AS (SELECT doc_id, host, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
       FROM (SELECT doc_id, host, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
freq AS (SELECT host, norm FROM ln GROUP BY host, norm HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS n FROM ln JOIN freq USING (host, norm) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 2 * removed_words <= n_words AS kept FROM b
""".replace("\\\\", "\\")


@query("op4_line_frequency_rules", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(documents(spark, sf_dir), host="source", max_documents=20)


@query("op5_prefix_sum_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


# All word windows of the documents against those of the items, by plain joins.
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(10, len(words)) AS n,
         array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS run
  FROM i, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS t(p) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, p, s.n, array_to_string(words[p:p + s.n - 1], ' ') AS run
  FROM w, sizes s, unnest(range(1, len(words) - s.n + 2)) AS t(p) WHERE len(words) >= s.n),
hit AS (SELECT dw.doc_id, dw.p, dw.n, win.item_id FROM dw JOIN win ON dw.run = win.run AND dw.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_ecoc_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    # crc32 of a null id's text is null: such a row is not held out
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", fold.alias("held_out"))
    model = language.learn(docs.where(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "text", "held_out"), model)


@query("op9_bit_packed_tokens")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), tokenizer="word_bpe_49k.json", end_id=2)


@query("op10_markov_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    found = secrets_scan.find_secrets(docs, secrets_scan.train(docs))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets_scan.KINDS.index(kind))).cast("long")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(secrets_scan.as_text(F.col("base")), 256).alias("base_sha256"),
                        secrets_scan.as_text(F.col("spans")).alias("spans"))


@query("op11_simhash_neardup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), n=4, bits=4)


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the operator's deviation is a decimal; a long holds it up to about 1e8 rows of unit vectors
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), most=32)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


# Documents counted by part and set of failing filters, then read off in every order.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
dup AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
             + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 3 * length(w.t) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS mask
      FROM w JOIN dup ON w.t = dup.t LEFT JOIN lab ON w.doc_id = lab.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS pre FROM o, unnest(range(1, 6)) AS t(step)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & CAST(pre + bit AS INT) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & CAST(pre AS INT) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & CAST(pre AS INT) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & CAST(pre AS INT) = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & CAST(pre AS INT) = 0 AND mask & bit <> 0 THEN x ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
