"""The registered query of each operator, with its production parameters and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import (
    chat,
    filter_audit,
    language_id,
    mixing,
    packing,
    pieces,
    quality_crf,
    quality_rules,
    simhash,
    target_resample,
    token_counts,
    topk,
    toxicity,
)
from shelfspark.session import scratch_path

#: Where the public tokenizer files are; every executor has the package.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_simhash_near_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_mix_sources")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeat=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op9_sum_of_squares_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, window=2048, end_id=1)


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = quality_rules.assess(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return assessed.select(*base, "n_covered_words", "longest_repeat")


@query("op5_line_field_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_ftrl_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH whole AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank"
  FROM scored
)
SELECT query_id, "rank", vec_id, score FROM placed WHERE "rank" <= 5
"""


@query("op6_exact_top_k", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op2_token_rollups")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are counted and inserted; then every count is revised to include the end-of-document id,
    documents without a token are deleted, and the first batch arrives once more, to no effect."""
    ledger = token_counts.Ledger(spark, scratch_path(spark, "token-ledger"))
    counted = token_counts.document_counts(table(spark, sf_dir, "documents"), {"byte_bpe_50k": TOKENIZER})
    ledger.apply("0001-load", counted)
    known = ledger.current()
    ledger.apply("0002-end-ids", known.withColumn("op", F.lit(token_counts.REVISE)).withColumn("n_tokens", F.col("n_tokens") + 1))
    known = ledger.current()
    ledger.apply("0003-empty", known.filter("n_tokens <= 1").withColumn("op", F.lit(token_counts.DELETE)))
    ledger.apply("0001-load", counted)
    return ledger.totals()


@query("op3_chat_role_repair")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


@query("op13_sentence_pieces")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return encoded.select("doc_id", pieces.digests(F.col("ids"), PIECES).alias("d")).select("doc_id", "d.*")


#: CRC-32 is spelled out byte by byte from its table of remainders, once per distinct word.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS byte, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), remainders AS (
  SELECT list(c ORDER BY byte) AS r FROM steps WHERE k = 8
), doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), doc_counts AS (
  SELECT row_id, word, count(*) AS n FROM (SELECT row_id, unnest(words) AS word FROM doc_words) GROUP BY ALL
), target_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), all_words AS (
  SELECT word FROM doc_counts UNION SELECT word FROM target_words
), spelled AS (
  SELECT word, [CAST('0x' || substr(hex(encode(word)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT) FOR i IN range(1, octet_length(encode(word)) + 1)] AS bytes
  FROM all_words
), bucketed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda c, b: xor(c >> 8, r[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, remainders
), corpus AS (
  SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM doc_counts JOIN bucketed USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM target_words JOIN bucketed USING (word) GROUP BY bucket
), totals AS (
  SELECT CAST(coalesce((SELECT sum(s) FROM corpus), 0) AS DOUBLE) AS all_s, CAST(coalesce((SELECT sum(t) FROM target), 0) AS DOUBLE) AS all_t
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM corpus LEFT JOIN target USING (bucket), totals
), weights AS (
  SELECT row_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM doc_counts JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY row_id
), scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5::DOUBLE)
      / 4294967296))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN weights USING (row_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    (count(*) FILTER (WHERE n_features >= 20) OVER ()) * 10 // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS "rank" FROM placed
"""


@query("op11_target_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return target_resample.resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH plain AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), judged AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(words) < 50,
    'B': 100 * len(list_distinct(words)) < 65 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': plain.doc_id > min(plain.doc_id) OVER (PARTITION BY text)
  } AS f
  FROM plain LEFT JOIN judged USING (doc_id)
), masked AS (
  SELECT part, [f.A, f.B, f.C, f.D, f.E] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), placed AS (
  SELECT o, step, o[step] AS l, [ascii(x) - 64 FOR x IN o[1:step - 1]] AS before FROM orders, range(1, 6) s(step)
), counted AS (
  SELECT part, o, step, l,
    sum(CASE WHEN NOT list_bool_or([false] || [fails[i] FOR i IN before]) AND NOT fails[ascii(l) - 64] THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT list_bool_or([false] || [fails[i] FOR i IN before]) AND fails[ascii(l) - 64] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_bool_or([false] || [fails[i] FOR i IN before]) AND fails[ascii(l) - 64] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[ascii(l) - 64] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT list_bool_or([false] || [fails[i] FOR i IN before]) AND fails[ascii(l) - 64] THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT list_bool_or([false] || [fails[i] FOR i IN before]) AND fails[ascii(l) - 64] THEN toxic ELSE 0 END) AS toxic_lost
  FROM masked, placed GROUP BY ALL
)
SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
