"""Queries of this subpackage and, where SQL can say the same over whole tables, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import ann, bpe, chat, crosstok, exact, maxent, minhash, mixing, separators, toxicity, variants, wordbpe, wrappers
from cuelake.llm.common import documents
from cuelake.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


ESCAPE_SQL = r"regexp_replace({}, '(<)(\\*)(/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])', '\1\4\\\2\5\3\6', 'g')"


@query("op1_prefix_targets", f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 7 + length({ESCAPE_SQL.format('text')}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 0
         ELSE 15 + length({ESCAPE_SQL.format('role')}) END AS chars FROM turns),
placed AS (
  SELECT *, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_all
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR n = n_all) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id""")
def op1(spark, sf):
    planted = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                        "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    given = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.format_digests(given.unionByName(planted))


@query("op3_digest_index", f"""
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM normal WINDOW g AS (PARTITION BY t)""")
def op3(spark, sf):
    marks = exact.mark_copies(documents(spark, sf), exact.new_index(spark))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_curriculum_mix", r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS tier
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][tier + 1] AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM sources),
filled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS fill
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, tier, least(cap, max(fill) OVER () * weight) AS target FROM filled),
placed AS (
  SELECT s.*, t.source_size, t.tier, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size
                 + greatest(0, least(size, words % source_size - before)) END AS taken FROM placed),
shared AS (
  SELECT *, least(1.0::DOUBLE, CAST(before AS DOUBLE) / CAST(words AS DOUBLE)) AS share,
         [1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE][tier + 1] AS w, [-1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE][tier + 1] AS slope FROM taken)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN 2.0 * share / (w + sqrt(greatest(0.0, w * w + 2.0 * slope * share))) END AS first_position
FROM shared""")
def op6(spark, sf):
    return mixing.mix_totals(documents(spark, sf))


@query("op10_rank_queue_bpe")
def op10(spark, sf):
    return bpe.token_digests(documents(spark, sf), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


@query("op7_crf_toxicity")
def op7(spark, sf):
    return toxicity.document_scores(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op2_multi_index_hamming")
def op2(spark, sf):
    return minhash.near_duplicates(documents(spark, sf))


@query("op9_hashed_maxent")
def op9(spark, sf):
    return maxent.language_scores(documents(spark, sf))


@query("op8_multiprobe_lsh")
def op8(spark, sf):
    return ann.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@query("op4_separator_scan")
def op4(spark, sf):
    path = scratch_path(spark, "flat-tokens")
    separators.write_token_files(documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    counts = separators.document_tokens(separators.token_blocks(spark, path))
    shard = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return counts.select(shard.alias("shard"), "doc_no", "first_token", "n_tokens", "ended")


@query("op5_wrapper_text")
def op5(spark, sf):
    return wrappers.main_texts(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op11_hash_alignment")
def op11(spark, sf):
    return crosstok.group_digests(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_sorted_list_variants")
def op12(spark, sf):
    return variants.spelling_variants(documents(spark, sf))


@query("op13_heap_bpe")
def op13(spark, sf):
    return wordbpe.token_digests(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)
