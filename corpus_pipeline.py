"""From raw documents to token ids: toxicity, exact and near dedup, mixing, BPE. Each stage is written and read again.

Defined cases: a null or empty text is a clean document without words. All such texts are equal, so the one with the largest doc_id stays (a null id is
the smallest); it has no size, so the mix takes no copy of it. Repeated rows count as copies. Rows of a null source form a source of their own. An
empty table gives no rows. The last stage returns doc_id, lang and source with the token ids; the others the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import bpe, exact, minhash, mixing, toxicity
from cuelake.llm.common import documents, stage
from cuelake.llm.queries import TOKENIZER
from cuelake.plans.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    ship(spark)
    return exact.drop_copies(docs, exact.new_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate groups, the one with the smallest doc_id."""
    ship(spark)
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row per copy that the source's target asks for."""
    ship(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests that prove the round trip."""
    ship(spark)
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    both = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path, pattern, keep=["doc_id", "lang", "source"])
    return both.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies),
          ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", tokens)]

#: Toxicity, MinHash and BPE cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
