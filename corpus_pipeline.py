"""The corpus pipeline: from raw documents to token ids.

Each stage takes what its predecessor kept, as a written table, and calls one
operator of ``tessera.llm`` on all of it:

1. language ID: a model of the labelled documents; documents in no learned language
   (null, empty, without a letter, or coded no better than letter by letter) go;
2. exact dedup: of equal texts (A-Z lower-cased) the one with the largest id stays;
3. near-dedup: of each group of near copies (sets of five-word shingles, similarity
   0.8 or more) the one with the smallest id stays;
4. decontamination: runs of ten or more words of a ``benchmark`` item (or a whole
   shorter item) are cut out; documents that are mostly such runs go;
5. byte-level BPE: token ids, with digests of the ids and of the bytes they decode to.

The stages between keep the columns of ``documents``; clean documents pass unchanged.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontam, exact, lang_id, minhash
from tessera.llm.common import staged, table
from tessera.llm.queries import RANKS


TEXTS_PER_BATCH = 1000      # whole texts that go to a Python worker at once


def in_small_batches(spark: SparkSession) -> None:
    """The job's own setting: Spark's default of 10,000 whole texts, held by the JVM and
    the worker at once, is more memory than the stages need otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return lang_id.identified(docs, lang_id.Halves(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return minhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def with_ids(codec: bpe.Codec):
    digests = bpe.digest_rows(codec)
    return lambda ids: (np.asarray(ids, np.int32), *digests(ids))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN, finish=with_ids,
                      schema="ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near-dedup", near_dedup),
          ("decontamination", decontamination), ("byte-level BPE", byte_bpe)]

# Language ID and BPE have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
