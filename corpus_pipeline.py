"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of documents:

toxicity       drops documents that the model, trained on the table labels, predicts to be toxic
near_dedup     keeps of each group of near-duplicates (five-word shingles, similarity 0.8 or more) that of the smallest id
decontaminate  drops documents of whose words a twentieth or more lies in windows of 13 words of the table benchmark
secrets        puts [SECRET] in the place of secrets, all documents stay; n_chars is the new length
encode         gives doc_id, the token ids of the text, their number and hashes, and whether decoding gives the text

Cases: null and empty texts are clean, never toxic by more than the share of toxic labels (0.49 at most), alone in their groups, and give no
ids; rows without doc_id pass every filter on their text's merits and are nobody's duplicate; rows that repeat a doc_id stay or go together
in near_dedup; an empty table gives an empty result; other columns of documents are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import bpe, decontaminate, minhash, secrets, toxicity
from lorespark.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject, with all their columns."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns."""
    return minhash.deduplicate(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with less than a twentieth of their words in benchmark windows, with all their columns."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13, percent=5).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, [SECRET] in the place of secrets; n_chars is the length of the new text."""
    return secrets.redact(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256 and round_trip of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", F.col("ids").alias("token_ids"), "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontaminate", drop_contaminated), ("secrets", redact_secrets), ("encode", encode)]

#: The first stage trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
