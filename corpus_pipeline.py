"""The corpus pipeline: quality classifier, quality rules, near-duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last one returns
the tokens. ``run`` writes every stage to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import bpe, ledger, mil, mixing, simhash
from askframe.llm.common import col, fresh, kept, table
from askframe.llm.queries import held_out

#: A document stays if its probability of quality is at least this.
LEAST_QUALITY = 0.3
POLICY = "2"
MIX = mixing.Mix(weights=(3, 1, 2), share=1.5, repeats=2, seed=42)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model, learned from the labels not held out, scores well.

    Null and empty texts are scored too; without usable labels every document stays.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = mil.train(docs, labels, "quality", mil.Fit())
    score, = fresh(docs, "score")
    return mil.score(docs, model, out=score).where(col(score) >= LEAST_QUALITY).drop(score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects; null and empty texts have too few words."""
    return ledger.kept_documents(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id."""
    return simhash.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go.

    Documents without words have nothing to give and go too. Decisions are joined by a hash of
    doc_id, text and source, so rows equal in all three are taken alike.
    """
    row, times = fresh(docs, "row", "times")
    hashed = docs.withColumn(row, F.xxhash64("doc_id", "text", "source"))
    taken = kept(
        mixing.mix_documents(hashed, MIX, key=row).where("taken > 0").groupBy("doc_id")
        .agg(F.max(F.expr("cast(taken div size as int)")).alias(times))
        .withColumnRenamed("doc_id", row), "mix-taken")
    repeated = F.explode(F.sequence(F.lit(1), col(times)))
    return (
        hashed.join(taken, row).withColumn(times, repeated)
        .select(*[col(c) for c in docs.columns])
    )


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and of the bytes they decode to, per document."""
    return bpe.token_digests(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: The model of the first stage has no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return kept(STAGES[-1][1](spark, docs, sf_dir), "stage-tokens")
