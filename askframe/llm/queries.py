"""The registered corpus queries: each operator on its whole table, with its parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import (
    aliases, audit, bpe, chat, chunked, crosstok, curves, ledger, mil, mixing, pagediff, shards,
    simhash,
)
from askframe.llm.common import table

URL_RULES = [
    aliases.Rule("allow", "org/"),
    aliases.Rule("block", "example.org/es/"),
    aliases.Rule("block", "example.org/en/1"),
    aliases.Rule("allow", "com/fr/"),
    aliases.Rule("block", "com/de/"),
]


def op1_redirect_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on all pages, by rule or by their aliases."""
    return aliases.judge(table(spark, sf, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "inherited")


def op2_hilbert_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """16 shards of equal row counts along the curve over source, language and size."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    dimensions = {
        "source": shards.name_class(F.col("source"), 5),
        "lang": shards.name_class(F.col("lang"), 5),
        "size": shards.size_class(F.col("size"), 5),
    }
    light = docs.select("doc_id", "size", "text_crc32", *[
        c.alias(f"class_{name}") for name, c in dimensions.items()])
    cut = shards.hilbert_shards(
        light, {name: F.col(f"class_{name}") for name in dimensions},
        ties=["doc_id", "text_crc32", "size"], shards=16, bits=5)
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


def held_out(key: str = "doc_id"):
    """Whether the labels of a document are kept from learning."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op4_attention_mil(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where(~held_out())
    model = mil.train(docs, labels, "quality", mil.Fit())
    return mil.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_event_log_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one of control strings, as a log with edits and regenerations, folded
    and rendered."""
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
        "conv_id long, turn long, role string, text string")
    events = chat.as_events(rows.unionByName(more), drafts=True)
    return chat.digests(chat.read_back(chat.render(chat.messages(events))))


def op6_quality_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements, failure bits and the verdict of policy 2 for every text."""
    rows = ledger.verdicts(ledger.ledger(table(spark, sf, "documents")), "2")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failures", "policy")


def op7_min_cost_mix(spark: SparkSession, sf: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix_documents(
        table(spark, sf, "documents"), mixing.Mix(weights=(3, 1, 2), share=1.5, repeats=2, seed=42))


def op8_shifted_curves(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return curves.search(
        table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10, curves.Curves())


def op9_page_differencing(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return pagediff.main_text(table(spark, sf, "pages"))


def op10_byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    return bpe.token_digests(
        table(spark, sf, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_spill_counting(spark: SparkSession, sf: str) -> DataFrame:
    """Links between the tokens of two tokenizers, and how they stand in the corpus."""
    return crosstok.token_links(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes, in every order, per language."""
    return audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_chunk_reuse_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text by chunks that texts share, and what they decode to, as digests."""
    return chunked.token_digests(
        table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "op1_redirect_filter": op1_redirect_filter,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_simhash": op3_simhash,
    "op4_attention_mil": op4_attention_mil,
    "op5_event_log_chat": op5_event_log_chat,
    "op6_quality_ledger": op6_quality_ledger,
    "op7_min_cost_mix": op7_min_cost_mix,
    "op8_shifted_curves": op8_shifted_curves,
    "op9_page_differencing": op9_page_differencing,
    "op10_byte_level_bpe": op10_byte_level_bpe,
    "op11_spill_counting": op11_spill_counting,
    "op12_filter_audit": op12_filter_audit,
    "op13_chunk_reuse_bpe": op13_chunk_reuse_bpe,
    "pipeline": pipeline,
}
