"""Registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import sql
from tabscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op5_quality_rules")
def op5(spark, sf):
    from tabscope.llm.quality import quality_rules
    return quality_rules(table(spark, sf, "documents")).drop("text_hash")


@register("op6_line_dedup", sql.OP6)
def op6(spark, sf):
    from tabscope.llm.line_dedup import line_dedup
    out = line_dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@register("op10_cube_mixing")
def op10(spark, sf):
    from tabscope.llm.mixing import mix_sources
    return mix_sources(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@register("op4_winnowing_decontamination", sql.OP4)
def op4(spark, sf):
    from tabscope.llm.decontaminate import decontamination_hits
    hits = decontamination_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op9_ngram_jaccard_join", sql.OP9)
def op9(spark, sf):
    from tabscope.llm.jaccard_join import jaccard_classes
    return jaccard_classes(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op2_guess_cost_secrets")
def op2(spark, sf):
    from tabscope.llm.secret_scan import scan_secrets
    return scan_secrets(table(spark, sf, "documents"))


@register("op8_chat_format")
def op8(spark, sf):
    from tabscope.llm.chat_format import format_conversations, read_back
    talk = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(talk.unionByName(extra))).drop("rewrote")


@register("op1_warc_archive", sql.OP1)
def op1(spark, sf):
    from tabscope.llm.warc import read_warc, scratch_dir, write_warc
    out = scratch_dir(spark)
    write_warc(table(spark, sf, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op3_contextual_pii")
def op3(spark, sf):
    from tabscope.llm.pii import find_personal_data
    return find_personal_data(table(spark, sf, "documents"))


@register("op7_knn_toxicity")
def op7(spark, sf):
    from tabscope.llm.toxicity import score_toxicity
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op11_filter_interaction", sql.OP11)
def op11(spark, sf):
    from tabscope.llm.filter_audit import filter_audit
    return filter_audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op12_direct_token_codes")
def op12(spark, sf):
    import public_tokenizers
    from tabscope.llm.token_files import read_token_files, write_token_files
    from tabscope.llm.warc import scratch_dir
    out = scratch_dir(spark)
    write_token_files(table(spark, sf, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1, by_word=True)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op13_pipelined_search", sql.OP13)
def op13(spark, sf):
    from tabscope.llm.lexical_search import lexical_search
    return lexical_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("quality_base_counts", sql.QUALITY_BASE)
def quality_base_counts(spark, sf):
    return op5(spark, sf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@register("secret_base_counts", sql.SECRET_BASE)
def secret_base_counts(spark, sf):
    return op2(spark, sf).select("doc_id", "n_assign", "n_access", "n_hex")


@register("personal_base_counts", sql.PERSONAL_BASE)
def personal_base_counts(spark, sf):
    return op3(spark, sf).select("doc_id", "n_email")


@register("mixing_targets", sql.MIXING_TARGETS)
def mixing_targets(spark, sf):
    out = op10(spark, sf)
    return out.select("doc_id", "size", "source_size", (F.floor(F.col("target") * 1000 + 0.5) / 1000).alias("target"))
