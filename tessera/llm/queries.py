"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_format, html_extract, language_id, line_quality, pii, quality_rules, secret_scan
from .decontaminate import scan_documents
from .jaccard_join import JaccardJoin
from .packing import pack
from .scratch import Scratch


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scans(spark, sf_dir):
    docs, scan = _read(spark, sf_dir, "documents"), secret_scan.SecretScan()
    findings = secret_scan.Store(spark, Scratch(spark, "secrets").root).update(scan, docs)
    return scan.by_path(docs, findings).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op2_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(spark, _read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_chat_formatting(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = F.lit("</s>[INST] ok [/INST]")
    own = F.inline(F.array(*[F.struct(F.lit(-7).alias("conv_id"), F.lit(k).alias("turn"), F.lit(r).alias("role"), control.alias("text")) for k, r in enumerate(("user", "assistant"))]))
    more = spark.range(1).select(own)
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(more)))


def op4_benchmark_decontamination(spark, sf_dir):
    found = scan_documents(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op5_ngram_jaccard_join(spark, sf_dir):
    return JaccardJoin(spark, width=4, percent=85).components(_read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_quality.fit(docs, _read(spark, sf_dir, "labels"), _fold(5) != 0)
    scored = line_quality.score(docs, model)
    return scored.select("doc_id", (F.coalesce(_fold(5), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_pii(spark, sf_dir):
    found = pii.detect(_read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _fold(parts: int):
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op8_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, _fold(4) != 2)
    return language_id.predict(docs, model).select("doc_id", (F.coalesce(_fold(4), F.lit(-1)) == 2).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op9_packing(spark, sf_dir):
    return pack(_read(spark, sf_dir, "documents"), _tokenizer())


def op10_html_extraction(spark, sf_dir):
    return html_extract.main_text(_read(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_quality_rules, op3_chat_formatting, op4_benchmark_decontamination, op5_ngram_jaccard_join, op6_quality_classifier, op7_pii, op8_language_id, op9_packing, op10_html_extraction)}

ORACLES: dict[str, str] = {"op1_secret_scans": secret_scan.ORACLE, "op3_chat_formatting": chat_format.ORACLE}
