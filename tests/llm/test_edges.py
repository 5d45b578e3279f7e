"""Every operator and stage over nulls, repeated rows, a very long text and extra columns that have the names used inside."""

from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import html_extract, language_id, line_quality, packing, pii, quality_rules, secret_scan
from tessera.llm.decontaminate import scan_documents
from tessera.llm.jaccard_join import JaccardJoin
from tessera.llm.scratch import Scratch

#: Names of columns that operators make on their way or return.
NAMES = "h p a b c t id key state blob kept score predicted lang_pred distance rejected spans base items n_words n_hit contaminated component_id cls df sequence_id offset start length kind group rank word_chars base_failed n_assign row path".split()


def _texts():
    r = Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))
    one, two = prose(80), prose(120) + "\npassword = hunter2hunter2\nmail ann@example.com or +49 30 1234567"
    rows = [(1, one), (1, one), (2, one + " tail"), (3, two), (None, two), (None, None), (4, None), (5, ""), (6, "\n \n"), (7, prose(60_000)), (8, two)]
    return [(i, t, lang, source, len(t or "")) for k, (i, t) in enumerate(rows) for lang, source in [("en", "web") if k % 3 else (None, None)]]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(_texts(), "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def crowded(plain):
    return plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])


def _secrets(spark, docs):
    scan = secret_scan.SecretScan()
    return scan.by_path(docs, secret_scan.Store(spark, Scratch(spark, "edges").root).update(scan, docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_spans", F.col("spans").cast("string"))


def _tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def _quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (8, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return line_quality.score(docs, line_quality.fit(docs, labels, F.lit(True))).select("doc_id", F.round("score", 9))


OPERATORS = {
    "secrets": _secrets,
    "rules": lambda spark, docs: quality_rules.judge(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "contamination": lambda spark, docs: scan_documents(spark, docs, docs.where("doc_id = 3").select(F.lit("x").alias("item_id"), "text", F.lit(0).alias("h"))).select("doc_id", "n_words", "n_hit", "contaminated"),
    "jaccard": lambda spark, docs: JaccardJoin(spark, width=4, percent=85).components(docs).select("doc_id", "n_shingles", "component_id"),
    "quality": _quality,
    "pii": lambda spark, docs: pii.detect(docs).select("doc_id", F.to_json("base"), F.to_json("spans")),
    "language": lambda spark, docs: language_id.predict(docs, language_id.fit(docs, F.lit(True))).select("doc_id", "lang_pred"),
    "packing": lambda spark, docs: packing.pieces(docs, _tokenizer()),
    "pages": lambda spark, docs: html_extract.main_text(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), "text").alias("html"), *[c for c in docs.columns if c in NAMES])),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(spark, plain, crowded, name):
    want, got = (Counter(map(tuple, OPERATORS[name](spark, d).collect())) for d in (plain, crowded))
    assert got == want and want
    if name not in ("packing", "jaccard"):
        assert sum(want.values()) == len(_texts())
    assert OPERATORS[name](spark, crowded.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_the_columns(spark, crowded, tmp_path, stage):
    crowded.where("doc_id = 3").select(F.lit("x").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.STAGES[stage][1](spark, crowded, str(tmp_path))
    assert kept.columns == crowded.columns
    others = [c for c in crowded.columns if c not in ("text", "n_chars")]  # personal data is masked, which changes these two
    rows, before = (Counter(map(tuple, d.select(others).collect())) for d in (kept, crowded))
    assert rows and not rows - before
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())
    assert corpus_pipeline.STAGES[stage][1](spark, crowded.limit(0), str(tmp_path)).count() == 0
