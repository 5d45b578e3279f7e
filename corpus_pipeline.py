"""Corpus pipeline: documents go through five stages, each a whole table in and a whole table out."""

from __future__ import annotations

from tessera.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from tessera.llm.scratch import Scratch


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark, docs, sf_dir):
    """Documents that pass the base rules and aren't outliers of their language and source."""
    return quality_rules.keep_good(spark, docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: that of the smallest id."""
    return jaccard_join.deduplicate(spark, docs, width=5, percent=80)


def decontamination(spark, docs, sf_dir):
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark, docs, sf_dir):
    """The same documents with personal data replaced by its kind in brackets."""
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    """Pieces of the documents' token ids, placed in windows of 2048."""
    return packing.pack(docs, _tokenizer())


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("PII", private_data), ("packing", packed)]

#: Outlier estimates and conditional random fields aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what each returns is written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name.replace(" ", "-").lower())
    return docs
