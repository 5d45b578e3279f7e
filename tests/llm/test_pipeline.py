"""The pipeline's stages against plain versions on the smallest documents."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import pii, quality_rules

from .test_operators import fold, linked

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(spark, docs).collect()}
    left = {i: r.text for i, r in rows.items() if verdict[i]}
    groups = linked([(i, t) for i, t in left.items()], 5, 80)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    pattern, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = pattern.findall(fold(r.text))
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}

    def contaminated(text):
        w, hit = pattern.findall(fold(text)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    left = {i: t for i, t in left.items() if not contaminated(t)}
    left = {i: pii.masked(t, pii.find_spans(t, pii.trained())[1]) for i, t in left.items()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in left.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 2048):
            want[(i, s, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((x.doc_id, x.start, x.ids_crc32) for x in got) == want
    used = Counter()
    for x in got:
        used[x.sequence_id] += x.length
    assert max(used.values()) <= 2048
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
