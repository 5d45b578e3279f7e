"""The queries as registered, over the smallest tables, against their contracts."""

import hashlib
import os
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry

from .test_operators import fold, linked

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op2(spark, texts):
    out = run(spark, "op2_quality_rules")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        text = texts[r.doc_id].text or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        seen, covered = Counter(zip(w, w[1:], w[2:])), set()
        for k, x in enumerate(zip(w, w[1:], w[2:])):
            if seen[x] > 1:
                covered |= {k, k + 1, k + 2}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_op4(spark, texts):
    pattern, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = pattern.findall(fold(r.text))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(r.item_id))
    sizes = {len(x) for x in windows}
    out = run(spark, "op4_benchmark_decontamination")
    assert sorted(r.doc_id for r in out) == sorted(texts) and any(r.contaminated for r in out)
    for r in out:
        w, hit, items = pattern.findall(fold(texts[r.doc_id].text)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= own
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w))


def test_op5(spark, texts):
    want = linked([(i, r.text) for i, r in texts.items()], 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op5_ngram_jaccard_join")} == want


def test_op6(spark, texts):
    out = {r.doc_id: r for r in run(spark, "op6_quality_classifier")}
    assert sorted(out) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in out.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [out[i].predicted == q for i, q in labels.items() if i in out and out[i].held_out and q is not None]
    assert sum(held) >= 0.9 * len(held)


def test_op7(spark, texts):
    from tessera.llm.pii import KINDS, luhn

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = run(spark, "op7_pii")
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        found, counts = [], []
        for k, p in enumerate(patterns):
            own = []
            for m in re.finditer(p, texts[r.doc_id].text or ""):
                d = re.sub("[^0-9]", "", m[0])
                if not ((k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (13 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 9 <= len(d) <= 15)):
                    own.append(f"{KINDS[k]}:{m.start()}:{m.end()}")
            found += own
            counts.append(len(own))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == sha(",".join(found))
        assert set(found) <= set(r.spans.split(","))


def test_op8(spark, texts):
    out = {r.doc_id: r for r in run(spark, "op8_language_id")}
    assert sorted(out) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in out.items())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i].text or "")) for i, r in out.items())
    held = [r.lang_pred == texts[i].lang for i, r in out.items() if r.held_out and texts[i].lang and r.lang_pred != "und"]
    assert sum(held) >= 0.95 * len(held)


def test_op9(spark, texts):
    out = run(spark, "op9_packing")
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_doc) == sorted(texts)
    for pieces, total in ((sorted((a, n) for a, n, _ in p), p[0][2]) for p in by_doc.values()):
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == total
    for pieces in by_sequence.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


def test_op10(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = run(spark, "op10_html_extraction")
    assert sorted(r.page_id for r in out) == sorted(pages)
    assert all(r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in out)
    # the words of each heading, which the article begins with, and none of a page's script
    assert sum("track(" in r.text for r in out) == 0 and sum(bool(r.text) for r in out) >= 0.9 * sum("<p>" in (p.html or "") for p in pages.values())
