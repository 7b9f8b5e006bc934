"""The pipeline's stages against plain Python, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from llm_brute import brute_components, brute_spans, brute_stats, crc, plain_ids

from tracewell.llm import quality
from tracewell.session import read_table, scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(path)
        after = docs.collect()
        kept.append(len(after))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            for r in before.values():
                n, _, symbols, dups, repeats = brute_stats(r.text)
                failed = n < quality.MIN_WORDS or 100 * repeats > 20 * n
                clean = not failed and 100 * symbols <= 10 * n and dups < quality.DUP_LINE_LIMIT
                assert not (failed and any(x.doc_id == r.doc_id for x in after))
                assert not clean or any(x.doc_id == r.doc_id for x in after) or len(r.text) > 16 * n
        elif name == "near_dedup":
            want = brute_components([(r.doc_id, r.text) for r in before.values()], 5, 80)
            assert {r.doc_id for r in after} == {i for i, (_, c) in want.items() if i == c}
        elif name == "pii":
            assert {r.doc_id for r in after} == set(before)
            for r in after:
                spans = brute_spans(before[r.doc_id].text)
                assert (r.text == before[r.doc_id].text) if not spans else all(before[r.doc_id].text[a:b] not in r.text for a, _, b in spans)
                assert r.n_chars == len(r.text)
        else:
            ids = {i: plain_ids(r.text) for i, r in before.items()}
            assert sum(r.length for r in after) == sum(map(len, ids.values()))
            assert all(crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 for r in after)
    assert 0 < kept[1] < kept[0] < 200


ODD = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, row string, host string, __v string"


def odd_rows():
    word = " ".join("w%d" % k for k in range(60))
    mail = "Zorblatt reach zed@corp.example " + " ".join("u%d" % k for k in range(40))
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, word), (3, word), (4, word + " tail"), (5, mail), (5, word.upper()), (None, mail + " again"), (6, "ab " * 20000), (7, " ".join("v%d" % k for k in range(30000)))]
    return [(i, t, None, "h" if k % 2 else None, len(t or ""), "clash", None, "clash", "x") for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("rows", [[], odd_rows()], ids=["empty", "odd"])
def test_stages_on_odd_tables(spark, rows):
    """Nulls, empty and very long texts, repeated rows and ids, further columns: each stage gives its defined result."""
    docs = spark.createDataFrame(rows, ODD)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        after = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect())
        if not rows:
            assert after == []
        elif name == "quality_rules":
            assert after == [-1, 3, 3, 4, 5, 5, 7]  # no words, and one word repeated, go
        elif name == "near_dedup":
            assert after == [-1, 3, 5, 7]  # one of equal rows, of a near copy, of a copy in capitals; a null id stays
        elif name == "pii":
            assert after == [-1, 3, 5, 7]
            texts = {r.doc_id: r for r in docs.collect()}
            assert "zed@corp" not in texts[5].text and "<EMAIL>" in texts[None].text and texts[5].n_chars == len(texts[5].text)
        else:
            assert set(after) == {-1, 3, 5, 7} and sum(r.length for r in docs.collect()) > 30000
