"""Files as sources and sinks."""

import hashlib

import pytest

from tracewell.sources import corpus


def test_json_lines_over_splits(spark, tmp_path):
    rows = [f'{{"k": {k}, "pad": "{"x" * (k % 40)}"}}' if k % 7 else "" if k % 2 else "{broken" for k in range(500)]
    (tmp_path / "a.jsonl").write_bytes("\r\n".join(rows).encode() + b"\n")
    (tmp_path / "b.jsonl").write_bytes(b'{"k": 1}\r x\n\n{"k": 2}')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = corpus.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a").collect()
        both = corpus.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.line_no: r.raw for r in got} == {k + 1: x for k, x in enumerate(rows) if x}
    assert {r.line_no for r in got if r.malformed} == {k + 1 for k, x in enumerate(rows) if x == "{broken"}
    one = next(r for r in got if r.line_no == 2)
    sha = hashlib.sha256(rows[1].encode()).hexdigest()
    assert one.record_sha256 == sha and one.record_uid == f"a:L000002:{sha[:12]}"
    assert sorted((r.line_no, r.raw) for r in both if r.file.endswith("b.jsonl")) == [(1, '{"k": 1}\r x'), (2, ""), (3, '{"k": 2}')]


def test_shards_have_to_agree(spark):
    a, b, c = (spark.createDataFrame([(k, f)], "k int, fingerprint string") for k, f in ((1, "x"), (2, "x"), (3, "y")))
    assert sorted(r.k for r in corpus.merge_shards([a, b]).collect()) == [1, 2]
    with pytest.raises(Exception, match="shards differ in fingerprint"):
        corpus.merge_shards([a, b, c]).collect()
    assert corpus.merge_shards([a.limit(0)]).count() == 0


def test_pinned_files_and_sinks(spark, tmp_path):
    (tmp_path / "f.txt").write_text("abc")
    row = corpus.pinned_file(spark, str(tmp_path / "f.txt")).first()
    assert row.sha256 == hashlib.sha256(b"abc").hexdigest() and row.bytes == 3
    for path in ("http://x.example/f", "//share/f", "s3://b/f"):
        with pytest.raises(ValueError):
            corpus.pinned_file(spark, path)
    corpus.write_csv(spark.createDataFrame([(1, "a,b")], "k int, t string").coalesce(1), str(tmp_path / "csv"))
    assert [r.t for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["a,b"]
    corpus.write_reports(spark.createDataFrame([(1, ["a"])], "k int, t array<string>"), str(tmp_path / "json"))
    assert [r.t for r in spark.read.json(str(tmp_path / "json")).collect()] == [["a"]]
