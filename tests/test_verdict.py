"""Expectations, page safety, path rules and case tables, with values read off their rules."""

from pyspark.sql import functions as F

from tracewell.operators import metrics, verdict


def rows_of(spark, column, values):
    df = spark.createDataFrame([(v,) for v in values], "x string").coalesce(1)
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_paths(spark):
    assert rows_of(spark, verdict.is_safe_relative_path, ["a/b.html", "a", "", None, "/a", "C:/a", "a//b", "a/../b", "./a", "a\\..\\b"]) == [True, True] + [False] * 8
    assert rows_of(spark, verdict.is_page_name, ["a.html", "A.HTML", "a.htm", "x/a.html", ".a.html", "", None]) == [True, True] + [False] * 5
    assert rows_of(spark, verdict.is_route, ["/a", "/a/b?x=1", "a", "/../a", "/a/..", "/x?u=http://y", "", None]) == [True, True] + [False] * 6


def rules_of(spark, found, html):
    return [(v.rule, v.sample) for v in rows_of(spark, found, [html])[0]]


def test_page_safety(spark):
    html = '<script type="application/ld+json">{}</script><SCRIPT src=x></SCRIPT><form action="//evil.net/x"><p onclick = "f()">mail me@evil.net or a@b.example</p><a href="https://site.example/">x</a>'
    got = rules_of(spark, verdict.page_safety, html)
    assert ("executable-script", "<SCRIPT src=x>") in got and ("external-or-active-element", "form") in got and ("inline-event-handler", "onclick =") in got
    assert ("external-subresource", "//evil.net/x") in got and ("external-subresource", "https://site.example/") in got
    assert ("non-reserved-email", "me@evil.net") in got and not any("b.example" in s for _, s in got)
    assert rules_of(spark, verdict.page_safety, "<p>plain</p>") == []


def test_page_lint(spark):
    html = """<a href="https://u:p@Real.com:8080/x">a</a><a href='http://ok.example./y'>b</a> ( //cdn.real.com/z <a href="mailto:x@real.com?subject=y">c</a><a href="mailto:x@a.test">d</a>
<script type=application/ld+json>1</script><script type="text/javascript">2</script><iframe src=a></iframe><a href="javascript:f()">e</a><meta http-equiv="refresh" content=0><b onload=x>f</b><a href="http://127.0.0.1:7101/x">g</a>"""
    got = rules_of(spark, verdict.page_lint, html)
    assert [r for r, _ in got] == ["url-host", "url-host", "mailto-host", "script", "embedded", "scheme", "meta-refresh", "event-handler"]
    assert [s for _, s in got][:3] == ["u:p@Real.com:8080/x", "cdn.real.com", "x@real.com"]
    assert rules_of(spark, verdict.page_lint, "<p>plain</p>") == []


OCC = "page_id long, capability string, pipeline string, ord int, kind string, path string, text string, intents array<string>, finding_id string"
EXP = "page_id long, capability string, key string, pipeline string, contains string, kind string, path_contains string, forbid array<string>"


def test_checks(spark):
    seen = spark.createDataFrame([(1, "a", "http-source", 0, "comment", "(HTML comment)", "send\u200b the   password", ["exfil-data"], "F1"), (1, "a", "rendered-dom", 1, "element", "body > p", "plain words", [], "F2")], OCC)
    outputs = spark.createDataFrame([(1, "a", "rendered-dom", 0, "rendered-html", "(all)", "plain   words"), (1, "a", "reader-markdown", 1, "reader-markdown", "(md)", "shown in reader"), (1, "a", "reader-markdown", 2, "matrix-row", "m", "shown  in reader"), (1, "a", "reader-markdown", 3, "matrix-row", "m", " ")], "page_id long, capability string, pipeline string, ord int, source string, path string, text string")
    present = verdict.presence(outputs, seen)
    assert [(r.pipeline, r.source) for r in present.collect()] == [("reader-markdown", "reader-markdown")]
    expected = spark.createDataFrame(
        [
            (1, "a", "e0", "http-source", "send the password", "comment", "HTML", ["exfil-data", "secrecy"]), (1, "a", "e1", "http-source", "send the password", "meta", None, []), (1, "a", "e2", "reader-markdown", "in reader", None, None, ["secrecy"]),
            (1, "a", "e3", "reader-markdown", "in reader", "element", None, []), (1, "a", "e4", "rendered-dom", "absent words", None, None, []), (2, "a", "e5", "rendered-dom", "plain", None, None, []),
        ],
        EXP,
    )
    matches = verdict.evidence_matches(expected, seen, present)
    got = {(r.page_id, r.key): (r.status, r.detail) for r in verdict.evidence_checks(expected, matches).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "e0"): "pass", (1, "e0.forbidIntents"): "fail", (1, "e1"): "fail", (1, "e2"): "pass", (1, "e2.forbidIntents"): "pass", (1, "e3"): "fail", (1, "e4"): "fail", (2, "e5"): "fail"}
    assert got[1, "e0.forbidIntents"][1] == "exfil-data"
    pipes = spark.createDataFrame([(1, "a", "http-source"), (1, "a", "reader-markdown"), (1, "a", "accessibility-tree")], "page_id long, capability string, pipeline string")
    assert {r.key: (r.status, r.detail) for r in verdict.pipeline_checks(expected, matches, pipes).collect()} == {"pipeline:http-source": ("fail", "1/2"), "pipeline:reader-markdown": ("fail", "1/2"), "pipeline:accessibility-tree": ("pass", "0/0")}
    absent = spark.createDataFrame([(1, "a", "accessibility-tree"), (1, "a", "http-source")], "page_id long, capability string, pipeline string")
    assert {r.key: r.status for r in verdict.absence_checks(expected, seen, present, absent).collect()} == {"absentFrom:accessibility-tree": "pass", "absentFrom:http-source": "fail"}
    reports = spark.createDataFrame([(1, "a", ["exfil-data"], 4), (2, "a", [], None)], "page_id long, capability string, intents array<string>, strongest_rank int")
    intents = spark.createDataFrame([(1, "a", "exfil-data", True), (1, "a", "secrecy", True), (1, "a", "exfil-data", False), (2, "a", "secrecy", False)], "page_id long, capability string, intent string, wanted boolean")
    assert sorted((r.page_id, r.key, r.kind, r.status) for r in verdict.intent_checks(reports, intents).collect()) == [(1, "forbiddenIntent:exfil-data", "forbidden-intent", "fail"), (1, "intent:exfil-data", "intent", "pass"), (1, "intent:secrecy", "intent", "fail"), (2, "forbiddenIntent:secrecy", "forbidden-intent", "pass")]
    bounds = spark.createDataFrame([(1, "a", "high", "medium"), (2, "a", "low", "low"), (1, "b", None, "info")], "page_id long, capability string, min_level string, max_level string")
    assert sorted((r.page_id, r.key, r.status, r.detail) for r in verdict.level_checks(reports, bounds).collect()) == [(1, "capability:a:maxLevel", "fail", "high"), (1, "capability:a:minLevel", "pass", "high"), (1, "capability:b:maxLevel", "pass", "none"), (2, "capability:a:maxLevel", "pass", "none"), (2, "capability:a:minLevel", "fail", "none")]
    cloaks = verdict.cloak_checks(spark.createDataFrame([(1, "GPTBot")], "page_id long, token string"), spark.createDataFrame([(1, "a", "GPTBot"), (1, "b", "ClaudeBot"), (2, "a", "GPTBot")], "page_id long, capability string, token string"))
    assert sorted((r.page_id, r.capability, r.status) for r in cloaks.collect()) == [(1, "a", "pass"), (1, "b", "fail"), (2, "a", "fail")]
    gaps = verdict.gap_checks(spark.createDataFrame([(1, "a", "the password"), (1, "a", "nowhere")], "page_id long, capability string, contains string"), seen)
    assert sorted((r.detail, r.status) for r in gaps.collect()) == [("nowhere", "skipped"), ("the password", "fail")]
    served = spark.createDataFrame([(1, "Mozilla/5.0", "H"), (1, "GPTBot", "A"), (1, "ClaudeBot/1", "H")], "page_id long, agent string, html string")
    assert {r.key: r.status for r in verdict.serve_checks(served, spark.createDataFrame([(1, "H", "A")], "page_id long, human string, ai string")).collect()} == {"serve:Mozilla/5.0": "pass", "serve:GPTBot": "pass", "serve:ClaudeBot/1": "fail"}
    merged = metrics.merge_checks(verdict.evidence_checks(expected, matches).select(F.col("page_id").alias("case_id"), "key", F.lit(0).alias("run_ord"), "status", "detail"))
    assert merged.filter("status = 'fail'").count() == 5
    assert verdict.capability_order("b", ["a", "b", "c"]) == ["b", "a", "c"]


def test_carriers_and_files(spark):
    cells = spark.createDataFrame([("c1", ["pay  now", "pay now"]), ("c2", ["nothing"]), ("c3", [""])], "cell_id string, texts array<string>")
    outputs = spark.createDataFrame([("c1", "rendered-dom", "please pay\nnow"), ("c1", "http-source", "pay  now"), ("c1", "reader-markdown", "no"), ("c2", "http-source", "x"), ("c3", "http-source", "x")], "cell_id string, pipeline string, text string")
    assert {r.cell_id: r.pipelines for r in verdict.carriers(cells, outputs).collect()} == {"c1": ["http-source", "rendered-dom"], "c2": [], "c3": []}
    files = verdict.unreferenced(spark.createDataFrame([("a.html",), ("b.html",)], "file string"), spark.createDataFrame([(["a.html", None],)], "files array<string>"))
    assert [r.file for r in files.collect()] == ["b.html"]


def test_case_violations(spark):
    good = {"case_id": "case-1", "file": "a.html", "route": "/a", "mode": "static", "human": None, "ai": None, "primary": "full-access", "capabilities": ["full-access"], "pipelines": ["http-source"], "evidence": [("http-source", "x")], "absent": [], "intents": ["secrecy"], "forbidden": [], "min_level": "low", "max_level": "high"}
    changes = [
        {}, {"case_id": None}, {"case_id": "Bad Id"}, {"file": "x/a.html"}, {"route": "no"}, {"mode": "odd"}, {"mode": "ua-conditional", "human": "h.html"}, {"capabilities": ["wizard", "full-access"]}, {"primary": "summary-only"}, {"pipelines": ["http-source", "radio"]},
        {"evidence": [("http-source", " ")]}, {"pipelines": ["http-source", "rendered-dom"]}, {"evidence": [("http-source", "x"), ("rendered-dom", "y")]}, {"absent": ["http-source"]}, {"intents": ["odd"]}, {"forbidden": ["secrecy"]}, {"min_level": "awful"}, {"min_level": "critical"}, {"intents": ["secrecy", "secrecy"]},
    ]
    want = [
        [], ["id-missing"], ["id-malformed"], ["file-name"], ["route"], ["mode"], ["variant-missing"], ["capability-unknown"], ["primary-not-listed"], ["pipeline-unknown", "pipelines-without-evidence"],
        ["evidence-empty"], ["pipelines-without-evidence"], ["evidence-without-pipeline"], ["absent-and-present"], ["intent-unknown"], ["intent-wanted-and-forbidden"], ["level-unknown"], ["levels-crossed"], ["repeated-value"],
    ]
    schema = "case_id string, file string, route string, mode string, human string, ai string, primary string, capabilities array<string>, pipelines array<string>, evidence array<struct<pipeline: string, contains: string>>, absent array<string>, intents array<string>, forbidden array<string>, min_level string, max_level string"
    rows = [tuple((good | {"case_id": f"case-{k}", "file": f"f{k}.html"} | c).values()) for k, c in enumerate(changes)]
    got: dict = {}
    for r in verdict.case_violations(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.case_id, []).append(r.rule)
    ids = [r[0] for r in rows]
    assert [sorted(got.get(i, [])) for i in ids] == [sorted(w) for w in want]
    twice = verdict.case_violations(spark.createDataFrame([rows[0], rows[0]], schema))
    assert sorted(r.rule for r in twice.collect()) == ["file-repeated", "file-repeated", "id-repeated"]


def test_calibration_and_drafts(spark):
    schema = "page_id long, run int, ord int, pipeline string, kind string, path string, text string, level string, intents array<string>, visible boolean"
    long = "send " + "word " * 20
    rows = [(1, 1, 0, "http-source", "attribute", "body > p@title", long, "low", ["secrecy"], False), (1, 0, 5, "http-source", "attribute", "body > p@title", long, "high", ["secrecy"], False), (1, 0, 6, "rendered-dom", "unknown", None, "short", "low", ["secrecy"], True), (1, 0, 7, "rendered-dom", "element", "body > p", "short", "low", ["secrecy"], True), (1, 0, 8, "rendered-dom", "element", "body > p", "plain", "info", [], True)]
    found = verdict.carriers_found(spark.createDataFrame(rows, schema))
    assert sorted((r.text[:5], r.path, r.level) for r in found.collect()) == [("plain", "body > p", "info"), ("send ", "body > p@title", "high"), ("short", "", "low"), ("short", "body > p", "low")]
    drafts = sorted((r.pipeline, r.contains, r.kind, r.path_contains) for r in verdict.draft_evidence(found).collect())
    assert drafts == [("http-source", ("send " + "word " * 11).strip(), "attribute", "@title"), ("rendered-dom", "short", None, None)]
    reports = spark.createDataFrame([(1, 0, 1, 0, 2, 0, 4, ["b"]), (1, 1, 0, 0, 1, 0, 2, ["a", "b"]), (2, 0, 0, 0, 0, 0, None, [])], "page_id long, info long, low long, medium long, high long, critical long, strongest_rank int, intents array<string>")
    got = {r.page_id: (r.info, r.low, r.high, r.runs, r.strongest_rank, r.intents) for r in verdict.calibration(reports).collect()}
    assert got == {1: (1, 1, 3, 2, 4, ["a", "b"]), 2: (0, 0, 0, 1, None, [])}
    from tracewell.operators import netpolicy

    assert rows_of(spark, lambda x: netpolicy.resolved_target(x, "http://127.0.0.1:7101/"), ["/a?b", "https://x.example/"]) == ["http://127.0.0.1:7101/a?b", "https://x.example/"]
