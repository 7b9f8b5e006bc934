"""Tables that a browser hands over, and provenance."""

import json

from tracewell.operators import extract, report, views

STYLE = "color string, opacities array<double>, backgrounds array<string>, display string, visibility string, font_size double, clip string, clip_path string, text_indent double, overflow string, width double, height double, x double, y double"
PLAIN = ("rgb(0,0,0)", [1.0], [], "block", "visible", 16.0, "auto", "none", 0.0, "visible", 100.0, 20.0, 0.0, 0.0)


def test_rendered_items_feed_reports(spark):
    hidden = (*PLAIN[:3], "none", *PLAIN[4:])
    rows = [
        (1, 0, "p", "html > body > p", "  Shown   text ", False, {"title": "two words", "alt": "short", "data-x": "longenough", "data-y": "no"}, *PLAIN), (1, 1, "div", "html > body > div", "Hidden text", False, None, *hidden),
        (1, 2, "input", "html > body > input", "x", False, {"type": "HIDDEN", "value": "v"}, *PLAIN), (1, 3, "p", "html > body > p", "  ", False, {"title": "lost as it has no text"}, *PLAIN),
    ]
    df = spark.createDataFrame(rows, "page_id long, ord int, tag string, path string, text string, in_code boolean, attrs map<string, string>, " + STYLE)
    items = views.rendered_items(df)
    got = [(r.kind, r.path.split("> ")[-1], r.text, r.visible, r.hidden_reasons) for r in items.orderBy("ord").collect()]
    assert got == [
        ("element", "p", "  Shown   text ", True, []), ("attribute", "p@title", "two words", False, [views.NOT_TEXT]), ("data-attribute", "p@data-x", "longenough", False, [views.NOT_TEXT]),
        ("element", "div", "Hidden text", False, ["display:none"]), ("element", "input", "x", True, []), ("hidden-input-value", "input@value", "v", False, [views.NOT_TEXT]),
    ]
    comments = views.rendered_comments(spark.createDataFrame([(1, 0, " note "), (1, 1, " ")], "page_id long, ord int, text string"))
    source = extract.items(spark.createDataFrame([(1, "<p>Shown text</p><div hidden>Hidden text</div>")], "page_id long, html string"))
    groups = {r.key: r for r in report.grouped(report.Views(source, items.unionByName(comments))).collect()}
    assert groups["Shown text"].rendered.visible and not groups["Hidden text"].rendered.visible and groups["note"].rendered is None and groups["note"].kinds == ["comment"]


def test_trees_and_articles(spark):
    nodes = views.named_nodes(spark.createDataFrame([(1, 0, "link", "Go"), (1, 1, "generic", "x"), (1, 2, "heading", None), (1, 3, None, "y")], "page_id long, ord int, role string, name string"))
    assert [(r.role, r.name) for r in nodes.orderBy("ord").collect()] == [("link", "Go"), ("heading", "")]
    tree = {"role": "root", "name": " all  of it ", "children": [{"name": "a", "children": [{"role": "link", "name": "b"}]}, {"role": "x", "name": " "}, {"role": "link", "name": "c"}]}
    flat = views.flatten_tree(spark.createDataFrame([(1, json.dumps(tree)), (2, None)], "page_id long, tree string"))
    assert [(r.ord, r.role, r.name) for r in flat.orderBy("ord").collect()] == [(0, "root", "all of it"), (1, "?", "a"), (2, "link", "b"), (3, "link", "c")]
    article = spark.createDataFrame([(1, "<h1>T</h1><p>Own <b>bold</b></p><ul><li><a>all of it</a></li></ul><blockquote><p>q</p></blockquote><div>no</div>")], "page_id long, html string")
    assert [(r.path, r.text, r.in_code) for r in extract.reader_segments(article).orderBy("ord").collect()] == [("reader > h1", "T", False), ("reader > p", "Own ", False), ("reader > li", "all of it", False), ("reader > blockquote", "q", True), ("reader > p", "q", True)]


def test_requests_and_serving(spark):
    df = spark.createDataFrame([(1, "http://127.0.0.1:7101/a", "image"), (1, "https://cdn.example/x", "script"), (1, "data:text/plain,x", "image"), (1, "http://10.0.0.1/", "xhr")], "page_id long, url string, resource_type string")
    assert sorted((r.resource_type, r.code) for r in views.blocked_requests(df, "10.0.0.1", fixtures=(("127.0.0.1", 7101),)).collect()) == [("script", "unallowlisted-host"), ("xhr", "blocked-ip")]
    pages = views.serve(spark.createDataFrame([(1, "H", "A")], "page_id long, human string, ai string"), spark.createDataFrame([(1, "Mozilla"), (1, "x GPTBot/1")], "page_id long, agent string"))
    assert {r.agent: r.html for r in pages.collect()} == {"Mozilla": "H", "x GPTBot/1": "A"}


def test_sources(spark):
    schema = "source string, url string, revision string, sha256 string, repository_licence string, licences array<struct<key: string, licence: string, documented_in: string, status: string>>, claims array<struct<claim: string, status: string, evidence: string>>"
    good = ("s", "https://x.example/", "abc", "a" * 64, "MIT", [("k", "MIT", "LICENSE", "upstream-verified")], [("c", "artifact-verified", "f"), ("d", None, None)])
    bad = ("t", " ", None, "xyz", None, [("k", None, "LICENSE", "odd")], [("", "odd", None), ("e", "artifact-verified", " ")])
    df = spark.createDataFrame([good, bad, ("u", "x", "r", "b" * 64, None, None, None)], schema)
    found: dict = {}
    for r in views.source_violations(df).collect():
        found.setdefault(r.source, []).append(r.rule)
    assert found == {"t": ["url-missing", "revision-missing", "hash-malformed", "licence-incomplete", "licence-status", "claim-missing", "claim-status", "claim-without-evidence"]}
    assert {r.source: (r.verified_claims, r.total_claims, r.unresolved) for r in views.source_summary(df).collect()} == {"s": (1, 2, 1), "t": (1, 2, 3), "u": (0, 0, 1)}
