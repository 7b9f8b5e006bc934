"""Expectations of pages held against what was observed, and what makes a page or a path unsafe to serve. Violations are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules, text as T
from tracewell.operators import corpus
from tracewell.operators.grouping import level_rank

# Elements and attributes that reach outside or act.
ACTIVE = ("iframe", "object", "embed", "form", "base", "link", "img", "video", "audio", "source")
# Hosts that stand for nothing real.
INERT_SUFFIXES, LOOPBACK = (".example", ".invalid", ".test"), ("127.0.0.1", "localhost", "::1")
# What a served page may not hold, by rule.
ABSOLUTE_URL = r"(?i)(?:https?|ftp|file)://([^\s\"'<>()\\]+)"
RELATIVE_HOST = r"(?i)(?:^|[\s\"'(=,])//([a-z0-9][a-z0-9.-]*\.[a-z]{2,})"
MAILTO = r"(?i)mailto:([^\s\"'<>?]+)"
SCRIPT = r"(?i)<script\b([^>]*)>"
EMBEDDED = r"(?i)<(iframe|object|embed|base|frame|frameset|applet)\b"
SCHEME = r"(?i)((?:javascript|vbscript)\s*:|data:text/html)"
REFRESH = r"(?i)(<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh)"
HANDLER = r"(?i)(<[a-z][^>]*\son[a-z]+\s*=[^>]*>)"
DATA_TYPE = r"(?i)type\s*=\s*[\"']application/ld\+json[\"']"
DATA_SCRIPT = r"(?i)type\s*=\s*(?:\"\s*application/ld\+json\s*\"|'\s*application/ld\+json\s*'|application/ld\+json(?=[\s>]|$))"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _of(rule: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(rule).alias("rule"), F.substring(x, 1, 120).alias("sample")))


def bare_host(rest: Column) -> Column:
    """The host of what follows the slashes of a URL: without credentials and port."""
    first = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(first, r"^.*@", ""), r":\d*$", ""))


def is_inert_host(host: Column) -> Column:
    h = F.rtrim(F.lower(host), F.lit("."))
    out = h.isin(*LOOPBACK)
    for s in INERT_SUFFIXES:
        out = out | h.endswith(s)
    return out & (h != "")


def page_safety(html: Column) -> Column:
    """(rule, sample) of what makes a generated page unsafe: scripts but data, active elements, handlers, outside references, real targets."""
    scripts = F.filter(_all(html, r"(?i)(<\s*script\b[^>]*>)"), lambda x: ~x.rlike(DATA_TYPE))
    active = F.array_compact(F.array(*[F.when(html.rlike(rf"(?i)<\s*{t}\b"), F.lit(t)) for t in ACTIVE]))
    handlers = F.transform(_all(html, r"(?i)(\son[a-z]+\s*=)"), lambda x: F.trim(x))
    outside = F.filter(_all(html, r"(?i)\s(?:src|href|action|srcset|data)\s*=\s*[\"']?([^\"'\s>]+)"), lambda x: x.rlike(r"(?i)^(https?:)?//"))
    targets = F.transform(corpus.unsafe_targets(html), lambda t: F.struct(F.concat(F.lit("non-reserved-"), t["kind"]).alias("rule"), F.substring(t["match"], 1, 120).alias("sample")))
    return F.concat(_of("executable-script", scripts), _of("external-or-active-element", active), _of("inline-event-handler", handlers), _of("external-subresource", outside), targets)


def page_lint(html: Column) -> Column:
    """(rule, sample) of what a served fixture may not hold."""
    urls = F.filter(_all(html, ABSOLUTE_URL), lambda x: ~is_inert_host(bare_host(x)))
    hosts = F.filter(_all(html, RELATIVE_HOST), lambda x: ~is_inert_host(bare_host(x)))
    mails = F.filter(_all(html, MAILTO), lambda x: ~is_inert_host(F.substring_index(x, "@", -1)))
    scripts = F.filter(_all(html, SCRIPT), lambda x: ~x.rlike(DATA_SCRIPT))
    return F.concat(
        _of("url-host", F.concat(urls, hosts)), _of("mailto-host", mails), _of("script", scripts), _of("embedded", _all(html, EMBEDDED)), _of("scheme", _all(html, SCHEME)),
        _of("meta-refresh", _all(html, REFRESH)), _of("event-handler", _all(html, HANDLER)),
    )


def violations(pages: DataFrame, found: Column, column: str = "html") -> DataFrame:
    """One row for each violation of pages. found: page_safety() or page_lint() of a column."""
    return pages.withColumn("__v", F.explode(found)).select(*[c for c in pages.columns if c != column], "__v.*")


def is_safe_relative_path(path: Column) -> Column:
    """A path below a root: not absolute, no drive, no empty, `.` or `..` part."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    odd = F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return F.coalesce((F.trim(p) != "") & ~p.startswith("/") & ~p.rlike("^[a-zA-Z]:") & ~odd, F.lit(False))


def is_page_name(name: Column) -> Column:
    """A page's file name in one folder, not hidden."""
    p = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.coalesce((F.trim(p) != "") & ~F.contains(p, F.lit("/")) & ~p.startswith(".") & F.lower(p).endswith(".html"), F.lit(False))


def is_route(path: Column) -> Column:
    """A path that a server puts after its own origin."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce((F.trim(path) != "") & path.startswith("/") & ~F.contains(path, F.lit("://")) & ~F.exists(F.split(p, "/"), lambda x: x == ".."), F.lit(False))


def presence(outputs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """What outputs show without a finding: one row for each (page, pipeline, text) that no finding holds, the first source of equals. outputs: page_id, capability, pipeline, ord, source, path, text."""
    keys = ["page_id", "capability", "pipeline", "__text"]
    held = outputs.withColumn("__text", T.presence_text(F.col("text"))).filter("__text != ''")
    first = held.groupBy(*keys).agg(F.min_by(F.struct("ord", "source", "path", "text"), "ord").alias("m")).select(*keys, "m.*")
    found = occurrences.select("page_id", "capability", "pipeline", T.presence_text(F.col("text")).alias("__text"))
    return first.join(found, keys, "left_anti").drop("__text")


def evidence_matches(expected: DataFrame, occurrences: DataFrame, present: DataFrame) -> DataFrame:
    """Carriers of each expectation: findings' occurrences with its text (and kind, and path), or outputs with its text where it names neither.

    expected: page_id, capability, key, pipeline, contains, kind, path_contains; occurrences: page_id, capability, pipeline, ord, kind, path, text, intents, finding_id.
    Joined by page, capability and pipeline, so texts meet within one page's output only.
    """
    by = ["page_id", "capability", "pipeline"]
    holds = lambda text: F.contains(text, F.col("contains")) | F.contains(T.norm_key(text), F.col("contains"))
    a = expected.join(occurrences.select(*by, "ord", F.col("kind").alias("found_kind"), "path", "text", "intents", "finding_id", F.lit("finding").alias("source")), by)
    a = a.filter((F.col("kind").isNull() | (F.col("kind") == F.col("found_kind"))) & (F.col("path_contains").isNull() | F.contains("path", F.col("path_contains"))) & holds(F.col("text")))
    none = F.lit(None).cast("string")
    b = expected.filter("kind IS NULL AND path_contains IS NULL").join(present.select(*by, "ord", none.alias("found_kind"), "path", "text", F.array().cast("array<string>").alias("intents"), none.alias("finding_id"), "source"), by)
    b = b.filter(holds(F.col("text")) | F.contains(T.presence_text(F.col("text")), F.col("contains")))
    return a.unionByName(b).filter("contains != ''")


def _check(df: DataFrame, key: Column, kind: str, ok: Column, detail: Column) -> DataFrame:
    return df.select("page_id", "capability", key.alias("key"), F.lit(kind).alias("kind"), F.when(ok, "pass").otherwise("fail").alias("status"), detail.alias("detail"))


def evidence_checks(expected: DataFrame, matches: DataFrame) -> DataFrame:
    """A check for each expected carrier, and one for each with forbidden intents (array forbid)."""
    by = ["page_id", "capability", "key"]
    bad = F.array_intersect("intents", "forbid")
    seen = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("source") == "finding", bad))))).alias("offending"))
    both = expected.join(seen, by, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "offending": F.coalesce("offending", F.array().cast("array<string>"))})
    carried = _check(both, F.col("key"), "evidence", F.col("n") > 0, F.concat_ws(" ", "pipeline", F.lit("matches"), F.col("n").cast("string")))
    clean = _check(both.filter(F.size("forbid") > 0), F.concat("key", F.lit(".forbidIntents")), "forbidden-intent", F.size("offending") == 0, F.array_join("offending", ","))
    return carried.unionByName(clean)


def pipeline_checks(expected: DataFrame, matches: DataFrame, pipelines: DataFrame) -> DataFrame:
    """A check for each pipeline that has to carry all of its texts. pipelines: page_id, capability, pipeline."""
    by = ["page_id", "capability", "pipeline"]
    hit = matches.select("page_id", "capability", "key").distinct().withColumn("hit", F.lit(True))
    each = expected.join(hit, ["page_id", "capability", "key"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("all"), F.count("hit").alias("hits"))
    both = pipelines.join(each, by, "left").fillna(0, ["all", "hits"])
    return _check(both, F.concat(F.lit("pipeline:"), "pipeline"), "pipeline", F.col("hits") == F.col("all"), F.concat_ws("/", F.col("hits").cast("string"), F.col("all").cast("string")))


def absence_checks(expected: DataFrame, occurrences: DataFrame, present: DataFrame, absent: DataFrame) -> DataFrame:
    """A check for each pipeline that may carry none of a page's texts. absent: page_id, capability, pipeline."""
    wanted = expected.drop("pipeline").join(absent, ["page_id", "capability"])
    hits = evidence_matches(wanted, occurrences, present).groupBy("page_id", "capability", "pipeline").agg(F.countDistinct("key").alias("n"))
    both = absent.join(hits, ["page_id", "capability", "pipeline"], "left").fillna(0, ["n"])
    return _check(both, F.concat(F.lit("absentFrom:"), "pipeline"), "absent", F.col("n") == 0, F.col("n").cast("string"))


def intent_checks(reports: DataFrame, intents: DataFrame) -> DataFrame:
    """A check for each intent that has to be or may not be on a page. reports: page_id, capability, intents; intents: page_id, capability, intent, wanted."""
    both = intents.join(reports.select("page_id", "capability", "intents"), ["page_id", "capability"], "left")
    has = F.coalesce(F.array_contains("intents", F.col("intent")), F.lit(False))
    key = F.concat(F.when(F.col("wanted"), "intent:").otherwise("forbiddenIntent:"), "intent")
    out = _check(both, key, "intent", has == F.col("wanted"), F.array_join(F.coalesce("intents", F.array().cast("array<string>")), ","))
    return out.withColumn("kind", F.when(F.col("key").startswith("forbidden"), "forbidden-intent").otherwise(F.col("kind")))


def level_checks(reports: DataFrame, bounds: DataFrame) -> DataFrame:
    """Checks of the strongest level against a floor and a ceiling. reports: page_id, capability, strongest_rank (null: no finding); bounds: page_id, capability, min_level, max_level."""
    both = bounds.join(reports.select("page_id", "capability", "strongest_rank"), ["page_id", "capability"], "left")
    rank = F.col("strongest_rank")
    shown = F.coalesce(F.get(F.array(*map(F.lit, rules.LEVELS)), rank - 1), F.lit("none"))
    key = lambda what: F.concat(F.lit("capability:"), "capability", F.lit(f":{what}"))
    low = _check(both.filter("min_level IS NOT NULL"), key("minLevel"), "capability", F.coalesce(rank >= level_rank(F.col("min_level")), F.lit(False)), shown)
    high = _check(both.filter("max_level IS NOT NULL"), key("maxLevel"), "capability", F.coalesce(rank <= level_rank(F.col("max_level")), F.lit(True)), shown)
    return low.unionByName(high)


def cloak_checks(cloaked: DataFrame, wanted: DataFrame) -> DataFrame:
    """A check for each page that has to be cloaked for a token. wanted: page_id, capability, token; cloaked: page_id, token."""
    both = wanted.join(cloaked.select("page_id", F.col("token").alias("seen")), "page_id", "left")
    return _check(both, F.lit("cloak"), "cloak", F.coalesce(F.col("seen") == F.col("token"), F.lit(False)), F.coalesce("seen", F.lit("none")))


def gap_checks(gaps: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Known gaps are skipped; one that a finding reaches by now is out of date and fails. gaps: page_id, capability, contains."""
    hits = gaps.join(occurrences.select("page_id", "capability", "text"), ["page_id", "capability"]).filter(F.contains("text", F.col("contains")) | F.contains(T.norm_key(F.col("text")), F.col("contains")))
    both = gaps.join(hits.select("page_id", "capability", "contains").distinct().withColumn("hit", F.lit(True)), ["page_id", "capability", "contains"], "left")
    return both.select("page_id", "capability", F.lit("known-gap").alias("key"), F.lit("known-gap").alias("kind"), F.when(F.col("hit"), "fail").otherwise("skipped").alias("status"), F.col("contains").alias("detail"))


def serve_checks(served: DataFrame, variants: DataFrame) -> DataFrame:
    """Does each agent get the page that is meant for it? served: page_id, agent, html; variants: page_id, human, ai."""
    from tracewell.operators.netpolicy import crawler_token

    both = served.join(variants, "page_id", "left").withColumn("capability", F.lit(None).cast("string"))
    crawler = crawler_token(F.col("agent")).isNotNull()
    want = F.when(crawler, F.col("ai")).otherwise(F.col("human"))
    return _check(both, F.concat(F.lit("serve:"), "agent"), "serve", F.coalesce(F.col("html") == want, F.lit(False)), F.when(crawler, "ai").otherwise("human"))


def capability_order(primary: str, others) -> list[str]:
    """The capabilities of a run, the primary one first, each once."""
    return list(dict.fromkeys([primary, *others]))


def carriers(cells: DataFrame, outputs: DataFrame) -> DataFrame:
    """cell_id, pipelines: the sorted pipelines whose output holds one of a cell's payload texts. cells: cell_id, texts; outputs: cell_id, pipeline, text."""
    both = cells.join(outputs, "cell_id").filter(F.exists("texts", lambda t: (t != "") & (F.contains("text", t) | F.contains(T.presence_text(F.col("text")), t))))
    found = both.groupBy("cell_id").agg(F.array_sort(F.collect_set("pipeline")).alias("pipelines"))
    return cells.select("cell_id").join(found, "cell_id", "left").withColumn("pipelines", F.coalesce("pipelines", F.array().cast("array<string>")))


def unreferenced(files: DataFrame, cases: DataFrame) -> DataFrame:
    """Files that no case names. files: file; cases: files."""
    return files.join(cases.select(F.explode("files").alias("file")).filter("file IS NOT NULL"), "file", "left_anti")


def carriers_found(occurrences: DataFrame) -> DataFrame:
    """One row for each distinct carrier of a page over all of its runs, as its first run saw it. occurrences: page_id, run, ord, pipeline, kind, path, text, level, intents, visible."""
    by = ["page_id", "pipeline", "kind", "path", "text"]
    held = occurrences.withColumn("path", F.coalesce("path", F.lit("")))
    first = held.groupBy(*by).agg(F.min_by(F.struct("level", "intents", "visible", "run", "ord"), F.struct("run", "ord")).alias("m"))
    return first.select(*by, "m.*")


def calibration(reports: DataFrame) -> DataFrame:
    """Each page over all runs: findings by level summed, strongest rank, intents. reports: of report.report()."""
    sums = [F.sum(x).alias(x) for x in rules.LEVELS]
    return reports.groupBy("page_id").agg(*sums, F.count(F.lit(1)).alias("runs"), F.max("strongest_rank").alias("strongest_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("intents")))).alias("intents"))


def draft_evidence(found: DataFrame) -> DataFrame:
    """What a case of each page could expect: its carriers with an intent, each needle once for a pipeline. found: of carriers_found()."""
    at = F.when(F.contains("path", F.lit("@")), F.concat(F.lit("@"), F.regexp_extract("path", "@([\\s\\S]*)$", 1)))
    kind = F.when(~((F.col("pipeline") == "rendered-dom") & (F.col("kind") == "unknown")), F.col("kind"))
    held = found.filter(F.size("intents") > 0).select("page_id", "pipeline", T.needle(F.col("text")).alias("contains"), kind.alias("kind"), at.alias("path_contains"), "run", "ord")
    return held.groupBy("page_id", "pipeline", "contains").agg(F.min_by(F.struct("kind", "path_contains"), F.struct("run", "ord")).alias("m")).select("page_id", "pipeline", "contains", "m.*")


# What a case may be and need.
MODES, STATUSES = ("static", "ua-conditional"), ("active", "known-gap", "retired")


def case_violations(cases: DataFrame) -> DataFrame:
    """(case_id, rule) of what is wrong with a table of cases: id, file, route, mode, capability, capabilities, evidence pipelines and intents, levels, repeats.

    cases: case_id, file, route, mode, human, ai, primary, capabilities array, pipelines array, evidence array<struct<pipeline, contains>>, absent array, intents array, forbidden array, min_level, max_level.
    """
    none = F.array().cast("array<string>")
    col = lambda c: F.coalesce(F.col(c), none)
    unknown = lambda c, known: F.size(F.array_except(col(c), F.array(*map(F.lit, known)))) > 0
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    named = F.transform(F.coalesce("evidence", F.array().cast("array<struct<pipeline: string, contains: string>>")), lambda e: e["pipeline"])
    low, high = level_rank(F.col("min_level")), level_rank(F.col("max_level"))
    tests = (
        ("id-missing", blank("case_id")), ("id-malformed", ~blank("case_id") & ~F.col("case_id").rlike("^[a-z0-9][a-z0-9-]*$")), ("file-missing", blank("file")), ("file-name", ~blank("file") & ~is_page_name(F.col("file"))),
        ("route", F.col("route").isNotNull() & ~is_route(F.col("route"))), ("mode", F.col("mode").isNotNull() & ~F.col("mode").isin(*MODES)),
        ("variant-missing", (F.col("mode") == "ua-conditional") & (blank("human") | blank("ai"))), ("capability-unknown", unknown("capabilities", rules.CAPABILITIES) | ~F.coalesce(F.col("primary").isin(*rules.CAPABILITIES), F.lit(True))),
        ("primary-not-listed", (F.size(col("capabilities")) > 0) & ~F.coalesce(F.array_contains("capabilities", F.col("primary")), F.lit(False))), ("pipeline-unknown", unknown("pipelines", rules.PIPELINES) | unknown("absent", rules.PIPELINES)),
        ("evidence-empty", F.exists(F.coalesce("evidence", F.array().cast("array<struct<pipeline: string, contains: string>>")), lambda e: F.coalesce(F.trim(e["contains"]), F.lit("")) == "")),
        ("pipelines-without-evidence", F.size(F.array_except(col("pipelines"), named)) > 0), ("evidence-without-pipeline", F.size(F.array_except(named, col("pipelines"))) > 0),
        ("absent-and-present", F.size(F.array_intersect(col("pipelines"), col("absent"))) > 0), ("intent-unknown", unknown("intents", rules.INTENTS) | unknown("forbidden", rules.INTENTS)),
        ("intent-wanted-and-forbidden", F.size(F.array_intersect(col("intents"), col("forbidden"))) > 0), ("level-unknown", (F.col("min_level").isNotNull() & (F.coalesce(low, F.lit(0)) == 0)) | (F.col("max_level").isNotNull() & (F.coalesce(high, F.lit(0)) == 0))),
        ("levels-crossed", (low > 0) & (high > 0) & (low > high)), ("repeated-value", F.greatest(*[F.size(col(c)) - F.size(F.array_distinct(col(c))) for c in ("capabilities", "pipelines", "absent", "intents", "forbidden")]) > 0),
    )
    each = cases.select("case_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))).alias("rule"))
    ids = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("case_id", F.lit("id-repeated").alias("rule"))
    files = cases.filter("file IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("file")
    again = cases.join(files, "file", "left_semi").select("case_id", F.lit("file-repeated").alias("rule"))
    return each.unionByName(ids).unionByName(again)
