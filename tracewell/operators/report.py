"""A page's report: content of four views grouped, signals, evidence tiers, findings, presence matrix, cloaking.

Views come as tables; a view that wasn't taken is left out. Each group of equal content is one row; it is assessed once
for each capability asked for, as rules don't depend on capabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import rules, text as T
from tracewell.operators import channels, grouping, risk
from tracewell.session import stash

# Kinds of items by how they are delivered.
ATTRIBUTE_KINDS = ("attribute", "data-attribute", "hidden-input-value")
# Signals that count as strong or weak delivery.
STRONG = ("html-comment", "invisible-unicode", "render-hidden", "near-invisible", "attribute-value", "ai-visible-human-invisible")
WEAK = ("hidden-in-source", "raw-only", "meta-tag", "inert-template", "noscript-content")

# The older detector's patterns, in order.
LEGACY = (
    ("ignore-previous", r"ignore\s+(all|any|the|your)\s+(previous|above|prior|preceding|earlier)\s+(instructions?|prompts?|directions?|guidelines?)"),
    ("ignore-previous", r"ignore\s+everything\s+(above|before|in\s+this\s+(page|document))"),
    ("task-override", r"(disregard|forget|do not follow|override|bypass)\s+(your|all|the|any|these)\s+.{0,40}?(instructions?|guidelines?|rules?|policies|safety)"),
    ("system-prompt", r"(system prompt|developer message|your instructions say|reveal your (instructions|prompt))"),
    ("impersonation", r"you are (now )?(a|an|the) [a-z ]{0,30}(assistant|agent|bot|curl command)"),
    ("exfil-url", r"(send|post|upload|transmit|email|forward|curl|wget|beacon|append|add|include|log|report|open|visit).{0,100}?(to|at|towards)\s*[:：]?\s*(https?:\/\/|[\w.+-]+@[\w-]+\.[\w.]+)"),
    ("exfil-data", r"(include|attach|append|leak|reveal|exfiltrate|add).{0,80}?(api[- ]?keys?|passwords?|tokens?|secrets?|credentials?|session|cookies?|email addresses?|contact list|phone numbers?|ssn)"),
    ("silent-action", r"(do not (tell|inform|mention|warn|alert|ask) (the )?user|without (telling|informing|asking|notifying|mentioning)[^.|]{0,40}?user|keep this (a )?(secret|hidden)|the user (must not|should not) (know|see|notice))"),
    ("obfuscation", r"(base64|hex|urlencoded?|rot13).{0,60}?(decode|decrypt|unescape).{0,60}?(then |and )?(follow|execute|run|obey)"),
)
# The older detector's types with severity and the abilities of which one is needed (none: any reader).
LEGACY_TYPES = {
    "ignore-previous": (3, ()), "task-override": (3, ()), "system-prompt": (2, ()), "impersonation": (2, ()), "exfil-url": (4, ("network",)), "exfil-data": (4, ("forms", "network", "email", "drive")), "silent-action": (3, ()), "obfuscation": (3, ()),
}

def legacy_matches(text: Column, in_code: Column) -> Column:
    """(type, quoted) of the older patterns that match, in their order; quoted: in code or with a quotation mark next to the first match."""
    found = []
    for name, pattern in LEGACY:
        p = "(?i)" + pattern
        # where the first match begins and ends, between two marks
        marked = F.regexp_replace(F.regexp_replace(text, "[\u0001\u0002]", ""), p, "\u0001$0\u0002")
        before, after = F.substring_index(marked, "\u0001", 1), F.regexp_extract(marked, "^[^\u0002]*\u0002([\\s\\S]{0,3})", 1)
        near = F.right(before, F.lit(3)).rlike(f"{risk.QUOTES}\\s*$") | after.rlike(f"^\\s*{risk.QUOTES}")
        found.append(F.when(text.rlike(p), F.struct(F.lit(name).alias("type"), (in_code | near).alias("quoted"))))
    return F.array_compact(F.array(*found))


def delivery(kind: Column, rendered: Column, visible: Column, near: Column) -> Column:
    """How a group reaches a reader. kind: of its item in the source, null without one; rendered: is it in the rendered view; near: has it near-invisible reasons."""
    return (
        F.when(kind == "comment", "comment")
        .when(kind == "meta", "meta")
        .when(kind.isin("jsonld", "jsonld-malformed"), "jsonld")
        .when(kind.isin(*ATTRIBUTE_KINDS), "attribute")
        .when(rendered & ~visible, "css-hidden")
        .when(rendered & near, "near-invisible")
        .when(rendered, "visible")
        .otherwise("css-hidden")
    )


@dataclass
class Views:
    """source: as extract.items() gives; rendered: page_id, ord, kind, path, text, visible, hidden_reasons, near_reasons, in_code, comment (one of the rendered comments);
    reader: page_id, ord, text, path, in_code; tree: page_id, ord, role, name of the accessibility tree."""

    source: DataFrame
    rendered: DataFrame | None = None
    reader: DataFrame | None = None
    tree: DataFrame | None = None


def _items(views: Views) -> DataFrame:
    """All items under one schema, in the order in which they form groups."""
    none = lambda kind: F.lit(None).cast(kind)
    empty = F.array().cast("array<string>")

    def rows(df, place, pipeline, kind, path, text, in_code, hints=empty, visible=none("boolean"), hidden=empty, near=empty, slot=F.lit(True)):
        return df.select(
            "page_id", F.lit(place).alias("view"), F.col("ord").cast("int").alias("ord"), F.lit(pipeline).alias("pipeline"), kind.alias("kind"), path.alias("path"), text.alias("text"),
            in_code.alias("in_code"), hints.alias("hints"), visible.alias("visible"), hidden.alias("hidden"), near.alias("near"), slot.alias("slot"),
        )

    c = F.col
    parts = [rows(views.source, 0, "http-source", c("kind"), c("path"), c("text"), c("in_code"), c("hints"))]
    if views.rendered is not None:
        r = views.rendered
        parts.append(rows(r.filter("NOT comment"), 1, "rendered-dom", c("kind"), c("path"), c("text"), c("in_code"), empty, c("visible"), c("hidden_reasons"), c("near_reasons")))
        parts.append(rows(r.filter("comment"), 2, "rendered-dom", F.lit("comment"), F.lit("(rendered DOM comment)"), c("text"), F.lit(False), slot=F.lit(False)))
    if views.reader is not None:
        parts.append(rows(views.reader, 3, "reader-markdown", F.lit("reader"), c("path"), c("text"), c("in_code"), slot=F.lit(False)))
    if views.tree is not None:
        named = views.tree.filter(F.length("name") >= 4)
        parts.append(rows(named, 4, "accessibility-tree", F.lit("a11y-node"), F.concat(F.lit("accessibility tree (role="), c("role"), F.lit(")")), c("name"), F.lit(False), slot=F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("key", T.norm_key(F.col("text"))).filter("key != ''")


def grouped(views: Views) -> DataFrame:
    """One row for each page and key: original (the longest text), ord, source and rendered item, reader, tree, occurrences, kinds, paths, invisible, decoded."""
    held = stash(_items(views), "items")
    place = F.struct("view", "ord")
    slot = lambda n: F.min_by(F.struct("kind", "path", "in_code", "hints", "visible", "hidden", "near", "text"), F.when((F.col("view") == n) & F.col("slot"), F.col("ord")))
    # a page's items are bounded by the page
    out = held.groupBy("page_id", "key").agg(
        F.max_by("text", F.struct(T.utf16_length(F.col("text")), -F.col("view"), -F.col("ord"))).alias("original"), F.min(place).alias("place"), slot(0).alias("source"), slot(1).alias("rendered"),
        F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set(F.when(F.col("path") != "", F.col("path")))).alias("paths"),
    )
    for view, name in ((3, "reader"), (4, "tree")):
        if (views.reader if view == 3 else views.tree) is None:
            out = out.withColumns({name: F.lit(False), name + "_code": F.lit(False)})
            continue
        number = F.col("view").cast("long") * 1_000_000_000 + F.col("ord")
        earlier = held.filter(F.col("view") < view).groupBy("page_id", "key").agg(F.min(number).alias("ord"))
        segments = held.filter(F.col("view") == view).select("page_id", "key", number.alias("ord"), "in_code")
        joined = grouping.fuzzy_attach(earlier, segments.drop("in_code")).join(segments.drop("key"), ["page_id", "ord"])
        slots = joined.groupBy("page_id", F.col("group_key").alias("key")).agg(F.max_by("in_code", "ord").alias(name + "_code"), F.lit(True).alias(name))
        out = out.join(slots, ["page_id", "key"], "left").withColumns({name: F.coalesce(name, F.lit(False)), name + "_code": F.coalesce(name + "_code", F.lit(False))})
    return out


def assessed(groups: DataFrame, capabilities=tuple(rules.CAPABILITIES)) -> DataFrame:
    """Each group for each capability, with delivery, signals, intents, level, instruction, tier and whether it is a finding."""
    c, none = F.col, F.array().cast("array<string>")
    source, rendered = c("source").isNotNull(), c("rendered").isNotNull()
    shown = rendered & c("rendered.visible")
    near = F.size(F.coalesce("rendered.near", none)) > 0
    in_code = F.coalesce(c("rendered.in_code"), F.lit(False)) | F.coalesce(c("source.in_code"), F.lit(False))
    g = groups.withColumns(
        {
            "delivery": delivery(c("source.kind"), rendered, F.coalesce(c("rendered.visible"), F.lit(False)), near), "visible": F.coalesce(shown, F.lit(False)),
            "in_markup": in_code, "in_code": in_code | c("reader_code"), "text": c("original"),
            "invisible": F.when(source, T.invisible_classes(c("source.text"))).otherwise(none), "message": F.when(source, T.decode_tags(c("source.text"))).otherwise(""),
        }
    )
    g = g.withColumn("legacy", legacy_matches(c("original"), c("in_markup")))
    # written, as the plan of all rules is large and what follows reads its columns often
    g = stash(risk.assess(risk.with_intents(risk.nfkc(g)), capabilities), "assessed")
    kind, hidden = F.coalesce(c("source.kind"), F.lit("")), rendered & ~F.coalesce(c("rendered.visible"), F.lit(False))
    pairs = (
        ("html-comment", "high", kind == "comment"), ("meta-tag", "info", kind == "meta"), ("document-title", "info", kind == "title"), ("inert-template", "medium", kind == "template"),
        ("noscript-content", "medium", kind == "noscript"), ("jsonld", "info", kind == "jsonld"), ("jsonld", "medium", kind == "jsonld-malformed"), ("cdata", "info", kind == "cdata"),
        ("attribute-value", "high", kind.isin(*ATTRIBUTE_KINDS)), ("invisible-unicode", "high", F.size("invisible") > 0), ("decoded-invisible-text", "high", (F.size("invisible") > 0) & (c("message") != "")),
        ("hidden-in-source", "medium", (kind == "element") & (F.size("source.hints") > 0)), ("render-hidden", "high", hidden),
        ("invisible-unicode", "high", rendered & c("rendered.text").rlike("[\u200b-\u200d\ufeff\u2060]")), ("near-invisible", "high", rendered & near),
        ("ai-visible-human-invisible", "high", source & hidden & (c("reader") | c("tree"))), ("raw-only", "medium", source & ~rendered), ("reader-excludes", "info", c("visible") & ~c("reader")),
        ("quoted-context", "info", c("discounted")), ("decoded-invisible-text", "high", c("decoded") != ""), ("addressed-to-ai", "info", c("addressed_why").isNotNull()),
    )
    signals = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))) for t, s, on in pairs]))
    types = F.transform("legacy", lambda m: m["type"])
    g = g.withColumns({"signals": signals, "instructions": F.when(F.size("kept") > 0, F.col("kept")).otherwise(types)})
    g = g.withColumn("instruction", F.coalesce("primary_intent", F.get("instructions", F.lit(0))))
    quoted = F.when(F.size("kept") > 0, c("discounted")).when(F.size("legacy") > 0, F.forall("legacy", lambda m: m["quoted"])).otherwise(c("in_markup"))
    loud = F.exists("signals", lambda s: s["severity"] != "info")
    return g.withColumns({"quoted_context": quoted, "tier": evidence_tier(c("instruction").isNotNull(), c("signals"), source | rendered), "finding": c("instruction").isNotNull() | loud})


def evidence_tier(instruction: Column, signals: Column, present: Column) -> Column:
    """0 to 3: an instruction on a telling delivery weighs most."""
    types = F.transform(signals, lambda s: s["type"])
    strong, weak = (F.arrays_overlap(types, F.array(*map(F.lit, w))) for w in (STRONG, WEAK))
    return F.when(instruction & (strong | weak), 3).when(instruction & present, 2).when(instruction, 1).when(strong, 2).when(weak, 1).otherwise(0)


def matrix(groups: DataFrame) -> DataFrame:
    """Presence by view of what is a finding, stands in two views or more, or in source and rendering. groups: of assessed()."""
    c = F.col
    source, rendered = c("source").isNotNull(), c("rendered").isNotNull()
    views = source.cast("int") + rendered.cast("int") + c("reader").cast("int") + c("tree").cast("int")
    shown = F.when(~rendered, "absent").when(c("rendered.visible"), "visible").otherwise("hidden")
    keep = groups.filter(c("finding") | (views >= 2))
    return keep.select("page_id", "capability", F.substring("key", 1, 60).alias("key"), "visible", "delivery", source.alias("http_source"), shown.alias("rendered_dom"), c("reader").alias("reader_markdown"), c("tree").alias("accessibility_tree"), "instruction", "kinds", "paths")


def _findings_of_groups(groups: DataFrame) -> DataFrame:
    return groups.filter("finding").select("page_id", "capability", F.lit(0).alias("part"), F.struct("place.view", "place.ord").alias("place"), F.col("original").alias("text"), "delivery", "visible", "signals", "instruction", "instructions", "kept", F.col("addressed_why").isNotNull().alias("addressed"), "discounted", "tier", "quoted_context", "level")


def channel_findings(segments: DataFrame, capabilities=tuple(rules.CAPABILITIES)) -> DataFrame:
    """Findings of side channels: of links that carry an instruction, of every fragment. segments: of channels.channel_segments()."""
    kept = segments.withColumn("shown", F.col("text"))
    a = risk.assess(risk.with_intents(risk.nfkc(kept)), capabilities)
    link = F.col("channel") == "ai-summary-link"
    pairs = (
        ("ai-summary-link", "high", link), ("recommendation-manipulation", "high", link & (F.size("markers") > 0)), ("benign-summary-request", "info", link & F.col("benign")),
        ("url-fragment", "high", ~link), ("embedded-destination", "medium", F.size("targets") > 0),
    )
    signals = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))) for t, s, on in pairs]))
    found = a.filter((F.col("level") != "info") | (F.size("kept") > 0) | ~link)
    return found.select(
        "page_id", "capability", F.lit(1).alias("part"), F.struct(F.when(link, 0).otherwise(1).alias("view"), "ord").alias("place"), F.col("shown").alias("text"), "delivery", "visible", signals.alias("signals"),
        F.get("kept", F.lit(0)).alias("instruction"), F.col("kept").alias("instructions"), "kept", F.col("addressed_why").isNotNull().alias("addressed"), "discounted", F.lit(3).alias("tier"), F.col("discounted").alias("quoted_context"), "level",
    )


def probes(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """page_id, token, items, ai_only of each probe that was answered: how many of its texts the page doesn't show others. answers: page_id, inventory_ord, token, ord, text."""
    keyed = answers.withColumn("key", T.norm_key(F.col("text")))
    only = grouping.ai_only(keyed, groups.select("page_id", "key"))
    counts = only.groupBy("page_id", "token").agg(F.count(F.lit(1)).alias("ai_only"))
    return keyed.groupBy("page_id", "inventory_ord", "token").agg(F.count(F.lit(1)).alias("items")).join(counts, ["page_id", "token"], "left").withColumn("ai_only", F.coalesce("ai_only", F.lit(0)))


MOST_SEGMENTS = 8


def cloaks(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """page_id, token, segments: of each page that shows some agent other text, the first such token of the inventory and its first texts."""
    only = grouping.ai_only(answers.withColumn("key", T.norm_key(F.col("text"))), groups.select("page_id", "key"))
    first = only.groupBy("page_id").agg(F.min(F.struct("inventory_ord", "token")).alias("t")).select("page_id", F.col("t.token").alias("token"))
    mine = only.join(first, ["page_id", "token"])
    return mine.groupBy("page_id", "token").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "key"))), 1, MOST_SEGMENTS), lambda x: x["key"]).alias("segments"))


def cloak_findings(cloaked: DataFrame, capabilities=tuple(rules.CAPABILITIES)) -> DataFrame:
    """A finding for each cloaked page, of the texts that only an agent gets."""
    s = cloaked.withColumns({"text": F.array_join("segments", "\n"), "delivery": F.lit("ai-only"), "visible": F.lit(False), "in_code": F.lit(False)})
    a = risk.assess(risk.with_intents(risk.nfkc(s)), capabilities)
    signal = F.array(F.struct(F.lit("ua-cloaking").alias("type"), F.lit("critical").alias("severity")))
    return a.select(
        "page_id", "capability", F.lit(2).alias("part"), F.struct(F.lit(0).alias("view"), F.lit(0).alias("ord")).alias("place"), F.array_join("segments", "\n---\n").alias("text"), "delivery", "visible", signal.alias("signals"),
        F.col("primary_intent").alias("instruction"), F.col("kept").alias("instructions"), "kept", F.col("addressed_why").isNotNull().alias("addressed"), "discounted", F.lit(3).alias("tier"), F.col("discounted").alias("quoted_context"), "level",
    )


def numbered(findings: DataFrame) -> DataFrame:
    """Adds finding_id (F1, F2, ...: groups in order, channels, cloak) and shown_at: cloak first, then by level, each in order."""
    each = W.partitionBy("page_id", "capability")
    out = findings.withColumn("n", F.row_number().over(each.orderBy("part", "place")))
    shown = F.row_number().over(each.orderBy(F.desc(F.col("part") == 2), F.desc(grouping.level_rank(F.col("level"))), "n"))
    return out.withColumns({"finding_id": F.concat(F.lit("F"), F.col("n").cast("string")), "shown_at": shown, "excerpt": T.excerpt(T.norm_key(F.col("text")))}).drop("n", "part", "place")


def findings(groups: DataFrame, segments: DataFrame | None = None, cloaked: DataFrame | None = None, capabilities=tuple(rules.CAPABILITIES)) -> DataFrame:
    """All findings of pages, numbered and ordered. groups: of assessed()."""
    out = _findings_of_groups(groups)
    if segments is not None:
        out = out.unionByName(channel_findings(segments, capabilities))
    if cloaked is not None:
        out = out.unionByName(cloak_findings(cloaked, capabilities))
    return numbered(out)


def report(found: DataFrame) -> DataFrame:
    """One row for each page and capability: findings by level, strongest level, distinct instructions, whether it is cloaked. found: of findings()."""
    levels = [F.count_if(F.col("level") == x).alias(x) for x in rules.LEVELS]
    return found.groupBy("page_id", "capability").agg(
        *levels, F.count(F.lit(1)).alias("findings"), F.max(grouping.level_rank(F.col("level"))).alias("strongest_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("intents"), F.bool_or(F.col("delivery") == "ai-only").alias("cloaked")
    )


def primary_legacy(matches: Column) -> Column:
    """The type of the severest of the older matches, the first of equals."""
    severity = lambda t: F.coalesce(*[F.when(t == n, F.lit(s)) for n, (s, _) in LEGACY_TYPES.items()])
    types = F.transform(matches, lambda m: m["type"])
    most = F.array_max(F.transform(types, severity))
    return F.get(F.filter(types, lambda t: severity(t) == most), F.lit(0))


def legacy_impact(instruction: Column, capability: Column, tier: Column, cloaked: Column, quoted: Column, visible: Column) -> Column:
    """Level by the older model: severity, tier, reach and cloaking add up; without an instruction by tier and cloaking alone."""
    severity, reach = F.lit(0), F.lit(True)
    for name, (points, needs) in LEGACY_TYPES.items():
        able = [c for c, abilities in rules.CAPABILITIES.items() if not needs or set(needs) & set(abilities)]
        severity, reach = F.when(instruction == name, points).otherwise(severity), F.when(instruction == name, capability.isin(*able)).otherwise(reach)
    score = severity + tier - 1 + reach.cast("int") + cloaked.cast("int")
    score = F.when(quoted & visible, F.least(score, F.lit(2))).otherwise(score)
    at = F.greatest(F.lit(1), F.least(F.lit(4), score - 2)) + 1
    bare = F.when(cloaked & (tier >= 3), "medium").when(tier >= 2, "low").otherwise("info")
    return F.when(instruction.isNull(), bare).otherwise(F.element_at(F.array(*map(F.lit, rules.LEVELS)), at))


def view_totals(views: Views) -> DataFrame:
    """page_id and items of each view: the page's statistics."""
    held = _items(views)
    return held.groupBy("page_id").agg(*[F.count_if(F.col("pipeline") == p).alias(p.replace("-", "_")) for p in rules.PIPELINES])
