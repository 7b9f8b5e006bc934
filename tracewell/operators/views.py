"""What a browser hands over, as tables: rendered elements with their styles, the accessibility tree, requests; and where a corpus comes from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import netpolicy, visibility
from tracewell.operators.corpus import VERIFIED
from tracewell.session import ship_package

# Attributes that are items of their own in a rendered page.
RENDERED_ATTRIBUTES = ("alt", "title", "aria-label", "aria-description", "placeholder", "aria-placeholder", "aria-valuetext")
# Fixed value: why an attribute isn't visible.
NOT_TEXT = "attribute value (not rendered as text)"
# Roles of the accessibility tree that say nothing.
SILENT_ROLES = ("none", "presentation", "generic", "InlineTextBox")
# How far a claim about a source has been checked.
CLAIM_STATES = ("artifact-verified", "upstream-verified", "claimed-only", "unverified")


def rendered_items(elements: DataFrame) -> DataFrame:
    """Items of rendered elements: their text, then their attributes.

    elements: page_id, ord, tag, path, text, in_code, attrs map, color, opacities and backgrounds (arrays, innermost first), display, visibility,
    font_size, clip, clip_path, text_indent, overflow, width, height, x, y. Elements without text give nothing.
    """
    bare = F.create_map().cast("map<string,string>")
    shown = visibility.style_facts(elements.withColumn("attrs", F.coalesce("attrs", bare)).filter(T.presence_text(F.col("text")) != ""))
    none = F.array().cast("array<string>")
    own = F.struct(
        F.lit("element").alias("kind"), F.col("path").alias("path"), F.col("text").alias("text"), visibility.visible().alias("visible"),
        visibility.hidden_reasons().alias("hidden_reasons"), visibility.near_invisible_reasons().alias("near_reasons"), F.col("in_code").alias("in_code"),
    )

    def attribute(name: Column, kind: Column, value: Column) -> Column:
        return F.struct(kind.alias("kind"), F.concat("path", F.lit("@"), name).alias("path"), value.alias("text"), F.lit(False).alias("visible"), F.array(F.lit(NOT_TEXT)).alias("hidden_reasons"), none.alias("near_reasons"), F.lit(False).alias("in_code"))

    worth = lambda v: (T.presence_text(v) != "") & ((F.length(T.presence_text(v)) >= 8) | F.trim(v).rlike(T.JS_SPACE))
    named = F.array_compact(F.array(*[F.when(worth(F.try_element_at("attrs", F.lit(a))), attribute(F.lit(a), F.lit("attribute"), F.col("attrs")[a])) for a in RENDERED_ATTRIBUTES]))
    hidden = (F.col("tag") == "input") & (F.lower(F.col("attrs")["type"]) == "hidden") & (T.presence_text(F.col("attrs")["value"]) != "")
    value = F.array_compact(F.array(F.when(hidden, attribute(F.lit("value"), F.lit("hidden-input-value"), F.col("attrs")["value"]))))
    data = F.transform(F.filter(F.map_entries("attrs"), lambda e: e["key"].startswith("data-") & worth(e["value"])), lambda e: attribute(e["key"], F.lit("data-attribute"), e["value"]))
    each = shown.select("page_id", "ord", F.posexplode(F.concat(F.array(own), named, value, data)).alias("k", "i"))
    return each.select("page_id", (F.col("ord").cast("int") * 1000 + F.col("k")).alias("ord"), "i.*", F.lit(False).alias("comment"))


def rendered_comments(comments: DataFrame) -> DataFrame:
    """Comments of rendered pages (page_id, ord, text) as further rows of rendered_items()."""
    none = F.array().cast("array<string>")
    return comments.filter(T.presence_text(F.col("text")) != "").select(
        "page_id", F.col("ord").cast("int").alias("ord"), F.lit("comment").alias("kind"), F.lit("(rendered DOM comment)").alias("path"), "text", F.lit(False).alias("visible"), none.alias("hidden_reasons"), none.alias("near_reasons"),
        F.lit(False).alias("in_code"), F.lit(True).alias("comment"),
    )


def named_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of the accessibility tree (page_id, ord, role, name) whose role says something; a missing name is empty."""
    return nodes.filter((F.coalesce("role", F.lit("")) != "") & ~F.col("role").isin(*SILENT_ROLES)).withColumn("name", F.coalesce("name", F.lit("")))


def _flat(s: pd.Series) -> pd.Series:
    def one(raw):
        out, stack = [], [json.loads(raw)] if raw else []
        while stack:
            node = stack.pop()
            if not isinstance(node, dict):
                continue
            name = " ".join(node["name"].split()) if isinstance(node.get("name"), str) else ""
            if name:
                out.append({"role": node.get("role") or "?", "name": name})
            stack += (node.get("children") or [])[::-1]
        return out

    return s.map(one)


def flatten_tree(trees: DataFrame) -> DataFrame:
    """page_id, ord, role, name of the named nodes of nested trees (page_id, tree as JSON), parents first."""
    ship_package(trees.sparkSession)
    flat = F.pandas_udf(_flat, "array<struct<role: string, name: string>>")
    return trees.select("page_id", F.posexplode(flat("tree")).alias("ord", "n")).select("page_id", "ord", "n.*")


def blocked_requests(requests: DataFrame, allowed, dns: DataFrame | None = None, fixtures=()) -> DataFrame:
    """Requests of pages (page_id, url, resource_type) that the policy stops, with the code; schemes that never leave the machine pass."""
    network = requests.filter(F.col("url").rlike("(?i)^https?:"))
    return netpolicy.check_targets(network, allowed, dns, fixtures).filter("code IS NOT NULL").select("page_id", "url", "resource_type", "code")


def serve(variants: DataFrame, requests: DataFrame) -> DataFrame:
    """page_id, agent, html: what a page that treats crawlers apart gives each agent. variants: page_id, human, ai; requests: page_id, agent."""
    crawler = netpolicy.crawler_token(F.col("agent")).isNotNull()
    return requests.join(variants, "page_id").select("page_id", "agent", F.when(crawler, F.coalesce("ai", "human")).otherwise(F.col("human")).alias("html"))


def source_violations(sources: DataFrame) -> DataFrame:
    """(source, rule) of what keeps a source from being sampled: name, address, revision, hash, licences and claims without evidence.

    sources: source, url, revision, sha256, repository_licence, licences array<struct<key, licence, documented_in, status>>, claims array<struct<claim, status, evidence>>.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    state = lambda x: F.coalesce(x["status"], F.lit("unverified"))
    any_ = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    tests = (
        ("source-missing", blank(F.col("source"))), ("url-missing", blank(F.col("url"))), ("revision-missing", blank(F.col("revision"))), ("hash-malformed", ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("licence-incomplete", any_("licences", lambda x: blank(x["licence"]) | blank(x["documented_in"]))), ("licence-status", any_("licences", lambda x: ~state(x).isin(*CLAIM_STATES))),
        ("claim-missing", any_("claims", lambda x: blank(x["claim"]))), ("claim-status", any_("claims", lambda x: ~state(x).isin(*CLAIM_STATES))), ("claim-without-evidence", any_("claims", lambda x: state(x).isin(*VERIFIED) & blank(x["evidence"]))),
    )
    return sources.select("source", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))).alias("rule"))


def source_summary(sources: DataFrame) -> DataFrame:
    """source, verified and all claims, and how much is unresolved: claims, licences, a missing licence of the whole."""
    ok = lambda x: F.coalesce(x["status"].isin(*VERIFIED), F.lit(False))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    verified, licences = size(F.filter("claims", ok)), size(F.filter("licences", lambda x: ~ok(x)))
    bare = (F.trim(F.coalesce("repository_licence", F.lit(""))) == "").cast("int")
    return sources.select("source", "revision", verified.alias("verified_claims"), size(F.col("claims")).alias("total_claims"), (size(F.col("claims")) - verified + licences + bare).alias("unresolved"))
