"""Side channels of a page: links that carry a prompt to an assistant, and URL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules


def url_decode(text: Column, plus_as_space: bool) -> Column:
    """Percent-decoding that keeps malformed input as it is."""
    return F.coalesce(F.try_url_decode(text if plus_as_space else F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def is_assistant_host(host: Column) -> Column:
    h = F.rtrim(F.lower(host), F.lit("."))
    out = F.lit(False)
    for name in rules.ASSISTANT_HOSTS:
        out = out | (h == name) | h.endswith("." + name)
    return F.coalesce(out, F.lit(False))


def classify_prompt(text: Column) -> dict[str, Column]:
    markers = F.filter(F.array(*[F.when(text.rlike(rules.java(p)), F.lit(n)) for n, p in rules.RECOMMENDATIONS]), lambda x: x.isNotNull())
    asks = text.rlike(rules.java(rules.SUMMARY_REQUEST))
    return {"asks_summary": asks, "markers": markers, "manipulative": F.size(markers) > 0, "benign": asks & (F.size(markers) == 0)}


def inspect_links(anchors: DataFrame) -> DataFrame:
    """Links to assistant hosts with a prompt: host, parameter, prompt, path hint and the prompt's class. anchors: href and more."""
    raw = [F.regexp_extract("href", rf"[?&]{p}=([^&#]*)", 1) for p in rules.PROMPT_PARAMS]
    blank = [F.trim(url_decode(x, True)) == "" for x in raw]
    out = anchors.filter(F.col("href").rlike("(?i)^https?://")).withColumns(
        {
            "host": F.lower(F.regexp_extract("href", r"(?i)^https?://(?:[^@/?#]*@)?([^/:?#]*)", 1)),
            "url_path": F.regexp_extract("href", r"(?i)^https?://[^/?#]*([^?#]*)", 1),
            "parameter": F.coalesce(*[F.when(~b, F.lit(p)) for p, b in zip(rules.PROMPT_PARAMS, blank)]),
            "prompt": F.coalesce(*[F.when(~b, url_decode(x, True)) for x, b in zip(raw, blank)]),
        }
    )
    out = out.filter(is_assistant_host(F.col("host")) & F.col("prompt").isNotNull())
    path = F.when(F.col("url_path") == "", F.lit("/")).otherwise(F.lower("url_path"))
    return out.withColumn("path_hint", path.rlike(rules.ASSISTANT_PATHS)).withColumns(classify_prompt(F.col("prompt")))


def embedded_targets(text: Column) -> Column:
    """URLs in a text, then e-mail addresses, each once among the latter. They are evidence and never requested."""
    urls = F.regexp_extract_all(text, F.lit(r"((?i:https?)://[^\s\"'<>)\]]+)"), F.lit(1))
    mails = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+)"), F.lit(1)))
    return F.concat(urls, F.array_except(mails, urls))


def fragments(urls: DataFrame) -> DataFrame:
    """URL fragments, raw and decoded, with their key=value pairs (the last of a repeated key). urls: url and more."""
    out = urls.withColumn("raw_fragment", F.regexp_extract("url", "#([\\s\\S]*)$", 1)).filter("raw_fragment != ''")
    out = out.withColumn("fragment", url_decode(F.col("raw_fragment"), False))
    plain = F.regexp_replace("fragment", r"^\?", "")
    pairs = F.when(plain.rlike(r"^[^=&\s]+="), F.filter(F.split(plain, "&"), lambda p: p.rlike("^[^=]+="))).otherwise(F.array().cast("array<string>"))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), url_decode(F.regexp_replace(p, "^[^=]*=", ""), True).alias("value")))
    out = out.withColumn("__entries", entries)
    last = F.transform(F.array_distinct(F.transform("__entries", lambda e: e["key"])), lambda k: F.element_at(F.filter("__entries", lambda e: e["key"] == k), -1))
    return out.withColumn("nested", last).drop("__entries")


def channel_segments(links: DataFrame, pages: DataFrame) -> DataFrame:
    """The texts of a page's side channels, links first: page_id, channel, ord, text, delivery, visible, in_code, path, host, parameter, raw, markers, benign, targets.

    links: page_id, ord, href, path; pages: page_id, url. Only links on a conversation's first page count.
    """
    raw = lambda p: F.regexp_extract("href", rf"[?&]{p}=([^&#]*)", 1)
    found = inspect_links(links).filter("path_hint")
    value = F.coalesce(*[F.when(F.col("parameter") == p, raw(p)) for p in rules.PROMPT_PARAMS])
    one = found.select("page_id", F.lit("ai-summary-link").alias("channel"), F.col("ord").cast("int").alias("ord"), F.col("prompt").alias("text"), F.lit("ai-link-prompt").alias("delivery"), F.col("path"), "host", "parameter", value.alias("raw"), "markers", "benign")
    of = F.when(F.size("nested") > 0, F.array_join(F.transform("nested", lambda e: e["value"]), "\n")).otherwise(F.col("fragment"))
    two = fragments(pages).select(
        "page_id", F.lit("url-fragment").alias("channel"), F.lit(1 << 30).alias("ord"), of.alias("text"), F.lit("url-fragment").alias("delivery"), F.lit("(URL fragment)").alias("path"), F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("parameter"), F.col("raw_fragment").alias("raw"), F.array().cast("array<string>").alias("markers"), F.lit(False).alias("benign"),
    )
    both = one.unionByName(two)
    return both.withColumns({"visible": F.lit(False), "in_code": F.lit(False), "targets": embedded_targets(F.col("text"))})
