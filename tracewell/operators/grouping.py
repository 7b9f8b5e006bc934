"""Equal content across ingestion views: groups, presence matrix, findings, page counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import rules, text as T
from tracewell.session import ship_package


def groups(items: DataFrame) -> DataFrame:
    """One row for each page and key: longest original (first of equals), presence by pipeline, kinds, paths. items: page_id, pipeline, ord, key, text, kind, path."""
    slots = [F.min(F.when(F.col("pipeline") == p, F.struct("ord", "kind", "path"))).alias(p.replace("-", "_")) for p in rules.PIPELINES]
    best = F.max_by("text", F.struct(F.length("text"), -F.col("ord")))
    # keyed by page and key: a page's items are bounded by the page
    return items.filter("key != ''").groupBy("page_id", "key").agg(best.alias("original"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("occurrences"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set("pipeline")).alias("pipelines"), *slots)


def matrix(grouped: DataFrame) -> DataFrame:
    """Presence by pipeline, for keys seen in two pipelines or more or marked interesting."""
    seen = [F.col(p.replace("-", "_")).isNotNull().alias(p.replace("-", "_")) for p in rules.PIPELINES]
    return grouped.select("page_id", F.substring("key", 1, 60).alias("key"), *seen, "kinds")


def ai_only(probe: DataFrame, base: DataFrame) -> DataFrame:
    """Probe items (page_id, key) that the base view lacks: longer than 12 characters, no equal key, no key of word similarity over 0.7 on the page."""
    lacking = probe.filter(F.length("key") > 12).join(base.select("page_id", "key"), ["page_id", "key"], "left_anti")
    near = base.select(F.col("page_id").alias("__page"), T.token_set(F.col("key")).alias("__base")).distinct()
    left = lacking.withColumn("__probe", T.token_set(F.col("key")))
    return left.join(near, (left["page_id"] == near["__page"]) & (T.jaccard(F.col("__probe"), F.col("__base")) > 0.7), "left_anti").drop("__probe")


def level_counts(findings: DataFrame, by) -> DataFrame:
    """All five levels, also those that don't occur."""
    return findings.groupBy(*by).agg(*[F.count_if(F.col("level") == x).alias(x) for x in rules.LEVELS], F.max(level_rank(F.col("level"))).alias("strongest_rank"))


def level_rank(level):
    return F.array_position(F.array(*map(F.lit, rules.LEVELS)), level).cast("int")


def ordered_findings(findings: DataFrame, by, order) -> DataFrame:
    """Sequential ids in order of appearance, then a rank by level within the same keys."""
    f = findings.withColumn("finding_no", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    w = W.partitionBy(*by).orderBy(F.desc(level_rank(F.col("level"))), "finding_no")
    return f.withColumn("place", F.row_number().over(w))


def attach_page(groups_: list[tuple[str, list[str]]], segments: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """The group key that each segment (key, words) of a page joins, taken in order. groups_: (key, words) in order.

    An equal key comes first. Else the segment takes the first best of the groups whose slot is free, by word
    similarity over the threshold; else it opens a group. Its own key is a group for what follows in any case.
    """
    place: dict[str, int] = {}
    keys: list[str] = []
    sizes: list[int] = []
    free: list[bool] = []
    having: dict[str, list[int]] = {}  # groups with each word

    def open_group(key, words):
        if key not in place:
            place[key] = len(keys)
            keys.append(key)
            sizes.append(len(words))
            free.append(True)
            for w in words:
                having.setdefault(w, []).append(place[key])
        return place[key]

    for key, words in groups_:
        open_group(key, words)
    out = []
    for key, words in segments:
        best = place.get(key)
        if best is None:
            shared: dict[int, int] = {}
            for w in words:
                for g in having.get(w, ()):
                    if free[g]:
                        shared[g] = shared.get(g, 0) + 1
            most = threshold
            for g in sorted(shared):
                if (sim := shared[g] / (sizes[g] + len(words) - shared[g])) > most:
                    best, most = g, sim
            own = open_group(key, words)
            best = own if best is None else best
        free[best] = False
        out.append(keys[best])
    return out


def fuzzy_attach(groups_: DataFrame, segments: DataFrame, threshold: float = 0.6) -> DataFrame:
    """page_id, key, ord of each segment with the group it joins, greedily by page in the order of ord; one without a match keeps its own key."""
    ship_package(segments.sparkSession)
    rows = [x.select("page_id", "key", "ord", F.lit(k).alias("segment"), T.token_set(F.col("key")).alias("words")).filter("key != ''") for k, x in ((False, groups_), (True, segments))]

    def one(page):
        page = page.sort_values(["segment", "ord", "key"], kind="stable")
        each, later = list(zip(page["key"], map(list, page["words"]))), page["segment"].to_numpy(dtype=bool)
        n = len(each) - int(later.sum())
        return page[later].assign(group_key=attach_page(each[:n], each[n:], threshold))[["page_id", "key", "ord", "group_key"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows[1].schema}
    # keyed by page: a page's items are bounded by the page, and each choice depends on the ones before
    return rows[0].unionByName(rows[1]).groupBy("page_id").applyInPandas(one, f"page_id {kinds['page_id']}, key string, ord {kinds['ord']}, group_key string")
