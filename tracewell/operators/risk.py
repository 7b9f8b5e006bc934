"""Risk assessment of text segments: intents, addressing, gates, score, level. Expressions over columns, no shuffle."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules, text as T
from tracewell.session import ship_package

# Fixed value: quotation marks.
QUOTES = "[\"'“”‘’]"


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(rules.java(p))
    return out


def nfkc(df: DataFrame, column: str = "text") -> DataFrame:
    """Brings non-ASCII texts to NFKC in one pass over df; of ASCII ones Python sees nulls only."""
    ship_package(df.sparkSession)
    fold = F.pandas_udf(_nfkc, "string")
    odd = F.when(F.col(column).rlike(r"[^\x00-\x7F]"), F.col(column))
    return df.withColumn(column, F.coalesce(fold(odd), F.col(column)))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def may_match(low: Column, name: str) -> Column:
    """Can one of the patterns that rules.NEEDS has under name match? low: the text in lower case."""
    out = F.lit(False)
    for line in rules.NEEDS[name]:
        every = F.lit(True)
        for group in line.split(" & "):
            one = F.lit(False)
            for word in group.split("|"):
                one = one | F.contains(low, F.lit(word))
            every = every & one
        out = out | every
    return out


def marked(text: Column, pattern: str) -> Column:
    """text with each match between two control characters."""
    return F.regexp_replace(F.translate(text, "\u0001\u0002", ""), rules.java(pattern), "\u0001$0\u0002")


def outside_quotes(text: Column, pattern: str) -> Column:
    """Does the pattern match somewhere that isn't next to a quotation mark (two blanks at most between)?"""
    m = marked(text, pattern)
    total = F.regexp_count(m, F.lit("\u0001"))
    quoted = F.regexp_count(m, F.lit(f"{QUOTES}\\s{{0,2}}\u0001[^\u0002]*\u0002|\u0001[^\u0002]*\u0002\\s{{0,2}}{QUOTES}"))
    return total > quoted


def with_intents(segments: DataFrame, column: str = "text") -> DataFrame:
    """Adds norm, decoded, hidden, intents, unquoted, addressed, and the gates' facts. Nothing here depends on a capability."""
    raw = F.coalesce(F.col(column), F.lit(""))
    step = segments.withColumns({"norm": T.matching_text(raw), "decoded": F.array_join(T.tag_messages(raw), " "), "hidden": T.hides(raw)})
    step = step.withColumn("body", F.trim(F.concat_ws(" ", F.col("norm"), F.when(F.col("decoded") != "", F.col("decoded")))))
    body, low = F.col("body"), F.col("low")
    step = step.withColumn("low", F.lower(body))
    # a select for each intent keeps generated methods small
    for name, patterns in rules.PATTERNS.items():
        step = step.withColumn(f"i_{name}", may_match(low, name) & _any(body, patterns))
    step = step.withColumn("intents", F.filter(F.array(*[F.when(F.col(f"i_{n}"), F.lit(n)) for n in rules.INTENTS]), lambda x: x.isNotNull()))
    loose = [F.when(F.col(f"i_{n}") & _outside(body, p), F.lit(n)) for n, p in rules.PATTERNS.items()]
    quoted = (F.size("intents") > 0) & body.rlike(QUOTES)
    step = step.withColumn("unquoted", F.when(quoted, F.filter(F.array(*loose), lambda x: x.isNotNull())).otherwise(F.col("intents")))
    step = step.drop(*[f"i_{n}" for n in rules.INTENTS])
    step = step.withColumn("override", may_match(low, "overrides") & _any(body, rules.OVERRIDES))
    why = F.coalesce(F.when(may_match(low, "addressing"), F.coalesce(*[F.when(body.rlike(rules.java(p)), F.lit(w)) for w, p in rules.ADDRESSING])), F.when(F.col("override"), F.lit("override")))
    return step.withColumns({"addressed_why": why, "secrecy": may_match(low, "secrecy-gate") & _any(body, [rules.SECRECY]), "imperative": may_match(low, "imperative") & _any(body, rules.IMPERATIVE)}).drop("low")


def _outside(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | outside_quotes(text, p)
    return out


def gated(facts: DataFrame) -> DataFrame:
    """Adds kept: the intents that the gates leave. facts needs delivery and visible beside what with_intents() adds."""
    addressed, non_visible = F.col("addressed_why").isNotNull(), (F.col("delivery") != "visible") | ~F.col("visible")
    general = addressed | non_visible | F.col("secrecy") | F.col("override")
    keep_url = general | F.array_contains("intents", "exfil-data")
    keep_act = general | F.col("imperative")
    kept = F.filter("intents", lambda i: F.when(i == "exfil-url", keep_url).when(i.isin("transaction", "browser-action"), keep_act).otherwise(F.lit(True)))
    return facts.withColumns({"non_visible": non_visible, "kept": kept})


def _severity(intent: Column) -> Column:
    out = F.lit(0)
    for name, (severity, _) in rules.INTENTS.items():
        out = F.when(intent == name, severity).otherwise(out)
    return out


def assess(facts: DataFrame, capabilities=tuple(rules.CAPABILITIES)) -> DataFrame:
    """One row for each segment and capability, with score and level. Capabilities multiply rows after all text work."""
    unknown = set(capabilities) - set(rules.CAPABILITIES)
    if unknown:
        raise ValueError(f"unknown capability: {sorted(unknown)}")
    g = gated(facts)
    addressed, has = F.col("addressed_why").isNotNull(), F.size("kept") > 0
    discounted = F.col("visible") & (F.col("in_code") | (F.size("unquoted") == 0))
    scored = F.when(F.size("unquoted") > 0, F.col("unquoted")).otherwise(F.col("kept"))
    base = F.array_max(F.transform(scored, _severity)) + addressed.cast("int") + (F.col("non_visible") | F.col("hidden")).cast("int")
    g = g.withColumns({"discounted": discounted, "base": F.when(has, F.when(discounted, F.least(base, F.lit(2))).otherwise(base)).otherwise(F.lit(0))})
    # five fixed rows
    caps = facts.sparkSession.createDataFrame([(c, list(rules.CAPABILITIES[c])) for c in capabilities], "capability string, abilities array<string>")
    rows = g.crossJoin(F.broadcast(caps))
    lacking = lambda i: F.lit(False)

    def unreachable(i: Column) -> Column:
        out = lacking(i)
        for name, (_, needs) in rules.INTENTS.items():
            if needs:
                out = out | ((i == name) & ~F.arrays_overlap("abilities", F.array(*map(F.lit, needs))))
        return out

    capable = F.filter("kept", lambda i: i.isin(*rules.CRITICAL_CAPABLE))
    strong = (addressed & F.col("non_visible")) | (F.col("base") >= 6)
    only_url = F.forall("kept", lambda i: i == "exfil-url")
    qualifies = strong & (~only_url | (addressed & F.col("non_visible")))
    four = F.least(F.col("base"), F.lit(4))
    capped = F.when(F.exists("kept", unreachable), four).when((F.size(capable) > 0) & qualifies, F.greatest(F.col("base"), F.lit(6))).otherwise(four)
    notice = (F.size("kept") > 0) & F.forall("kept", lambda i: i == "content-protection") & ~F.col("non_visible")
    score = F.when(has, F.when(notice, F.least(capped, F.lit(2))).otherwise(capped)).otherwise(F.lit(0))
    level = F.element_at(F.array(*map(F.lit, rules.LEVELS)), F.greatest(F.lit(1), F.least(F.lit(5), score)))
    first = F.element_at(F.filter("kept", lambda i: _severity(i) == F.array_max(F.transform("kept", _severity))), 1)
    return rows.withColumns({"score": score, "level": F.when(has, level).otherwise(F.lit("info")), "primary_intent": F.when(has, first)}).drop("abilities", "base")


def explain(assessed: DataFrame) -> DataFrame:
    """Adds a sentence that says why."""
    parts = [
        F.when(F.size("kept") == 0, F.lit("No instruction was found.")),
        F.when(F.size("kept") > 0, F.concat(F.lit("Intents: "), F.array_join("kept", ", "), F.lit("."))),
        F.when(F.col("addressed_why").isNotNull(), F.concat(F.lit("Addressed to an automated reader ("), F.col("addressed_why"), F.lit(")."))),
        F.when(F.col("non_visible"), F.concat(F.lit("Delivered as "), F.col("delivery"), F.lit("."))),
        F.when(F.col("discounted"), F.lit("Discounted: it is quoted, or nothing matched outside quotes.")),
    ]
    return assessed.withColumn("explanation", F.concat_ws(" ", *parts))


def document_segments(docs: DataFrame) -> DataFrame:
    """The lines of documents as visible segments."""
    lines = docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text")).filter(T.norm_key(F.col("text")) != "")
    return lines.withColumns({"delivery": F.lit("visible"), "visible": F.lit(True), "in_code": F.lit(False)})
