"""Operator 3: personal data, with information-theoretic sanitisation of what is written around it.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers, found by pattern. Each value is a
protected entity e. For each term t (a word of three letters or more) in a document with an entity, corpus counts say
how strongly it reveals the entity: PMI(t; e) = log2(P(t, e) / (P(t) P(e))), against IC(e) = -log2 P(e), what there is
to reveal. P(t) and P(t, e) are over whole documents, all of them; copies count each. A term with PMI >= DISCLOSES * IC
discloses; a ratio of 1 means that whoever reads the term can tell the entity. Such a term is generalised to its stem,
its first STEM letters, which stands for all terms that begin so: `Zorblatt` becomes `Zorb*`. The stem is held to the
same measure, by the documents that have any term with it; where it still discloses, or the term is no longer than a
stem, the term is removed. Terms are touched wherever they stand in a document that holds the entity that they reveal,
so a document without base spans stays as it is.

Entities found in the same texts have the same counts with every term. They are counted as one class, so the many
values of a long list cost no more than one. As P(t, e) <= P(e), a term in more than N^(1 - DISCLOSES) *
n(e)^DISCLOSES documents can't reach the limit; such terms leave before pairs are made.

Null text counts as empty and stays null when sanitised; very long texts are read whole. Rows of equal id and text get the same spans; a null id is
allowed; empty tables give empty results; further columns don't matter (and pass through sanitise()).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import map_rows, stash
from tracewell.session import parts_for, ship_package

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSES, STEM = 0.9, 4

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small_parts(x: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in x.split("."))


def _digits(x: str) -> str:
    return "".join(_DIGIT.findall(x))


def _emails(text: str):
    """Matches of _EMAIL, tried only at the runs of local-part characters that end in an @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted; kind is a place in KINDS."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _small_parts(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _entity(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _digits(value)}"


def stem(term: str) -> str:
    """The generalised form of a lower-case term; no term ends in a star."""
    return term[:STEM] + "*"


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Places (start, end) of each term, by term; none inside of spans."""
    out: dict[str, list[tuple[int, int]]] = {}
    ends, at, upto = sorted((a, b) for a, _, b in spans), 0, 0
    for m in _TERM.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            upto = max(upto, ends[at][1])
            at += 1
        places = out.setdefault(m[0].lower(), [])
        if upto <= m.start():
            places.append((m.start(), m.end()))
    return out


def _scan(cols: dict, _state: dict) -> dict:
    out: dict = {k: [] for k in ("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "places")}
    out["doc_id"], out["text_key"] = cols["doc_id"], cols["text_key"]
    for text in cols["text"]:
        spans = base_spans(text)
        for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
            out[name].append(sum(s[1] == k for s in spans))
        out["base_sha256"].append(hashlib.sha256(span_text(spans).encode()).hexdigest())
        out["base"].append([{"a": a, "k": k, "b": b} for a, k, b in spans])
        out["entities"].append(sorted({_entity(k, text[a:b]) for a, k, b in spans}))
        places = free_terms(text, spans) if spans else {}
        stems = {stem(t): [] for t in places}
        out["places"].append([{"t": t, "at": [{"a": a, "b": b} for a, b in at]} for t, at in (places | stems).items()])
    return out


def _document_terms(cols: dict, _state: dict) -> dict:
    """Documents that hold each term and each stem, for the texts of one slice: a partial sum."""
    seen: dict[str, int] = {}
    for text in cols["text"]:
        if text:
            terms = {x.lower() for x in set(_TERM.findall(text))}
            for t in terms | set(map(stem, terms)):
                seen[t] = seen.get(t, 0) + 1
    return {"t": list(seen), "c": list(seen.values())}


SCAN = (
    "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<a: int, k: int, b: int>>, entities array<string>, places array<struct<t: string, at: array<struct<a: int, b: int>>>>"
)


def entity_classes(held: DataFrame) -> DataFrame:
    """text_key, class, ne: the classes of entities in each text and the documents that hold them. held: text_key, copies, entities."""
    each = held.select("text_key", "copies", F.explode("entities").alias("e"))
    same = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("text_key")).alias("x"), F.bit_xor(F.xxhash64("text_key", F.lit(1))).alias("y"))
    alone = each.groupBy("e").agg(F.sum("copies").alias("ne"), same.alias("class"))
    return each.select("text_key", "e").join(alone, "e").select("text_key", "class", "ne").distinct()


def disclosing(texts: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """text_key, t, at, ratio of the terms (and stems) that reveal an entity of their text. texts: text_key, copies, entities, places, one row each; terms: t, c."""
    n = F.lit(float(max(documents, 1)))
    most = F.pow(n, F.lit(1 - DISCLOSES)) * F.pow("ne", F.lit(DISCLOSES)) * (1 + 1e-9)
    classes = stash(entity_classes(texts.select("text_key", "copies", "entities")), "classes")
    df = terms.groupBy("t").agg(F.sum("c").alias("nt"))
    top = classes.groupBy("text_key").agg(F.max(most).alias("top"))
    each = texts.select("text_key", "copies", F.explode("places").alias("x")).select("text_key", "copies", "x.t", "x.at")
    rare = stash(each.join(df, "t").join(top, "text_key").filter(F.col("nt") <= F.col("top")).drop("top"), "rare")
    pairs = rare.select("text_key", "t", "copies", "nt").join(classes, "text_key").filter(F.col("nt") <= most)
    joint = pairs.groupBy("t", "class").agg(F.sum("copies").alias("nte"), F.first("nt").alias("nt"), F.first("ne").alias("ne"))
    pmi = F.log2(n * F.col("nte") / (F.col("nt") * F.col("ne")))
    found = joint.withColumn("ratio", F.when(F.col("ne") < n, pmi / F.log2(n / F.col("ne"))).otherwise(F.lit(0.0))).filter(F.col("ratio") >= DISCLOSES)
    strong = pairs.select("text_key", "t", "class").join(found.select("t", "class", "ratio"), ["t", "class"]).groupBy("text_key", "t").agg(F.max("ratio").alias("ratio"))
    return rare.select("text_key", "t", "at").join(strong, ["text_key", "t"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base counts and digest, base: spans (a, k, b), terms: further spans (a, b, cut)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    scan = stash(map_rows(slim, _scan, SCAN), "pii")
    texts = scan.filter(F.size("entities") > 0).groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("places").alias("places"))
    terms = map_rows(slim.select("text"), _document_terms, "t string, c long")
    found = stash(disclosing(texts, terms, scan.count()).select("text_key", "t", "at"), "disclosing")
    stems = found.filter(F.col("t").endswith("*")).select("text_key", F.col("t").alias("stem"), F.lit(True).alias("told"))
    each = found.filter(~F.col("t").endswith("*")).withColumn("stem", F.concat(F.substring("t", 1, STEM), F.lit("*"))).join(stems, ["text_key", "stem"], "left")
    each = each.select("text_key", (F.coalesce("told", F.lit(False)) | (F.length("t") <= STEM)).alias("cut"), F.explode("at").alias("x"))
    # written, so that the join with all rows is a plain one, which Spark splits where a text has many copies
    cut = stash(each.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("x.a", "x.b", "cut"))).alias("terms")), "cuts", parts_for(scan))
    joined = scan.drop("entities", "places").join(cut, "text_key", "left").select("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "terms")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<a: int, b: int, cut: boolean>>")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans as kind:start:end, by start then kind."""
    extra = F.transform("terms", lambda x: F.struct(x["a"].alias("a"), F.lit(4).alias("k"), x["b"].alias("b")))
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(F.array_sort(F.concat("base", extra)), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string")))
    return find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(each, ",").alias("spans"))


def redact(text: str, terms: list[tuple[int, int, bool]]) -> str:
    """Base spans become <KIND>, generalised terms their stem and a star; removed terms go. Overlapping spans become one, named by the first."""
    spans = sorted([(a, b, f"<{KINDS[k].upper()}>") for a, k, b in base_spans(text)] + [(a, b, "" if cut else text[a : a + STEM] + "*") for a, b, cut in terms])
    out, at = [], 0
    for a, b, name in spans:
        if a >= at:
            out += [text[at:a], name]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redact_all(text: pd.Series, terms: pd.Series) -> pd.Series:
    def one(x, spans):
        if x is None or not x:
            return x
        cut = [tuple(map(int, s.split(":"))) for s in spans.split(",")] if spans else []
        return redact(x, [(a, b, bool(c)) for a, b, c in cut])

    return pd.Series([one(x, s) for x, s in zip(text, terms)], dtype=object)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data and what reveals it replaced in text, and n_chars set anew where there is such a column."""
    ship_package(docs.sparkSession)
    cuts = find(docs).filter(F.size("terms") > 0)
    code = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"), x["cut"].cast("int").cast("string"))), ",")
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), code.alias("__terms")).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    udf = F.pandas_udf(_redact_all, "string")
    whole = docs.join(cuts, on, "left").withColumn("text", udf("text", F.coalesce("__terms", F.lit("")))).select(*docs.columns)
    if "n_chars" in docs.columns:
        whole = whole.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return whole
