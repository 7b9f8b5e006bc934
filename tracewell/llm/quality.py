"""Operator 10: quality rules judged by host.

Every document is measured by text rules. Failures of the rules are added up by host, each host's rate is shrunk
towards the whole corpus by a beta prior whose two parameters are fitted to the hosts (method of moments), and the
host's verdict goes back to its documents. A host is trusted if it fails less than the corpus does, with odds of three to
one by its beta posterior: shrunk rate plus TRUST standard deviations lies under the prior's mean.

* A document that fails a base rule is rejected: fewer than MIN_WORDS words, or more than a fifth of its words in
  repeated 5-word windows.
* A document that fails SOFT_LIMIT or more of the soft rules is rejected anywhere; one that fails fewer is kept only
  where its host is trusted.
* A document that fails no rule is kept, whatever its host.

Null text counts as a text without words; whole texts are read, however long; a null host is a host of its own; rows
with equal ids are judged by themselves; an empty table gives an empty result; further columns of the input don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import map_rows, stash

MIN_WORDS = 10
REPEAT_SHARE = 20  # per cent of words in repeated windows
SYMBOL_SHARE = 10  # symbols for each 100 words
DUP_LINE_LIMIT = 3
MEAN_WORD = (2, 16)
SOFT_LIMIT = 2
TRUST = 0.67  # standard deviations: three to one
PRIOR_WEIGHT = (1.0, 1000.0)
WINDOW = 5

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    # bytes.split() splits at exactly \x20 and \x09-\x0D
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found at least twice."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, upto = 0, 0
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered += k + WINDOW - max(k, upto)
            upto = k + WINDOW
    return covered


def _measure(cols: dict, _state: dict) -> dict:
    rows = [text_stats(x) for x in cols["text"]]
    names = [c.split()[0] for c in STATS.split(", ")]
    return {"doc_id": cols["doc_id"], "host": cols["host"], "text_key": cols["text_key"]} | {c: [r[k] for r in rows] for k, c in enumerate(names)}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, text_key, the five counts, base_failed and n_soft (failed soft rules) of each row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    m = stash(map_rows(slim, _measure, "doc_id long, host string, text_key long, " + STATS), "quality")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    soft = [
        100 * F.col("n_symbols") > SYMBOL_SHARE * F.col("n_words"),
        F.col("n_dup_lines") >= DUP_LINE_LIMIT,
        (F.col("word_chars") < MEAN_WORD[0] * F.col("n_words")) | (F.col("word_chars") > MEAN_WORD[1] * F.col("n_words")),
    ]
    return m.withColumns({"base_failed": base, "n_soft": sum((x.cast("long") for x in soft[1:]), soft[0].cast("long"))})


def host_rates(measured: DataFrame) -> DataFrame:
    """host, docs, failed, rate, trusted: failure rates shrunk by a beta prior fitted to the hosts, and the verdict on them."""
    failed = (F.col("base_failed") | (F.col("n_soft") > 0)).cast("long")
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(failed).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    # one row: sums over hosts
    total = hosts.agg(F.sum("docs").alias("d"), F.sum("failed").alias("f"), F.sum(rate * F.col("failed")).alias("rf")).first()
    d, f, rf = total["d"] or 0, total["f"] or 0, total["rf"] or 0.0
    mean = f / d if d else 0.0
    spread = max(rf / d - mean * mean, 0.0) if d else 0.0  # variance of the hosts' rates, weighted by documents
    lo, hi = PRIOR_WEIGHT
    weight = min(max(mean * (1 - mean) / spread - 1, lo), hi) if spread > 1e-12 else hi
    shrunk = hosts.withColumn("rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight)))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("docs") + F.lit(weight) + 1))
    return shrunk.withColumn("trusted", F.col("rate") + F.lit(TRUST) * spread < F.lit(mean))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each document: doc_id, text_key, counts, base_failed, n_soft, host_rate, host_trusted, kept."""
    measured = measure(docs, id_col, text_col, host_col)
    hosts = host_rates(measured).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), F.col("trusted").alias("host_trusted"))
    kept = ~F.col("base_failed") & (F.col("n_soft") < SOFT_LIMIT) & ((F.col("n_soft") == 0) | F.col("host_trusted"))
    return measured.join(hosts, measured["host"].eqNullSafe(hosts["h"]), "left").drop("h").withColumn("kept", kept)


def host_quality(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs. Verdicts are joined by id and text."""
    dropped = judge(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(dropped, on, "left_anti")


ORACLE_SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS p FROM words),
windows AS (
  SELECT r, p, t || chr(32) || lead(t, 1) OVER o || chr(32) || lead(t, 2) OVER o || chr(32) || lead(t, 3) OVER o || chr(32) || lead(t, 4) OVER o AS win
  FROM tokens WINDOW o AS (PARTITION BY r ORDER BY p)),
counted AS (SELECT r, p, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM windows),
covered AS (SELECT r, max(twice::INT) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM counted),
repeats AS (SELECT r, sum(c) AS n FROM covered GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r)),
flagged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed,
         (100 * n_symbols > {SYMBOL_SHARE} * n_words)::INT + (n_dup_lines >= {DUP_LINE_LIMIT})::INT
         + (word_chars < {MEAN_WORD[0]} * n_words OR word_chars > {MEAN_WORD[1]} * n_words)::INT AS n_soft FROM measured),
hosts AS (SELECT source, count(*) AS docs, sum((base_failed OR n_soft > 0)::INT)::BIGINT AS failed FROM flagged GROUP BY source),
total AS (SELECT sum(failed) / sum(docs) AS mean, sum(failed * failed / docs) / sum(docs) - power(sum(failed) / sum(docs), 2) AS spread FROM hosts),
prior AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) ELSE {PRIOR_WEIGHT[1]} END AS weight FROM total),
shrunk AS (SELECT source, docs, mean, weight, (failed + mean * weight) / (docs + weight) AS rate FROM hosts, prior),
rates AS (SELECT source, rate + {TRUST} * sqrt(rate * (1 - rate) / (docs + weight + 1)) < mean AS trusted FROM shrunk)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words, base_failed, NOT base_failed AND n_soft < {SOFT_LIMIT} AND (n_soft = 0 OR trusted) AS kept
FROM flagged JOIN rates ON flagged.source IS NOT DISTINCT FROM rates.source
"""
