"""Corpus filters: unsafe targets, licences, exclusion ledger, duplicates, keyed sampling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions import rules, text as T
from tracewell.session import discard, ship_package, stash

URL = r"(?i)https?://[^\s\"'<>()\]\[]+"
PROTOCOL_RELATIVE = r"(?i)(?:^|[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF\"'(=])//([a-z0-9-]+(?:\.[a-z0-9-]+)+)"
EMAIL_HOST = r"(?i)[0-9A-Za-z_.+-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+)"
IPV4 = r"(?<![0-9A-Za-z_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_])"
WALLET = r"(?<![0-9A-Za-z_])(?:0x[0-9a-fA-F]{40}|bc1[02-9ac-hj-np-z]{11,71})(?![0-9A-Za-z_])"
# Marks of a template that was never filled in.
PLACEHOLDERS = (r"\{[A-Z_][A-Z0-9_]{2,}\}", r"\{\{[^}]{1,60}\}\}", r"(?i)<\s*INSERT\b", r"(?i)<\s*PLACEHOLDER\b", r"\bTODO\b")
# What a record's flags may not say.
DENIED_FLAGS = ("csam", "sexual-minors", "harassment-target", "real-person-target", "weapons-acquisition", "drug-acquisition")
# Sources whose records are left out, licences' statuses that count as verified, least length of a payload.
DENIED_SOURCES, VERIFIED, MIN_CHARS = ("wasp",), ("artifact-verified", "upstream-verified"), 8
# Reasons of exclusion by pass, in the order in which they decide.
LICENCE_CODES = ("EX-WASP", "EX-LIC-UNKNOWN", "EX-LIC-NC", "EX-LIC-ND", "EX-LIC-SA")
SAFETY_CODES = ("EX-UNSAFE-TARGET", "EX-UNSAFE-EXFIL", "EX-UNSAFE-CODE", "EX-UNSAFE-CONTENT")
RELEVANCE_CODES = ("EX-IRRELEVANT-EMPTY", "EX-IRRELEVANT-PLACEHOLDER", "EX-IRRELEVANT-EMBED")


def is_reserved_host(host: Column) -> Column:
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    out = h.isin(*rules.RESERVED_NAMES)
    for s in rules.RESERVED_SUFFIXES:
        out = out | (h == s) | h.endswith("." + s)
    return out


def unsafe_targets(text: Column) -> Column:
    """Distinct (kind, match) of real destinations in a text, by kind."""
    all_ = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    host = lambda u: F.regexp_extract(u, r"(?i)^https?://(?:[^@/?#]*@)?([^/:?#]*)", 1)
    of = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("match")))
    parts = [
        of("url", F.filter(all_(URL), lambda u: ~is_reserved_host(host(u)))),
        of("protocol-relative", F.transform(F.filter(all_(PROTOCOL_RELATIVE, 1), lambda h: ~is_reserved_host(h)), lambda h: F.concat(F.lit("//"), h))),
        of("ipv4", F.filter(all_(IPV4), lambda x: ~x.isin("127.0.0.1", "0.0.0.0"))),
        of("email", F.filter(all_(EMAIL_HOST), lambda x: ~is_reserved_host(F.substring_index(x, "@", -1)))),
        of("wallet", all_(WALLET)),
    ]
    return F.array_distinct(F.concat(*parts))


def classify_licence(value: Column) -> Column:
    """The SPDX name, null where unclear."""
    name = T.licence_name(value)
    return F.coalesce(*[F.when(name.rlike(p), F.lit(spdx)) for spdx, p, *_ in rules.LICENCES])


def licence_flag(spdx: Column, place: int) -> Column:
    """commercial (0), derivatives (1) or share-alike (2) of an SPDX name."""
    return F.coalesce(*[F.when(spdx == r[0], F.lit(r[2 + place])) for r in rules.LICENCES])


def resolve_licence(records: DataFrame, source_map: DataFrame | None = None) -> DataFrame:
    """Adds licence_value, licence_origin (record, source-map, absent) and licence_status. source_map: source, licence, status, one row a source."""
    own = F.trim(F.coalesce(F.col("licence"), F.lit(""))) != ""
    if source_map is None:
        out = records.withColumns({"__l": F.lit(None).cast("string"), "__s": F.lit(None).cast("string")})
    else:
        mapped = source_map.select(F.col("source").alias("__source"), F.col("licence").alias("__l"), F.coalesce("status", F.lit("unverified")).alias("__s"))
        out = records.join(mapped, F.col("source") == F.col("__source"), "left").drop("__source")
    found = F.col("__l").isNotNull()
    return out.withColumns(
        {
            "licence_value": F.when(own, F.col("licence")).otherwise(F.col("__l")),
            "licence_origin": F.when(own, "record").when(found, "source-map").otherwise("absent"),
            "licence_status": F.when(own, "artifact-verified").when(found, F.col("__s")).otherwise("unverified"),
        }
    ).drop("__l", "__s")


def _codes(pairs) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in pairs]))


def licence_codes(spdx: Column, status: Column, source: Column, share_alike_out: bool = True) -> Column:
    """All licence reasons that a record meets, the deciding one first."""
    known = spdx.isNotNull() & status.isin(*VERIFIED)
    tests = (F.lower(source).isin(*DENIED_SOURCES), ~known, known & ~licence_flag(spdx, 0), known & ~licence_flag(spdx, 1), known & licence_flag(spdx, 2) & F.lit(share_alike_out))
    return _codes(zip(LICENCE_CODES, tests))


def safety_code(record: dict[str, Column]) -> Column:
    """The first safety reason of a record, null if it is safe. record: text; targets or where a corpus has them, needs_network, callback_url, executable, flags, real_person."""
    get = lambda n, kind: record.get(n, F.lit(None).cast(kind))
    callback, flags = get("callback_url", "string"), get("flags", "array<string>")
    denied = F.exists(flags, lambda f: F.lower(f).isin(*DENIED_FLAGS))
    tests = (
        F.size(record["targets"] if "targets" in record else unsafe_targets(record["text"])) > 0,
        get("needs_network", "boolean") | (F.coalesce(callback, F.lit("")) != ""),
        get("executable", "boolean"),
        F.coalesce(denied, F.lit(False)) | F.coalesce(get("real_person", "boolean"), F.lit(False)),
    )
    return F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in zip(SAFETY_CODES, tests)])


def relevance_code(text: Column, min_chars: int = MIN_CHARS, embeddable: Column | None = None) -> Column:
    """Empty, placeholder, or (where no placement can hold it) not embeddable; null if relevant."""
    short = T.utf16_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{T.JS_SPACE}|{T.JS_SPACE}$", "")) < min_chars
    marks = F.lit(False)
    for p in PLACEHOLDERS:
        marks = marks | text.rlike(p)
    tests = (short, marks, ~embeddable if embeddable is not None else F.lit(False))
    return F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in zip(RELEVANCE_CODES, tests)])


FACTS = ("needs_network", "callback_url", "executable", "flags", "real_person")


def ledger(records: DataFrame, min_chars: int = MIN_CHARS, source_map: DataFrame | None = None, embeddable: Column | None = None) -> DataFrame:
    """Adds reason_code (of the first pass that excludes: licence, safety, relevance; null: included), also (later passes' codes),
    also_matched (further licence codes), decided_by and review (a denied source with a licence that allows all).

    records: text, licence, and where known source, needs_network, callback_url, executable, flags, real_person.
    """
    held = records if "source" in records.columns else records.withColumn("source", F.lit(None).cast("string"))
    spdx = classify_licence(F.col("licence_value"))
    out = resolve_licence(held, source_map).withColumn("spdx", spdx)
    # what an earlier pass excludes needs no targets for its own reason, but for the list of all reasons
    out = out.withColumn("__licence", licence_codes(F.col("spdx"), F.col("licence_status"), F.col("source")))
    record = {"text": F.col("text")} | {n: F.col(n) for n in FACTS if n in records.columns}
    passes = F.array_compact(F.array(F.get("__licence", F.lit(0)), safety_code(record), relevance_code(F.col("text"), min_chars, embeddable)))
    out = out.withColumn("__passes", passes)
    first = F.get("__passes", F.lit(0))
    review = F.coalesce(F.lower("source").isin(*DENIED_SOURCES) & licence_flag(F.col("spdx"), 0), F.lit(False))
    out = out.withColumns({"reason_code": first, "also": F.slice("__passes", 2, 3), "also_matched": F.slice("__licence", 2, 9), "decided_by": F.concat(F.lit("rule:"), F.coalesce(first, F.lit("include"))), "review": review})
    return out.drop("__licence", "__passes", *(() if "source" in records.columns else ("source",)))


def reason_counts(decided: DataFrame) -> DataFrame:
    """Records by reason of exclusion; those included count as INCLUDED."""
    return decided.groupBy(F.coalesce("reason_code", F.lit("INCLUDED")).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


def dedupe(records: DataFrame, near: float) -> DataFrame:
    """Each record with level (null: kept; byte, text, near) and duplicate_of, by passes in order (sha, line_no, uid).

    A near duplicate is one of word similarity >= near with a record that is *kept*. Records of equal word sets share their
    fate: the first of them is kept or has a kept one before it, and the others follow it. Over the pairs of different sets
    that reach `near` the choice is made in rounds: what has no undecided or kept pair before it is kept, what has a kept one
    is dropped. Rounds end after the longest chain of pairs; what is left of each is written, so a lost executor costs a round.
    """
    if not 0 < near <= 1:
        raise ValueError("near has to be in (0, 1]")
    order, place = F.struct("sha", "line_no", "uid"), F.struct("line_no", "uid")
    key, tokens = F.unhex(F.sha2(T.norm_key(F.col("text")), 256)), T.token_set(T.without_zero_width(F.col("text")))
    sets = _word_sets(records.select("sha", "line_no", "uid", key.alias("key"), tokens.alias("tokens")))
    classes, pairs = _similar_sets(sets, near)
    held = sets.select("row", "sha", "line_no", "uid", "key").withColumns({"level": F.lit(None).cast("string"), "duplicate_of": F.lit(None).cast("string")})
    # joins, not windows: copies of one record can be many. What a join finds is cut to level and uid before the next one
    for level, by, mine in (("byte", "sha", place), ("text", "key", order)):
        least = sets.groupBy(F.col(by).alias("of")).agg(F.min(mine).alias("first"))
        held = held.join(least, F.col(by).eqNullSafe(F.col("of")))
        later = F.col("level").isNull() & (mine != F.col("first"))
        held = held.withColumns({"level": F.when(later, level).otherwise(F.col("level")), "duplicate_of": F.when(later, F.col("first.uid")).otherwise(F.col("duplicate_of"))}).drop("of", "first")
    held = stash(held.join(classes, "row", "left").select("sha", "line_no", "uid", "level", "duplicate_of", "set"), "dedupe")
    discard(sets, classes)
    leaders = stash(held.filter("set IS NOT NULL").groupBy("set").agg(F.min(order).alias("id")), "leaders")
    first, second = leaders.select(F.col("set").alias("a"), F.col("id").alias("ia")), leaders.select(F.col("set").alias("b"), F.col("id").alias("ib"))
    # from here on a set is its number, and only the pair's direction says which comes first
    forward = F.struct("ia", "a") < F.struct("ib", "b")
    found = pairs.select("a", "b").join(first, "a").join(second, "b")
    ordered = stash(found.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("b")), "pairs")
    discard(pairs)
    known = ordered.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumns({"kept": F.lit(None).cast("boolean")})
    while True:
        before = ordered.join(known.select(F.col("id").alias("a"), F.col("kept").alias("earlier")), "a").groupBy("b").agg(F.bool_or(F.coalesce("earlier", F.lit(False))).alias("hit"), F.bool_or(F.col("earlier").isNull()).alias("open"))
        decided = F.coalesce(F.col("kept"), F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True))
        last, known = known, stash(known.join(before, known["id"] == before["b"], "left").select("id", decided.alias("kept")), "known")
        discard(last)
        if known.filter("kept IS NULL").isEmpty():
            break
    hits = ordered.join(known.filter("kept").select(F.col("id").alias("a")), "a", "left_semi").join(known.filter("NOT kept").select(F.col("id").alias("b")), "b", "left_semi")
    near_of = hits.join(first, "a").groupBy(F.col("b").alias("set")).agg(F.min("ia").alias("near_of"))
    fate = leaders.join(near_of, "set", "left")
    out = held.join(fate, "set", "left")
    near_of = F.when(F.col("level").isNull(), F.coalesce("near_of", F.when(order != F.col("id"), F.col("id"))))
    out = out.withColumn("near_of", near_of)
    return out.select("sha", "line_no", "uid", F.when(F.col("near_of").isNotNull(), "near").otherwise(F.col("level")).alias("level"), F.coalesce("near_of.uid", "duplicate_of").alias("duplicate_of"))


def funnel(decided: DataFrame, deduped: DataFrame, target: int) -> DataFrame:
    """One row: records in all, excluded, duplicates, eligible, sampled, and whether the sample falls short of its target."""
    a = decided.agg(F.count(F.lit(1)).alias("total"), F.count("reason_code").alias("excluded"))
    b = deduped.agg(F.count("level").alias("duplicates"), F.count_if(F.col("level").isNull()).alias("eligible"))
    # two rows of sums, each by itself
    rows = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")
    return rows.withColumns({"sampled": F.least("eligible", F.lit(target).cast("long")), "target": F.lit(target).cast("long"), "shortfall": F.col("eligible") < target})


def dedupe_exact(records: DataFrame) -> DataFrame:
    """The first record of each byte-equal, then text-equal group, in order (sha, line_no, uid). records: sha, line_no, uid, text."""
    order = ["sha", "line_no", "uid"]
    firsts = records.groupBy("sha").agg(F.min_by(F.struct(*[c for c in records.columns if c != "sha"]), F.struct("line_no", "uid")).alias("r")).select("sha", "r.*")
    keyed = firsts.withColumn("key", T.norm_key(F.col("text")))
    return keyed.groupBy("key").agg(F.min_by(F.struct(*records.columns), F.struct(*order)).alias("r")).select("r.*")


BUCKETS = 20  # bits of a word's hash that choose its counter
BITS = 256  # of a set's parity sketch
WIDE, LONG = 4096, 800  # bits of a second sketch, and how many words a set has that gets one
SLICE_WORDS = 1 << 19
SLACK = 1e-9  # for products of sizes and thresholds, which are rounded


def _word_sets(records: DataFrame) -> DataFrame:
    """records with the words (tokens) of each as a written table: a number for each row, the words' 64-bit hashes in order."""
    hashes = F.sort_array(F.transform("tokens", lambda w: F.xxhash64(w)))
    return stash(records.withColumns({"row": F.monotonically_increasing_id(), "words": hashes}).drop("tokens"), "word-sets")


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Which row each value of a list column belongs to, and the values."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _slices(batches):
    """Batches cut into rows of SLICE_WORDS words together, or one row, so that memory doesn't follow the rows' length."""
    for batch in batches:
        ends = np.cumsum(batch.column("words").value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_WORDS, "right")))
            yield batch.slice(at, to - at)
            at = to


def _counts(batches):
    """Records by bucket of their words' hashes."""
    n = np.zeros(1 << BUCKETS, np.int64)
    for batch in _slices(batches):
        _, words = _flat(batch.column("words"))
        n += np.bincount(words.view(np.uint64) >> np.uint64(64 - BUCKETS), minlength=len(n))
    at = np.flatnonzero(n)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["bucket", "n"])


def _sketches(rarity, threshold: float):
    """row, digest, n, parity sketch and prefix of each set: its first words by rarity that others can share."""

    def fn(batches):
        step = rarity.value
        for batch in _slices(batches):
            column = batch.column("words")
            who, words = _flat(column)
            n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            bits = np.bincount(who * BITS + (words & (BITS - 1)), minlength=len(n) * BITS).astype(np.uint8) & 1
            bits = np.packbits(bits).view(np.int64).reshape(len(n), BITS // 64)
            rare = step[words.view(np.uint64) >> np.uint64(64 - BUCKETS)]
            # words are in order of hashes, which a stable sort leaves among equally rare ones
            by = np.lexsort((rare, who))
            most = np.minimum(n, n - np.ceil(n * threshold - SLACK).astype(np.int64) + 1)
            rank = np.arange(len(by)) - np.repeat(ends - n, n)
            taken = by[(rank < np.repeat(most, n)) & (rare[by] > 0)]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(who[taken], minlength=len(n)))]).astype(np.int32)
            digests = [hashlib.blake2b(words[b - k : b].tobytes(), digest_size=16).digest() for b, k in zip(ends.tolist(), n.tolist())]
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[taken]))
            sketch = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(BITS // 64)]
            wide = np.full(len(n), None, object)
            if len(long := np.flatnonzero(n >= LONG)):
                mine, place = n[who] >= LONG, np.cumsum(n >= LONG) - 1
                odd = np.bincount(place[who[mine]] * WIDE + ((words[mine] >> 8) & (WIDE - 1)), minlength=len(long) * WIDE).astype(np.uint8) & 1
                wide[long] = [x.tobytes() for x in np.packbits(odd).reshape(len(long), WIDE // 8)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), *sketch, pa.array(wide.tolist(), pa.binary()), prefix], names=["row", "digest", "n", *_SKETCH, "wide", "prefix"])

    return fn


_SKETCH = [f"s{k}" for k in range(BITS // 64)]


BLOCK_BYTES = 4 << 20  # of sets that are compared in one group
BLOCK_PAIRS = 1 << 17  # of one family in a group


def _block_count(sets: DataFrame) -> int:
    size = int(str(sets._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * sets.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))


def _blocks(found: DataFrame, blocks: int) -> DataFrame:
    """Pairs (a, b) with the block in which they are compared. A family (sets with one smallest neighbour) meets in one block,
    so that its sets are sent once and not for each pair; one of very many pairs is dealt to several."""
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    family = ends.groupBy("a").agg(F.least("a", F.min("b")).alias("f"))
    pairs = found.join(family.withColumnRenamed("f", "fa"), "a").join(family.withColumnsRenamed({"a": "b", "f": "fb"}), "b")
    pairs = pairs.select("a", "b", F.least("fa", "fb").alias("f"))
    many = pairs.groupBy("f").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / BLOCK_PAIRS)).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    key = F.xxhash64("f", F.least(part("a"), part("b")), F.greatest(part("a"), part("b")))
    return pairs.join(many, "f").select("a", "b", F.pmod(key, F.lit(blocks)).cast("int").alias("block"))


def _closer(threshold: float):
    """Pairs of one block without those of long sets whose wide sketches differ in too many bits."""

    def fn(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        keep = np.ones(pairs.num_rows, bool)
        if sets.num_rows and pairs.num_rows:
            rows = sets.column("row").to_numpy()
            by_row = np.argsort(rows)
            rows, n = rows[by_row], sets.column("n").to_numpy()[by_row].astype(np.int64)
            bits = np.frombuffer(b"".join(sets.column("wide").to_pylist()), np.uint64).reshape(len(rows), WIDE // 64)[by_row]
            at = [np.minimum(np.searchsorted(rows, x), len(rows) - 1) for x in (pairs.column(c).to_numpy() for c in "ab")]
            both = np.flatnonzero((rows[at[0]] == pairs.column("a").to_numpy()) & (rows[at[1]] == pairs.column("b").to_numpy()))
            for k in range(0, len(both), 1 << 13):
                part = both[k : k + (1 << 13)]
                a, b = at[0][part], at[1][part]
                keep[part] = np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= (n[a] + n[b]) * ((1 - threshold) / (1 + threshold)) + SLACK
        return pairs.select(["a", "b", "block"]).filter(pa.array(keep))

    return fn


def _count_shared(threshold: float):
    """Jaccard of the pairs of one block over whole sets; those that reach the threshold."""

    def fn(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        rows = sets.column("row").to_numpy()
        column = sets.column("words").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        who, words = _flat(column)
        vocabulary, codes = np.unique(words, return_inverse=True)
        n = np.bincount(who, minlength=len(rows))
        starts = np.cumsum(n) - n
        by_row = np.argsort(rows)
        a, b = (by_row[np.searchsorted(rows[by_row], pairs.column(c).to_numpy())] for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        shared, mark = np.zeros(len(a), np.int64), np.zeros(len(vocabulary), bool)
        # pairs of one a, as many at once as have SLICE_WORDS words
        total = np.cumsum(n[b])
        at = 0
        while at < len(a):
            to = int(np.searchsorted(a, a[at], "right"))
            to = min(to, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_WORDS, "right"))))
            mine = codes[starts[a[at]] : starts[a[at]] + n[a[at]]]
            mark[mine] = True
            size = n[b[at:to]]
            heads = np.cumsum(size) - size
            theirs = codes[np.repeat(starts[b[at:to]] - heads, size) + np.arange(int(size.sum()))]
            shared[at:to] = np.add.reduceat(mark[theirs].astype(np.int64), heads)
            mark[mine] = False
            at = to
        similarity = shared / (n[a] + n[b] - shared)
        good = similarity >= threshold
        return pa.table({"a": rows[a[good]], "b": rows[b[good]], "similarity": similarity[good]})

    return fn


MARKS = 17  # bits of an id's hash that choose its long in a bitmap, whatever the number of ids


def _marked(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """table without most of the rows that are in no pair (a, b), before anything of it is dealt out. The bitmap of the ids' hashes
    has a fixed size, so it can go to all; what it lets through goes to a join that is exact."""
    h = F.xxhash64("row")
    slot, bit = F.shiftrightunsigned(h, 64 - MARKS), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    marks = pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("marks"))
    return table.join(F.broadcast(marks), (slot == F.col("slot")) & (F.col("marks").bitwiseAND(bit) != 0)).select(table.columns)


def _similar_sets(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """classes (row, set: a number for rows of equal words; none for rows without words) and pairs (a, b, similarity) of
    different sets with Jaccard >= threshold, as written tables. sets: a table of _word_sets.

    A prefix filter: words are in one order, two sets that reach the threshold share one of their first
    n - ceil(threshold * n) + 1 words. Any order will do; here words of buckets with fewer records come first, and what is
    alone in its bucket is shared by none. Pairs with too different sizes go at once, as do those whose sketches (of each
    bit the parity of words) differ in more bits than so similar sets can differ in words; long sets have a second, wider sketch. Only ids and sketches are dealt
    out for this; all pairs that are left are counted over whole sets, which go to blocks and not to each pair.
    """
    spark = sets.sparkSession
    ship_package(spark)
    full = sets.filter(F.size("words") > 0).select("row", "words")
    counts = full.select("words").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    step = np.zeros(1 << BUCKETS, np.uint8)  # 0: one record, from there on eight steps to a doubling
    step[counts.column("bucket").to_numpy()] = np.minimum(8 * np.log2(counts.column("n").to_numpy()), 255).astype(np.uint8)
    rarity = spark.sparkContext.broadcast(step)
    kinds = "row long, digest binary, n int, " + ", ".join(f"{c} long" for c in _SKETCH) + ", wide binary, prefix array<long>"
    each = stash(full.mapInArrow(_sketches(rarity, threshold), kinds), "sketches")
    own = each.groupBy("digest").agg(F.min("row").alias("set"))
    classes = stash(each.select("row", "digest").join(own, "digest").select("row", "set"), "set-classes")
    firsts = each.join(classes.filter("row = set").select("row"), "row", "left_semi").withColumnRenamed("row", "id")
    prefix = firsts.select(F.explode("prefix").alias("t"), "id", "n", *_SKETCH)
    a, b = (prefix.withColumnsRenamed({c: c + x for c in ("id", "n", *_SKETCH)}) for x in "ab")
    differ = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in _SKETCH), F.lit(0))
    close = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - SLACK) & (differ <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + SLACK)
    found = stash(a.join(b, "t").filter((F.col("ida") < F.col("idb")) & close).select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "candidates")
    keyed = stash(_blocks(found, _block_count(full)), "candidate-blocks")
    to = lambda t, pairs: _marked(t, pairs).join(pairs.select(F.explode(F.array("a", "b")).alias("row"), F.col("block").alias("to")).distinct(), "row")
    sketched = to(each.filter("wide IS NOT NULL").select("row", "n", "wide"), keyed)
    closer = stash(keyed.groupBy("block").cogroup(sketched.groupBy("to")).applyInArrow(_closer(threshold), "a long, b long, block int"), "closer")
    shipped = to(full, closer).select("to", "row", "words")
    counted = closer.groupBy("block").cogroup(shipped.groupBy("to")).applyInArrow(_count_shared(threshold), "a long, b long, similarity double")
    pairs = stash(counted, "similar-sets")
    rarity.unpersist()
    discard(each, found, keyed, closer)
    return classes, pairs


def similar_pairs(records: DataFrame, threshold: float = 0.9) -> DataFrame:
    """a, b, similarity of records (id, same, tokens array) with Jaccard of the token sets >= threshold. Records of equal
    `same`, which have equal tokens, are one with the smallest id. Tokens are compared by 64-bit hashes."""
    sets = _word_sets(records.select("id", "same", "tokens"))
    classes, pairs = _similar_sets(sets, threshold)
    firsts = sets.select("row", "id", "same").join(classes, "row").groupBy("same").agg(F.min("id").alias("id"), F.min("set").alias("set"))
    firsts = stash(firsts.select("id", "set"), "set-members")
    discard(sets, classes)
    a, b = firsts.select(F.col("id").alias("a"), F.col("set").alias("sa")), firsts.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    equal = a.join(b, (F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(1.0).alias("similarity"))
    other = pairs.withColumnsRenamed({"a": "sa", "b": "sb"}).join(a, "sa").join(b, "sb").filter(F.col("a") != F.col("b"))
    return other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").unionByName(equal)


def keyed_sample(records: DataFrame, n: int, seed: str) -> DataFrame:
    """n records with the smallest keyed hashes of their sha, ranked. The same whatever the input's order."""
    top = records.withColumn("sample_key", T.sampling_key(seed, F.col("sha"))).orderBy("sample_key", "line_no", "uid").limit(n)
    return top.withColumn("sample_rank", F.row_number().over(W.orderBy("sample_key", "line_no", "uid")))
