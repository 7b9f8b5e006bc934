"""Operator 5: near-duplicate documents by MinHash with tensored banding.

Each document's set of word shingles gets 2 * c small collections of ROWS minhashes each, one half on a left and one
half on a right side. A table of the usual banding scheme is a pair (left collection, right collection), so c ** 2
tables of 2 * ROWS minhashes cost 2 * c * ROWS hash functions instead of 2 * c ** 2 * ROWS. A pair of documents meets
in some table if one of its left and one of its right collections agree; at similarity s it misses with probability
2 * (1 - s ** ROWS) ** c at most, and c is the smallest number that keeps this under MISS at the threshold (12 at 0.85).

From meeting to linking, without all pairs of a group:

1. Equal sets become one class, so exact copies cost one row.
2. Collections that nobody shares are dropped before tables are formed.
3. In each bucket every member is tested against a leader on the full sets; verified links give components.
4. In buckets that still hold several components, members are tested against the member with most links so far,
   some rounds long.
5. Last, members that can't reach another one are peeled off by an exact bound (see _peel), and pairs of *different*
   components among the rest are tested, if a sketch of 2048 one-bit minhashes leaves them within 5.7 standard
   deviations of the threshold (1e-8 of links lost). Members of a large collection meet in blocks. A pair that meets in
   a table is left untested only inside one component or where a bound rules a link out.

Null or wordless text has an empty set: linked with nothing. Shingles are 64-bit hashes of words mixed in order.
Documents with fewer words than a shingle have one shingle, the whole sequence. Each row is a document of its own, also
where ids repeat with different texts; classes are named by row numbers, components by their smallest id. A null id
gets a null component and is not kept. Very long texts are read whole, their minhashes taken in parts. Empty tables
give empty results; further columns don't matter (and pass through keep_first_copies()).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import map_rows, stash
from tracewell.llm.components import components
from tracewell.session import discard, parts_for, ship_package

SHINGLE = 3
THRESHOLD = 85  # per cent
ROWS = 3
MISS = 3e-5
LEADER_ROUNDS = 1
PEEL_ROUNDS = 1
BITS = 2048
BLOCK = 512  # members of a collection that meet in one task at most


@dataclass(frozen=True)
class Settings:
    """Words of a shingle and the similarity of a link in per cent; what follows from them."""

    width: int = SHINGLE
    per_cent: int = THRESHOLD

    @property
    def collections(self) -> int:
        """On each side."""
        return math.ceil(math.log(MISS / 2) / math.log1p(-((self.per_cent / 100) ** ROWS)))

    @property
    def apart(self) -> int:
        """Of BITS, how many may differ: 5.7 standard deviations above the mean of a pair at the threshold."""
        p = (1 - self.per_cent / 100) / 2
        return int(BITS * p + 5.7 * math.sqrt(BITS * p * (1 - p)))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _functions(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n hash functions, from number `first` on, xor and multiply with."""
    with np.errstate(over="ignore"):
        xor = _mix(np.arange(first, first + n, dtype=np.uint64) * _M1)
        return xor, _mix(xor + _M1) | np.uint64(1)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text."""
    split = [x.encode("utf-8", "surrogatepass").lower().split() if x else [] for x in texts]  # bytes.lower() lowers A-Z only
    flat = [w for words in split for w in words]
    hashes = _word_hashes(flat) if flat else np.empty(0, np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for words in split:
            h = hashes[at : at + len(words)]
            at += len(words)
            if not len(h):
                out.append(np.empty(0, np.uint64))
                continue
            n = max(len(h) - width + 1, 1)
            mixed = np.full(n, np.uint64(min(len(h), width)))
            for k in range(min(width, len(h))):
                mixed = _mix(mixed * _M1 + h[k : k + n])
            out.append(np.unique(mixed))
    return out


def collection_keys(shingles: np.ndarray, collections: int) -> np.ndarray:
    """2 * collections keys of a set, the left ones first; each is a hash of ROWS minhashes and its place."""
    n = 2 * collections * ROWS
    xor, mul = _functions(1, n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 4096):  # bounds memory for very long texts
            x = (shingles[k : k + 4096, None] ^ xor) * mul
            np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0), out=low)
        keys = np.arange(2 * collections, dtype=np.uint64) * _M1
        rows = low.reshape(2 * collections, ROWS)
        for k in range(ROWS):
            keys = _mix(keys * _M2 + rows[:, k])
    return keys.view(np.int64)


def _sign(how: Settings):
    c = how.collections

    def fn(cols: dict, _state: dict) -> dict:
        sets = shingle_sets(cols["text"], how.width)
        with np.errstate(over="ignore"):
            a = [int(np.bitwise_xor.reduce(_mix(s + _M1)).view(np.int64)) if len(s) else 0 for s in sets]
            b = [int(_mix(s ^ _M2).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
        return {"row": cols["row"], "doc_id": cols["doc_id"], "text_key": cols["text_key"], "n": [len(s) for s in sets], "h1": a, "h2": b, "keys": [collection_keys(s, c) if len(s) else None for s in sets]}

    return fn


def _sets(how: Settings):
    return lambda cols, _state: {"rep": cols["rep"], "shingles": [s.tobytes() for s in shingle_sets(cols["text"], how.width)]}


def jaccard_reaches(a: bytes, b: bytes, per_cent: int = THRESHOLD) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= per_cent * (len(x) + len(y) - both)


def _verify(how: Settings):
    def fn(cols: dict, _state: dict) -> dict:
        return {"u": cols["u"], "v": cols["v"], "linked": [jaccard_reaches(a, b, how.per_cent) for a, b in zip(cols["a"], cols["b"])]}

    return fn


def _tested(how: Settings, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, linked of candidate pairs, on full sets; pairs carry sizes nu, nv that can rule a link out."""
    pairs = pairs.filter(100 * F.least("nu", "nv") >= how.per_cent * F.greatest("nu", "nv")).select("u", "v")
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b")), "v")
    return map_rows(both.select("u", "v", "a", "b"), _verify(how), "u long, v long, linked boolean")


def _as_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs u < v with sizes, from columns x, nx, y, ny."""
    swap = F.col("x") > F.col("y")
    return (
        found.filter("x != y")
        .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("nu"), F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("nv"))
        .dropDuplicates(["u", "v"])
    )


def buckets(how: Settings, classes: DataFrame) -> DataFrame:
    """tk, rep, n: members of the tables' buckets that have two members or more. classes: rep, n, keys."""
    each = classes.select("rep", "n", F.posexplode("keys").alias("pos", "ck"))
    shared = each.groupBy("ck").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("ck")
    left = F.col("pos") < how.collections
    sides = (
        each.join(shared, "ck", "left_semi")
        .groupBy("rep", "n")  # at most 2 * collections rows each
        .agg(F.collect_list(F.when(left, F.col("ck"))).alias("l"), F.collect_list(F.when(~left, F.col("ck"))).alias("r"))
    )
    members = stash(sides.select("rep", "n", F.explode("l").alias("lk"), "r").select("rep", "n", "lk", F.explode("r").alias("rk")).select("rep", "n", F.xxhash64("lk", "rk").alias("tk")), "tables", parts_for(classes))
    full = members.groupBy("tk").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("tk")
    out = stash(members.join(full, "tk", "left_semi"), "buckets", parts_for(members))
    discard(members)
    return out


def _link(how: Settings, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, component over the classes that have a link. classes: rep, n, keys, id, text_key; docs: doc_id, text_key, text."""
    inside = buckets(how, classes)
    few = parts_for(inside, classes)
    firsts = inside.groupBy("tk").agg(F.min(F.struct("rep", "n")).alias("m")).select("tk", F.col("m.rep").alias("y"), F.col("m.n").alias("ny"))
    pairs = stash(_as_pairs(inside.select("tk", F.col("rep").alias("x"), F.col("n").alias("nx")).join(firsts, "tk")), "pairs", few)
    wanted = classes.join(inside.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("id").alias("doc_id"), "text_key")
    # rows of equal id and text have one set
    sets = stash(map_rows(docs.join(wanted, ["doc_id", "text_key"]).select("rep", "text"), _sets(how), "rep long, shingles binary").dropDuplicates(["rep"]), "sets", few)
    tested = stash(_tested(how, pairs, sets), "tested", few)
    discard(pairs)
    label, open_, turn = None, None, 0
    while True:
        links = tested.filter("linked").select("u", "v")
        if open_ is None:
            label = stash(components(links, few), "labels", few)
            known = inside.join(label, F.col("rep") == F.col("node"), "left").select("tk", "rep", "n", F.coalesce("component", "rep").alias("comp"))
            mixed = known.groupBy("tk").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("tk")
            open_ = stash(known.join(mixed, "tk", "left_semi"), "open", few)
            if open_.isEmpty():
                return label
        last = turn >= LEADER_ROUNDS
        if last:
            found = _residue(how, open_, classes, sets)
        else:
            lead = _leaders(open_, links, turn)
            found = open_.join(lead, "tk").filter("comp != cy").select(F.col("rep").alias("x"), F.col("n").alias("nx"), "y", "ny")
        more = stash(_as_pairs(found).join(tested.select("u", "v"), ["u", "v"], "left_anti"), "pairs", few)
        if more.isEmpty():
            if last:
                return label
            turn = LEADER_ROUNDS
            continue
        turn += 1
        checked = stash(_tested(how, more, sets), "tested", few)
        discard(more)
        if not checked.filter("linked").isEmpty():
            open_ = None
        tested = tested.unionByName(checked)
        if last:
            return label if open_ is not None else stash(components(tested.filter("linked").select("u", "v"), few), "labels", few)


def _each_shingle(cols: dict, _state: dict) -> dict:
    sets = [np.frombuffer(x, np.int64) for x in cols["shingles"]]
    return {"rep": np.repeat(np.array(cols["rep"], np.int64), [len(x) for x in sets]), "sh": np.concatenate(sets) if sets else []}


def _sketch(cols: dict, _state: dict) -> dict:
    """BITS one-bit minhashes of each set. Two sets differ in a bit with probability (1 - similarity) / 2."""
    out: list[bytes] = []
    xor, mul = _functions(10_001, BITS)
    with np.errstate(over="ignore"):
        for data in cols["shingles"]:
            s = np.frombuffer(data, np.uint64)
            bits = []
            for k in range(0, BITS, 256):
                low = np.full(256, np.iinfo(np.uint64).max, np.uint64)
                for j in range(0, len(s), 1024):
                    x = (s[j : j + 1024, None] ^ xor[k : k + 256]) * mul[k : k + 256]
                    np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0), out=low)
                bits.append((_mix(low) & np.uint64(1)).astype(np.uint8))
            out.append(np.packbits(np.concatenate(bits)).tobytes())
    return {"rep": cols["rep"], "sketch": out}


def _peel(how: Settings, open_: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, n, comp of the members that can still have a link across components.

    A link's common shingles all lie in both sets, so those that no other member holds bound the similarity from
    above, with the smallest set met in a bucket as the partner's size. Members out of reach are dropped, which can
    put others out of reach.
    """
    alive = open_.select("rep", "n", "comp").distinct()
    rows = stash(map_rows(sets.join(alive.select("rep"), "rep", "left_semi"), _each_shingle, "rep long, sh long"), "shingles", parts_for(open_, sets))
    for _ in range(PEEL_ROUNDS):
        inside = open_.join(alive.select("rep"), "rep", "left_semi")
        least = inside.groupBy("tk").agg(F.min("n").alias("m"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b").select("tk", "m")
        met = inside.join(least, "tk").groupBy("rep", "n", "comp").agg(F.min("m").alias("m"))
        live = rows.join(alive.select("rep"), "rep", "left_semi")
        common = live.groupBy("sh").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("sh")
        shared = live.join(common, "sh", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("s"))
        reach = 100 * F.col("s") >= how.per_cent * (F.col("n") + F.greatest(F.col("m"), F.ceil(F.col("n") * how.per_cent / 100)) - F.col("s"))
        alive = stash(met.join(shared, "rep").filter(reach).select("rep", "n", "comp"), "alive", parts_for(open_, rows))
    discard(rows)
    return alive


def _meetings(how: Settings):
    """Over rows (ck, ba, bb, own, pos, rep, n, comp, left, sketch) sorted by ck, ba, bb: the pairs of each group that may be linked, from different components."""

    def pairs_of(g: pa.Table) -> tuple[np.ndarray, ...]:
        own, rep, n, comp, pos = (g.column(k).to_numpy() for k in ("own", "rep", "n", "comp", "pos"))
        left = g.column("left").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint64).reshape(len(rep), -1)
        a, b = (np.flatnonzero(own == g.column(k)[0].as_py()) for k in ("ba", "bb"))
        ok = (comp[a][:, None] != comp[b][None]) & (100 * np.minimum(n[a][:, None], n[b][None]) >= how.per_cent * np.maximum(n[a][:, None], n[b][None]))
        if own[a[0]] == own[b[0]]:
            ok &= rep[a][:, None] < rep[b][None]  # each pair once
        x, y = np.nonzero(ok)
        x, y = a[x], b[y]
        keep = []
        for k in range(0, len(x), 1 << 17):
            u, v = x[k : k + (1 << 17)], y[k : k + (1 << 17)]
            apart = np.zeros(len(u), np.int64)
            for w in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[u, w] ^ sketch[v, w])
            # a pair comes out of the first collection that it shares
            near = np.flatnonzero(apart <= how.apart)
            keep.append(k + near[np.argmax(left[u[near]] == left[v[near]], axis=1) == pos[u[near]]])
        at = np.concatenate(keep) if keep else np.empty(0, np.int64)
        x, y = x[at], y[at]
        return rep[x], n[x], rep[y], n[y]

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = [now.column(k).to_numpy() for k in ("ck", "ba", "bb")]
            turns = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            yield from (out for a, b in zip([0, *turns[:-1].tolist()], turns.tolist()) if (out := found(now.slice(a, b - a))) is not None)
            held = now.slice(int(turns[-1]) if len(turns) else 0).combine_chunks()
        if held is not None and (out := found(held)) is not None:
            yield out

    def found(group: pa.Table):
        if group.num_rows < 2:
            return None
        cols = pairs_of(group)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["x", "nx", "y", "ny"]) if len(cols[0]) else None

    return run


def _residue(how: Settings, open_: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """x, nx, y, ny: pairs of different components that may be linked, among members that share a left collection.

    A collection of more than BLOCK members is dealt to blocks by a hash; each two blocks meet under a key of their own.
    """
    alive = _peel(how, open_, sets)
    sketched = map_rows(sets.join(alive.select("rep"), "rep", "left_semi"), _sketch, "rep long, sketch binary")
    named = stash(classes.join(alive.select("rep", "comp"), "rep").join(sketched, "rep").select("rep", "n", "comp", F.slice("keys", 1, how.collections).alias("left"), "sketch"), "residue", parts_for(alive, sets))
    met = named.select("*", F.posexplode("left").alias("pos", "ck"))
    mixed = met.groupBy("ck").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a != b")
    dealt = met.join(mixed.select("ck", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "ck")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("ck", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"), "own", "pos", "rep", "n", "comp", "left", "sketch")
    ship_package(classes.sparkSession)
    return rows.repartition("ck", "ba", "bb").sortWithinPartitions("ck", "ba", "bb").mapInArrow(_meetings(how), "x long, nx long, y long, ny long")


def _leaders(open_: DataFrame, links: DataFrame, turn: int) -> DataFrame:
    """The member of each bucket that has most links so far; ties by a hash that changes with the turn."""
    degree = links.select("u").unionByName(links.select(F.col("v").alias("u"))).groupBy("u").agg(F.count(F.lit(1)).alias("deg"))
    ranked = open_.join(degree, F.col("rep") == F.col("u"), "left").select("tk", "rep", "n", "comp", F.coalesce("deg", F.lit(0)).alias("deg"))
    lead = ranked.groupBy("tk").agg(F.max(F.struct("deg", F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "n", "comp")).alias("m"))
    return lead.select("tk", F.col("m.rep").alias("y"), F.col("m.n").alias("ny"), F.col("m.comp").alias("cy"))


def _judged(docs: DataFrame, how: Settings) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, text_key, n, h1, h2; each class's n, h1, h2, id and text_key of its first row, node (what it is linked with has the same) and component_id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    rows = slim.withColumn("row", F.monotonically_increasing_id())
    signed = stash(map_rows(rows, _sign(how), "row long, doc_id long, text_key long, n long, h1 long, h2 long, keys array<long>"), "signed")
    usable = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # a class has the row number and the keys of its first row
    firsts = usable.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "text_key", "row")).alias("m")).select("n", "h1", "h2", F.col("m.row").alias("rep"), F.col("m.doc_id").alias("id"), F.col("m.text_key").alias("text_key"))
    classes = stash(firsts.join(usable.select(F.col("row").alias("rep"), "keys"), "rep"), "classes", parts_for(signed))
    label = _link(how, classes, slim)
    inside = classes.join(label, F.col("rep") == F.col("node")).select("n", "h1", "h2", "id", "text_key", "component")
    least = inside.groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("m")).select("component", F.col("m.id").alias("component_id"), F.col("m.text_key").alias("first_key"))
    known = inside.join(least, "component").select("n", "h1", "h2", "component_id", "first_key")
    named = classes.join(known, ["n", "h1", "h2"], "left").select("n", "h1", "h2", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("first_key", "text_key").alias("first_key"))
    # written, so that a join with all rows is a plain one, which Spark splits where a class has many copies
    return signed, stash(named, "named", parts_for(classes))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, per_cent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    signed, classes = _judged(docs, Settings(width, per_cent))
    out = signed.select("doc_id", "n", "h1", "h2").join(classes.drop("first_key"), ["n", "h1", "h2"], "left")
    comp = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first_copies(docs: DataFrame, width: int = SHINGLE, per_cent: int = THRESHOLD) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, with all columns of docs.

    Rows without words or id all stay, as nothing is known to be like them. Of rows with equal id and text one stays.
    """
    signed, classes = _judged(docs, Settings(width, per_cent))
    rows = signed.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "text_key", "n", "h1", "h2")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    dropped = rows.join(classes, ["n", "h1", "h2"]).filter(~first).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    on = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    kept = docs.join(dropped, on, "left_anti")
    twice = stash(rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), "twice", parts_for(signed))
    if twice.isEmpty():
        return kept
    one = kept.join(twice, on, "left_semi").withColumn("__key", F.xxhash64("text")).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return kept.join(twice, on, "left_anti").unionByName(one)
