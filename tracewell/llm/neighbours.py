"""Operator 6: approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are brought to length 1, so that Euclidean nearness is cosine nearness. Each of TABLES tables hashes a vector
by FUNCTIONS Gaussian (2-stable) projections, cut into cells of WIDTH. A query visits its own bucket and PROBES - 1
perturbed ones in order of estimated success: the sum of squared distances to the cell borders that a perturbation
crosses. Candidates of all tables are merged and ranked by their exact cosine on the original vectors in double
precision. Cosines that agree to 2 ** -GRID (1e-12) are ties, as multiples of a vector differ by rounding only; they go
to the smaller id.

Equal vectors are one class that keeps its KEEP smallest ids, more than a result can need, so a vector that fills a
third of the table costs one row. Buckets are split so that a task sees BLOCK indexed vectors and QUERY_BLOCK queries
at most at once; each block gives its best classes for each query. A query for which too few classes were found goes
through all rows in blocks.

Vectors that are null, empty, zero or that hold null or non-finite components take no part, nor do null ids. Vectors of
different lengths have no cosine: each length is searched by itself. Rows of equal id and vector are one; equal ids with
different vectors are rows of their own. Empty tables give empty results; further columns don't matter. The parameters were
fitted on 10,256 vectors of nearly uncorrelated test data, the hardest case for hashing; see the README for recall.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.arrow import map_rows, stash
from tracewell.session import ship_package

NEAREST = 5
EVERY = 50
TABLES, FUNCTIONS, WIDTH, PROBES = 8, 8, 2.2, 70
SEED = 20240607
BLOCK, QUERY_BLOCK = 8_000, 2_000
KEEP = NEAREST + 1
GRID = 40


class Hashes:
    """The projections of all tables for vectors of one length."""

    def __init__(self, size: int):
        rng = np.random.default_rng([SEED, size])
        self.lines = rng.standard_normal((TABLES, size, FUNCTIONS))
        # orthogonal directions of Gaussian length where there is room: better separated cells
        if size >= FUNCTIONS:
            self.lines = np.stack([np.linalg.qr(x)[0] * np.sqrt(size) for x in self.lines])
        self.shift = rng.random((TABLES, FUNCTIONS)) * WIDTH
        self.mix = rng.integers(1, 1 << 62, (TABLES, FUNCTIONS), dtype=np.int64).astype(np.uint64) | np.uint64(1)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and distances to their lower borders, by table: (TABLES, rows, FUNCTIONS)."""
        p = np.einsum("rd,tdf->trf", x, self.lines) + self.shift[:, None, :]
        cells = np.floor(p / WIDTH)
        return cells.astype(np.int64), p - cells * WIDTH

    def keys(self, table: int, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (cells.astype(np.uint64) * self.mix[table]).sum(axis=-1, dtype=np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(table)
        return mixed.view(np.int64)


def probe_order(low: np.ndarray, probes: int = PROBES) -> list[tuple[tuple[int, int], ...]]:
    """The best perturbations, as sets of (function, -1 or 1), by rising score; the first is empty."""
    moves = sorted([(float(x * x), k, -1) for k, x in enumerate(low)] + [(float((WIDTH - x) ** 2), k, 1) for k, x in enumerate(low)])
    out, heap = [()], [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        score, chosen = heapq.heappop(heap)
        if len({moves[k][1] for k in chosen}) == len(chosen):
            out.append(tuple(moves[k][1:] for k in chosen))
        last = chosen[-1]
        if last + 1 < len(moves):
            heapq.heappush(heap, (score + moves[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (score - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
    return out


_HASHES: dict = {}


def _hashes(size: int) -> Hashes:
    if size not in _HASHES:
        _HASHES[size] = Hashes(size)
    return _HASHES[size]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(cols: dict):
    """(class ids, vectors as bytes, vectors) of each length in a batch."""
    groups: dict[int, list[int]] = {}
    for k, v in enumerate(cols["vec"]):
        groups.setdefault(len(v), []).append(k)
    for rows in groups.values():
        data = [cols["vec"][k] for k in rows]
        yield [cols["cid"][k] for k in rows], data, np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def _index(cols: dict, _state: dict) -> dict:
    out: dict = {"tk": [], "cid": [], "first": [], "vec": []}
    first = dict(zip(cols["cid"], cols["first"]))
    for ids, data, x in _by_length(cols):
        h = _hashes(x.shape[1])
        cells, _ = h.places(_unit(x))
        for t in range(TABLES):
            out["tk"] += h.keys(t, cells[t]).tolist()
            out["cid"] += ids
            out["first"] += [first[c] for c in ids]
            out["vec"] += data
    return out


def _probe(cols: dict, _state: dict) -> dict:
    out: dict = {"tk": [], "cid": [], "vec": []}
    for ids, data, x in _by_length(cols):
        h = _hashes(x.shape[1])
        cells, low = h.places(_unit(x))
        for k, cid in enumerate(ids):
            for t in range(TABLES):
                order = probe_order(low[t, k])
                moved = np.repeat(cells[t, k][None], len(order), axis=0)
                for row, chosen in zip(moved, order):
                    for f, by in chosen:
                        row[f] += by
                keys = np.unique(h.keys(t, moved)).tolist()
                out["tk"] += keys
                out["cid"] += [cid] * len(keys)
                out["vec"] += [data[k]] * len(keys)
    return out


FOUND = "q long, c long, grid long, score double"


def _rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The KEEP nearest classes of a block for each query of a block, by exact cosine, ties to the smaller id."""
    out = []
    left, right = (p.assign(size=p["vec"].str.len()) for p in (left, right))
    for size in sorted(set(left["size"]) & set(right["size"])):  # one, but for keys of two lengths that meet by chance
        mine, theirs = left[left["size"] == size].sort_values(["first", "cid"]), right[right["size"] == size]
        x, q = (np.frombuffer(b"".join(p["vec"]), np.float64).reshape(len(p), -1) for p in (mine, theirs))
        x, q = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, q))
        score = (q @ x.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
        ids, n = mine["cid"].to_numpy(), len(mine)
        # one number for score and place, so that a partition knows ties
        order = np.rint(score * 2.0**GRID).astype(np.int64) * (1 << 20) + (n - np.arange(n))
        best = np.argpartition(-order, KEEP, axis=1)[:, :KEEP] if n > KEEP else np.broadcast_to(np.arange(n), score.shape)
        rows = np.repeat(np.arange(len(q)), best.shape[1])
        at = (rows, best.ravel())
        out.append(pd.DataFrame({"q": theirs["cid"].to_numpy()[rows], "c": ids[at[1]], "grid": order[at] >> 20, "score": score[at]}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "c": [], "grid": [], "score": []}).astype({"q": "int64", "c": "int64", "grid": "int64", "score": "float64"})


def _search(index: DataFrame, probes: DataFrame) -> DataFrame:
    """q, c, score: near classes c of the query classes q. Buckets are dealt in blocks of both sides."""
    n = index.groupBy("tk").agg(F.count(F.lit(1)).alias("nx"))
    m = probes.groupBy("tk").agg(F.count(F.lit(1)).alias("nq"))
    size = stash(n.join(m, "tk").select("tk", F.ceil(F.col("nx") / BLOCK).cast("int").alias("bx"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("bq")), "blocks")
    deal = lambda salt, blocks: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(blocks)).cast("int")
    left = index.join(size, "tk").withColumn("sx", deal(1, "bx")).withColumn("sq", F.explode(F.sequence(F.lit(0), F.col("bq") - 1))).select("tk", "sx", "sq", "cid", "first", "vec")
    right = probes.join(size, "tk").withColumn("sq", deal(2, "bq")).withColumn("sx", F.explode(F.sequence(F.lit(0), F.col("bx") - 1))).select("tk", "sx", "sq", "cid", "vec")
    keys = ["tk", "sx", "sq"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _rank(a, b), FOUND)
    return found.groupBy("q", "c").agg(F.max("grid").alias("grid"), F.max("score").alias("score"))


def search(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the NEAREST rows of each query. vectors: vec_id, embedding."""
    ship_package(vectors.sparkSession)
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("vec")).filter("vec_id IS NOT NULL AND size(vec) > 0")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    slim = slim.filter(fine).withColumn("vec", F.transform("vec", lambda v: v + 0.0))
    slim = slim.withColumns({"h1": F.xxhash64(F.lit(1), "vec"), "h2": F.xxhash64(F.lit(2), "vec")})
    rows = stash(slim.select("vec_id", "h1", "h2").distinct(), "vectors")
    # the smallest ids of each class; a class is named by a number of its own, as ids may repeat with other vectors
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("k") <= KEEP)
    classes = ranked.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    named = classes.select(F.col("first").alias("vec_id"), "h1", "h2", "cid")
    vecs = stash(map_rows(slim.join(named, ["vec_id", "h1", "h2"]).dropDuplicates(["cid"]).select("cid", F.col("vec_id").alias("first"), "vec"), _as_binary, "cid long, first long, vec binary"), "class-vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("vec_id", "cid")
    asked = stash(vecs.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "vec"), "asked")
    index = stash(map_rows(vecs, _index, "tk long, cid long, first long, vec binary"), "index")
    probes = stash(map_rows(asked, _probe, "tk long, cid long, vec binary"), "probes")
    found = stash(_search(index, probes), "found")
    enough = found.groupBy("q").count().filter(F.col("count") >= KEEP).select(F.col("q").alias("cid"))
    few = stash(asked.join(enough, "cid", "left_anti"), "few")
    if not few.isEmpty():
        # an exact way: these queries against all rows, in blocks
        blocks = max(1, -(-vecs.count() // BLOCK))
        left = vecs.withColumn("tk", F.pmod(F.xxhash64("cid"), F.lit(blocks)))
        right = few.withColumn("tk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = found.unionByName(_search(left, right)).groupBy("q", "c").agg(F.max("grid").alias("grid"), F.max("score").alias("score"))
    # ties between classes go by their smallest ids, so KEEP classes hold all that a result can need
    first = found.join(classes.select(F.col("cid").alias("c"), "ids"), "c")
    best = first.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("grid"), F.col("ids")[0]))).filter(F.col("k") <= KEEP).drop("k")
    near = best.select("q", "grid", "score", F.explode("ids").alias("near_id"))
    # a class gives KEEP ids at most, so KEEP ** 2 rows stand behind a query class
    near = near.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("grid"), "near_id"))).filter(F.col("k") <= KEEP)
    each = queries.join(near, queries["cid"] == near["q"]).filter("vec_id != near_id")
    out = each.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("grid"), "near_id"))).filter(F.col("rank") <= NEAREST)
    return out.select(F.col("vec_id").alias("query_id"), "rank", F.col("near_id").alias("vec_id"), "score")


def _as_binary(cols: dict, _state: dict) -> dict:
    return {"cid": cols["cid"], "first": cols["first"], "vec": [np.array(v, np.float64).tobytes() for v in cols["vec"]]}
