"""Operator 8: best-fit packing of documents into sequences by the sum-of-squares rule.

Each document's ids end with an end id. Documents longer than a sequence are cut into full pieces, a shorter one
first. Pieces are placed one by one: of the open bins' levels where a piece fits, and a new bin, the one is taken
that leaves the sum of squared counts of open bins over levels smallest. Only the counts by level matter to the rule,
so a step costs one pass over a vector of 2048 numbers, however many bins are open.

Pieces are dealt by a hash of their row numbers to groups of about GROUP pieces; each group is packed by itself, in
one task, so no task grows with the input. Within a group pieces come in hashed order, but those of under a sixteenth of
a sequence come last, longest first: they fill what the others leave. Full pieces need no packing.

Null text counts as empty: one sequence place for the end id. Repeated rows are packed each for itself; a null id is
allowed; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrow import map_rows, stash
from tracewell.llm.tokens import encoder

LENGTH = 2048
END_ID = 0
GROUP = 50_000
SHORT = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: full pieces but for the first."""
    first = n % length or length
    return [(0, first), *[(k, length) for k in range(first, n, length)]] if n else []


def _cut(path: str | None, length: int):
    def fn(cols: dict, _state: dict) -> dict:
        out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "row")}
        end = np.array([END_ID], "<u4").tobytes()
        for doc, row, ids in zip(cols["doc_id"], cols["row"], encoder(path).encode([x or "" for x in cols["text"]])):
            ids += end
            for k, (start, n) in enumerate(pieces_of(len(ids) // 4, length)):
                for name, value in zip(out, (doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), row)):
                    out[name].append(value)
        return out

    return fn


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by level; full bins are closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, n in enumerate(lengths.tolist()):
        if n >= capacity:
            bins[k], offsets[k], made = made, 0, made + 1
            continue
        # moving a bin from level h to h + n changes the sum of squares by 2 * (count[h + n] - count[h] + 1)
        # a full bin leaves the sum, so level `capacity` counts as empty and costs 1 less
        gain = count[n:] - count[: capacity + 1 - n] + 1
        gain[-1] = -count[capacity - n]
        open_ = count[: capacity + 1 - n] > 0
        open_[0] = False
        best, level = 2 * int(count[n]) + 1, 0
        if open_.any():
            gain = np.where(open_, gain, np.iinfo(np.int64).max)
            at = len(gain) - 1 - int(np.argmin(gain[::-1]))  # of equal ones the fullest
            cost = 2 * int(gain[at]) + (1 if at + n == capacity else 0)
            if cost <= best:
                best, level = cost, at
        if level:
            b = stacks[level].pop()
            count[level] -= 1
        else:
            b, made = made, made + 1
        bins[k], offsets[k] = b, level
        if level + n < capacity:
            stacks[level + n].append(b)
            count[level + n] += 1
    return bins, offsets


def _pack(capacity: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        length, row = pdf["length"].to_numpy(), pdf["row"].to_numpy()
        short = length < capacity // SHORT
        order = np.lexsort((row, pd.util.hash_array(row), np.where(short, -length, 0), short))
        pdf = pdf.iloc[order]
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["grp"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets)[[*[c.split()[0] for c in PIECES.split(", ")], "sequence_id", "offset"]]

    return fn


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    cut = stash(map_rows(slim, _cut(vocabulary, length), PIECES + ", row long"), "pieces").withColumn("row", F.xxhash64("row", "piece"))
    whole = cut.filter(F.col("length") == length).drop("row")
    parts = cut.filter(F.col("length") < length)
    groups = max(1, round(parts.count() / group))
    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    packed = dealt.groupBy("grp").applyInPandas(_pack(length), PIECES + ", sequence_id long, offset long")
    full = whole.withColumn("sequence_id", (F.lit(1 << 62) + F.monotonically_increasing_id())).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
