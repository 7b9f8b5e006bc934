"""Operator 4 [native]: shards by jump consistent hashing, in DataFrame functions alone.

The shard of a key is found without a table: a linear congruential generator seeded by the key gives the buckets at
which the key would jump as shards are appended; the last jump below the shard count is its shard. Going from n to
n + 1 shards moves a key only into the new shard, with probability 1 / (n + 1).

Slots number the rows of each shard without gaps in the order of doc_id: rows are range-partitioned by shard and id,
counted by partition, and the counts' prefix sums are the partitions' first slots.

Null text has no bytes (size 1, CRC of nothing); a null id counts as key 0; equal ids share a shard and get slots of
their own; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.session import stash

SHARDS = 8
_A = 2862933555777941757  # fixed value: the multiplier of the published algorithm
_LOW = 0xFFFFFFFF


def _times(word: Column, by: int) -> Column:
    """word * by for 32-bit numbers, modulo 2 ** 32, without leaving 63 bits."""
    return (F.lit(by) * word.bitwiseAND(0xFFFF) + F.shiftleft((F.lit(by) * F.shiftright(word, 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * _A + 1 modulo 2 ** 64, for a key in two 32-bit halves."""
    a_high, a_low = _A >> 32, _A & _LOW
    p0, p1 = F.lit(a_low) * low.bitwiseAND(0xFFFF), F.lit(a_low) * F.shiftright(low, 16)
    sum_ = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(sum_, 32) + F.shiftright(p1, 16)
    return (carry + _times(high, a_low) + _times(low, a_high)).bitwiseAND(_LOW), sum_.bitwiseAND(_LOW)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key among 0 .. shards - 1."""
    if shards < 1:
        raise ValueError("at least one shard")
    seed = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    state = F.struct(
        F.shiftrightunsigned(seed, 32).alias("hi"), seed.bitwiseAND(_LOW).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def turn(s: Column, _x: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    # each turn moves j by one at least
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, turn, lambda s: s["b"].cast("int"))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text)."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    rows = stash(slim, "shards").withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("shard", F.col("doc_id").asc_nulls_first(), "text_crc32", "row").withColumn("part", F.spark_partition_id())
    ranged = stash(ranged, "ranged")
    # a row for each partition and shard
    counts = ranged.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "row")) - 1
    out = ranged.join(bases, ["shard", "part"]).withColumn("slot", (F.col("base") + place).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _jump_sql(shards: int) -> str:
    """DuckDB: the shard of doc_id, by 128-bit integers; one nested level for each turn."""
    table = "SELECT r, coalesce(doc_id, 0)::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END AS k, -1 AS b, 0::BIGINT AS j FROM rows_"
    for _ in range(shards):
        stepped = f"SELECT r, b, j, k, (k * {_A}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM ({table})"
        jump = "floor((j + 1) * (2147483648.0::DOUBLE / ((nk // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT"
        table = f"SELECT r, CASE WHEN j < {shards} THEN nk ELSE k END AS k, CASE WHEN j < {shards} THEN j ELSE b END AS b, CASE WHEN j < {shards} THEN {jump} ELSE j END AS j FROM ({stepped})"
    return f"SELECT r, b FROM ({table})"


#: DuckDB has no CRC-32: registers of 512-byte chunks by a byte table, then joined by the register's shift over 512 zero bytes.
_CRC_SQL = """
bits AS (SELECT i AS n, i::BIGINT AS v FROM range(256) t(i)),
bytes_ AS (SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM bits),
zeros AS (SELECT list(list_reduce(list_concat([1::BIGINT << n::INT], list_transform(range(512), lambda i: 0::BIGINT)), lambda c, z: xor(c >> 8, t[(c & 255)::INT + 1])) ORDER BY n) AS z
  FROM bits, bytes_ WHERE n < 32),
hexed AS (SELECT r, hex(encode(text)) AS h, strlen(text) AS n FROM rows_),
placed AS (SELECT r, h, n % 512 AS first, unnest(range(n // 512 + 1)) AS i FROM hexed),
chunks AS (SELECT r, i, CASE WHEN i = 0 THEN h[1:2 * first] ELSE h[2 * first + 1024 * (i - 1) + 1:2 * first + 1024 * i] END AS h FROM placed),
registers AS (
  SELECT r, i, list_reduce(list_concat([CASE WHEN i = 0 THEN 4294967295::BIGINT ELSE 0 END], list_transform(range(1, length(h)::BIGINT, 2),
    lambda k: (strpos('0123456789ABCDEF', h[k]) - 1) * 16 + strpos('0123456789ABCDEF', h[k + 1]) - 1)), lambda c, b: xor(c >> 8, t[(xor(c & 255, b))::INT + 1])) AS g
  FROM chunks, bytes_),
summed AS (
  SELECT r, xor(list_reduce(list(g ORDER BY i), lambda c, x: xor(x, list_reduce(list_transform(range(32), lambda b: CASE WHEN (c >> b::INT) & 1 = 1 THEN any_z[b + 1] ELSE 0 END), lambda p, q: xor(p, q)))), 4294967295) AS crc
  FROM (SELECT r, i, g, z AS any_z FROM registers, zeros) GROUP BY r, any_z)"""


ORACLE_SQL = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{_CRC_SQL},
now_ AS ({_jump_sql(SHARDS)}),
grown AS ({_jump_sql(SHARDS + 1)}),
all_ AS (SELECT rows_.r, doc_id, (strlen(text) + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, now_.b::INT AS shard, grown.b::INT AS grown_shard
  FROM rows_ JOIN summed USING (r) JOIN now_ USING (r) JOIN grown USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, r) - 1 AS slot, grown_shard FROM all_
"""
