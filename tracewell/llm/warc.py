"""Operator 7: WARC archives with a two-level capture index.

Captures are range-partitioned and sorted by reversed-host URL key. Each task writes one archive (WARC/1.1, each
record a gzip member of its own) and, beside it, the index lines of its captures in compressed blocks of BLOCK_LINES,
and a sparse directory with a line for each block: its first and last capture and where it lies. The table of archives
has a row for each, with its bounds. A look-up binary-searches those bounds, the archive's directory and one block's
lines, and range-reads block and records. The query looks every page up by key and id; requests are dealt to the
archives that may hold them and sorted, so a task reads each block once. Only the table of archives, a row for each
written partition, goes to the driver.

Of captures with equal payloads of MIN_REVISIT bytes or more, the one with the smallest page id is a response and the
others are revisit records, which name it and carry its digest and length but no payload.

Null html counts as an empty payload and a null url as an empty one; a null id is never the smallest unless all are
null; rows of equal id and payload are archived each for itself with the same type; very long payloads are archived
whole; an empty table gives no files and an empty result; further columns don't matter.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.arrow import arrow_schema, map_batches, slices, stash
from tracewell.session import RangeReader, ensure_folder, put_bytes, scratch, ship_package

MIN_REVISIT = 100
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"  # the tables carry no capture time

NO_ID = -(1 << 63)  # stands for a null id: before all others

ARCHIVES = "name string, first_key string, first_id long, last_key string, last_id long, directory_bytes long, blocks long, captures long"
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string"

_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^@/?#]*@)?([^/?#:]*)(:\d+)?([^#]*)", re.I)
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: the host reversed, lower case, without scheme, user and fragment. Blanks are escaped."""
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    m = _URL.match(url)
    if not m:
        return url.split("#")[0]
    host = m[1].lower().rstrip(".")
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3] or "/")


def _id_text(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _id_of(text: str) -> int | None:
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, level: int = 1) -> bytes:
    """One gzip member with a response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:capture:{_id_text(page_id)}>"]
    head += [f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{_id_text(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """What one record says; a response's payload is held against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": _id_of(fields["WARC-Record-ID"][13:-1]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _id_of(refers[13:-1]) if refers else None, "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
    }


def _place(key: str, page_id: int | None) -> tuple[bytes, int]:
    """Where a capture stands in key order."""
    return key.encode(), NO_ID if page_id is None else page_id


def _archive(root: str):
    schema = arrow_schema(ARCHIVES)

    def write(batches):
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        blocks, lines, directory, ends = [], [], [], []
        at = offset = captures = 0

        def close_block():
            nonlocal offset, captures
            if lines:
                first, last = (x.split(" ", 2)[:2] for x in (lines[0], lines[-1]))
                blocks.append(zlib.compress("\n".join(lines).encode()))
                directory.append(" ".join([*first, *last, str(offset), str(len(blocks[-1]))]))
                ends[:] = [ends[0] if ends else first, last]
                offset, captures = offset + len(blocks[-1]), captures + len(lines)
                lines.clear()

        def members():
            nonlocal at
            for whole in batches:
                for batch in slices(whole):
                    for r in batch.to_pylist():
                        payload = r["html"].encode("utf-8", "surrogatepass")
                        m = record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"], r["revisit"])
                        lines.append(f"{r['url_key']} {_id_text(r['page_id'])} {at} {len(m)}")
                        at += len(m)
                        if len(lines) == BLOCK_LINES:
                            close_block()
                        yield m
            close_block()

        put_bytes(name + ".warc.gz", members())
        if blocks:
            put_bytes(name + ".cdx", blocks)
            packed = zlib.compress("\n".join(directory).encode())
            put_bytes(name + ".dir", [packed])
            (first_key, first_id), (last_key, last_id) = ends[0], ends[-1]
            row = (name, first_key, _place("", _id_of(first_id))[1], last_key, _place("", _id_of(last_id))[1], len(packed), len(blocks), captures)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return write


def _key_of(url: str):
    return F.pandas_udf(lambda s: s.map(url_key), "string")(F.coalesce(F.col(url).cast("string"), F.lit("")))


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Archives pages (page_id, url, html) under root. The table of archives, one row for each with captures."""
    ship_package(pages.sparkSession)
    ensure_folder(root)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    twins = slim.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("c"))
    # written first, so that its size is known when the join with the payloads is planned
    twins = stash(twins.filter("c > 1").drop("c"), "twins")
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    roles = slim.join(twins, "digest", "left").select(
        _key_of("url").alias("url_key"), "page_id", "url", "html", "digest", F.when(later, F.col("first_id")).alias("refers_to"), later.alias("revisit"), F.monotonically_increasing_id().alias("row")
    )
    ranged = roles.repartitionByRange("url_key", "page_id", "row").sortWithinPartitions("url_key", "page_id", "row").drop("row")
    return stash(map_batches(ranged, _archive(root), ARCHIVES), "archives")


class Archive:
    """The captures of one archive, found through its directory and its blocks of index lines."""

    def __init__(self, row, ranges: RangeReader):
        self._name, self._ranges, self._block = row["name"], ranges, (-1, [], [])
        lines = [x.split(" ") for x in zlib.decompress(ranges.read(self._name + ".dir", 0, row["directory_bytes"])).decode().split("\n")]
        self._first = [_place(x[0], _id_of(x[1])) for x in lines]
        self._last = [_place(x[2], _id_of(x[3])) for x in lines]
        self._where = [(int(x[4]), int(x[5])) for x in lines]

    def _lines(self, k: int) -> tuple[list[tuple[bytes, int]], list[list[str]]]:
        if self._block[0] != k:
            lines = [x.split(" ") for x in zlib.decompress(self._ranges.read(self._name + ".cdx", *self._where[k])).decode().split("\n")]
            self._block = (k, [_place(x[0], _id_of(x[1])) for x in lines], lines)
        return self._block[1:]

    def find(self, first: tuple[bytes, int], last: tuple[bytes, int]):
        """The records between two places, each with its url_key, in order."""
        k = bisect.bisect_left(self._last, first)
        while k < len(self._first) and self._first[k] <= last:
            places, lines = self._lines(k)
            for key, _, at, size in lines[bisect.bisect_left(places, first) : bisect.bisect_right(places, last)]:
                yield parse(self._ranges.read(self._name + ".warc.gz", int(at), int(size))) | {"url_key": key}
            k += 1


class Lookup:
    """Finds captures by URL. archives: the table of archives, a row for each written partition."""

    def __init__(self, archives: DataFrame):
        self._rows = sorted(archives.collect(), key=lambda r: _place(r["first_key"], r["first_id"]))
        self.first = [_place(r["first_key"], r["first_id"]) for r in self._rows]
        self.last = [_place(r["last_key"], r["last_id"]) for r in self._rows]
        self._ranges = RangeReader()

    def __len__(self) -> int:
        return len(self._rows)

    def find(self, url: str) -> list[dict]:
        """The records of all captures of a URL, in order of page id."""
        first, last = (url_key(url).encode(), NO_ID), (url_key(url).encode(), 1 << 63)
        k, out = bisect.bisect_left(self.last, first), []
        while k < len(self._rows) and self.first[k] <= last:
            out += Archive(self._rows[k], self._ranges).find(first, last)
            k += 1
        return out

    def rows(self) -> list[dict]:
        return [r.asDict() for r in self._rows]


def look_up(requests: DataFrame, archives: DataFrame) -> DataFrame:
    """The captures (CAPTURES) of requests (url_key, page_id), each found by binary search."""
    spark = archives.sparkSession
    ship_package(spark)
    bounds = Lookup(archives)
    rows, first, last = bounds.rows(), bounds.first, bounds.last
    schema = arrow_schema(CAPTURES)

    def holders(keys: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for want in zip(map(str.encode, keys), ids.tolist()):
            k = bisect.bisect_left(last, want)
            upto = bisect.bisect_right(first, want, k)
            out.append(list(range(k, upto)))
        return pd.Series(out, dtype=object)

    def read(batches):
        ranges, now, archive = RangeReader(), -1, None
        for batch in batches:
            found = []
            for place, key, page_id in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if place != now:
                    now, archive = place, Archive(rows[place], ranges)
                want = (key.encode(), page_id)
                found += [{k: v for k, v in r.items() if k != "payload"} for r in archive.find(want, want)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        ranges.close()

    asked = requests.select("url_key", F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id")).distinct()
    dealt = asked.select(F.explode(F.pandas_udf(holders, "array<int>")("url_key", "id")).alias("place"), "url_key", "id")
    return dealt.repartition(max(len(rows), 1), "place").sortWithinPartitions("place", "url_key", "id").mapInArrow(read, CAPTURES)


def read_archives(archives: DataFrame) -> DataFrame:
    """Every capture of the archives, a task for each, through directory and blocks."""
    ship_package(archives.sparkSession)
    schema = arrow_schema(CAPTURES)

    def read(batches):
        ranges = RangeReader()
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                for r in Archive(row, ranges).find((b"", NO_ID), _place(row["last_key"], row["last_id"])):
                    found.append({k: v for k, v in r.items() if k != "payload"})
                    if len(found) == BLOCK_LINES:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
                yield pa.RecordBatch.from_pylist(found, schema=schema)
        ranges.close()

    return archives.repartition(max(1, archives.count())).mapInArrow(read, CAPTURES)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages to archives, then looks each of them up there."""
    archives = write_archives(pages, scratch(spark, "warc"))
    wanted = pages.select(_key_of("url").alias("url_key"), F.col("page_id").cast("long").alias("page_id"))
    return look_up(wanted, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
first_ AS (SELECT d, min(page_id) AS m FROM p WHERE strlen(html) >= {MIN_REVISIT} GROUP BY d HAVING count(*) > 1)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM p LEFT JOIN first_ USING (d)
"""
