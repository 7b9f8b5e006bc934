"""Network policy as relations: address ranges, hosts, redirects, crawler tokens."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import rules
from tracewell.session import ship_package


def ipv4_number(ip: Column) -> Column:
    """The address as a number, null if it isn't a dotted IPv4 literal."""
    part = lambda k: F.try_element_at(F.split(ip, r"\."), F.lit(k)).try_cast("long")
    good = ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256)
    return F.when(good, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def blocked_ipv4(ip: Column) -> Column:
    """The first blocked range that holds the address, by list order; fifteen fixed ranges need no join."""
    n = ipv4_number(ip)
    cases = []
    for base, bits in rules.IPV4_BLOCKED:
        low = int(ipaddress.IPv4Address(base))
        cases.append(F.when(n.between(low, low + (1 << (32 - bits)) - 1), F.lit(f"{base}/{bits}")))
    return F.coalesce(*cases)


def blocked_ipv6(df: DataFrame, column: str, out: str = "range6") -> DataFrame:
    """Adds the blocked range of IPv6 literals; mapped addresses go by the IPv4 ranges."""
    ship_package(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(_ranges6, "string")(column))


_NETS6 = [(f"{a}/{b}", ipaddress.IPv6Network((a, b))) for a, b in rules.IPV6_BLOCKED]
_NETS4 = [(f"{a}/{b}", ipaddress.IPv4Network((a, b))) for a, b in rules.IPV4_BLOCKED]


def range6(x: str | None) -> str | None:
    """The blocked range of an IPv6 literal. Mapped and compatible forms go by the IPv4 that they embed, but for `::` and `::1`."""
    try:
        ip = ipaddress.IPv6Address((x or "").strip("[]").split("%")[0])
    except ValueError:
        return None
    n = int(ip)
    if n > 1 and (n >> 32 in (0, 0xFFFF)):
        return next((name for name, net in _NETS4 if ipaddress.IPv4Address(n & 0xFFFFFFFF) in net), None)
    return next((name for name, net in _NETS6 if ip in net), None)


def _ranges6(s: pd.Series) -> pd.Series:
    return s.map(range6)


def folded_ipv4(host: str | None) -> str | None:
    """The dotted form of a numeric host (`127.1`, `2130706433`, `0x7f.1`, `0177.0.0.1`), null where it is none."""
    parts, numbers = (host or "").rstrip(".").split("."), []
    for p in parts:
        try:
            numbers.append(int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None
    room = 256 ** (5 - len(numbers))
    if len(numbers) > 4 or any(x > 255 for x in numbers[:-1]) or numbers[-1] >= room:
        return None
    return str(ipaddress.IPv4Address(sum(x << 8 * (3 - k) for k, x in enumerate(numbers[:-1])) + numbers[-1]))


def _folded(s: pd.Series) -> pd.Series:
    return s.map(folded_ipv4)


def normalised_host(host: Column) -> Column:
    """Trimmed, lower case, without brackets and root dots."""
    h = F.lower(F.trim(host))
    h = F.when(h.rlike(r"^\[.*\]$"), F.substring(h, F.lit(2), F.length(h) - 2)).otherwise(h)
    return F.rtrim(h, F.lit("."))


def parse_hosts(value: str | list[str] | None) -> list[str]:
    """Hosts of an allowlist given as a list or as text with commas: normalised, without repeats."""
    out: dict[str, None] = {}
    for entry in value.split(",") if isinstance(value, str) else value or []:
        host = entry.strip().lower()
        host = host[1:-1] if host.startswith("[") and host.endswith("]") else host
        if host := host.rstrip("."):
            out[host] = None
    return list(out)


def check_targets(targets: DataFrame, allowed: str | list[str], dns: DataFrame | None = None, fixtures: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Adds code: why a target url may not be fetched, null if it may; local: it is a fixture origin.

    allowed: hosts, matched whole. dns: host, address (null: an answer without addresses); a host without rows can't be
    resolved. fixtures: (host, port) of local origins, the one exception to the address ranges; they have to be literals.
    """
    ship_package(targets.sparkSession)
    host = normalised_host(F.regexp_extract("url", r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    scheme = F.lower(F.regexp_extract("url", r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    port = F.regexp_extract("url", r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?(?:\[[^\]]*\]|[^/:?#]*):([0-9]+)", 1).try_cast("int")
    out = targets.withColumns({"host": host, "scheme": scheme})
    # other spellings of an address are that address
    number = F.col("host").rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*$")
    folded = F.pandas_udf(_folded, "string")(F.when(number, F.col("host")))
    out = out.withColumn("__folded", folded).withColumns({"__bad": number & F.col("__folded").isNull(), "host": F.coalesce("__folded", "host")}).drop("__folded")
    out = out.withColumn("port", F.coalesce(port, F.when(F.col("scheme") == "https", 443).otherwise(80)))
    is4, is6 = ipv4_number(F.col("host")).isNotNull(), F.col("host").rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$")
    six = F.pandas_udf(_ranges6, "string")
    out = out.withColumn("range", F.coalesce(blocked_ipv4(F.col("host")), six(F.when(is6, F.col("host")))))
    if dns is not None:
        address = F.col("address")
        blocked = blocked_ipv4(address).isNotNull() | six(F.when(address.contains(":"), address)).isNotNull()
        rows = dns.select(normalised_host(F.col("host")).alias("dns_host"), address.isNotNull().alias("some"), blocked.alias("bad"))
        answers = rows.groupBy("dns_host").agg(F.bool_or("some").alias("dns_some"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("dns_blocked"))
        out = out.join(answers, out["host"] == answers["dns_host"], "left").drop("dns_host")
    hosts = parse_hosts(allowed)
    fixture = F.lit(False)
    for h, p in fixtures:
        fixture = fixture | ((F.col("host") == h) & (F.col("port") == p))
    code = (
        F.when((F.col("scheme") == "") | (F.col("scheme").isin("http", "https") & F.col("url").rlike(r"(?i)^\s*https?:(?!//)")) | F.coalesce(F.col("__bad"), F.lit(False)), "malformed-url")
        .when(~F.col("scheme").isin("http", "https"), "unsupported-protocol")
        .when(F.col("url").rlike(r"^[^/]*//[^/?#]*@"), "url-credentials")
        .when(F.col("host") == "", "no-host")
        .when(F.col("host").rlike(r"[\s/@\\]"), "ambiguous-host")
        .when(F.col("host").startswith(".") | F.contains("host", F.lit("..")), "malformed-host")
        .when(fixture & ~is4 & ~is6, "fixture-origin-not-literal")
        .when(fixture, F.lit(None))
        .when(~F.col("host").isin(*hosts) if hosts else F.lit(True), "unallowlisted-host")
        .when(F.col("range").isNotNull(), "blocked-ip")
        .when(is4 | is6, F.lit(None))
    )
    if dns is not None:
        code = code.when(F.col("dns_some").isNull(), "dns-failure").when(~F.col("dns_some"), "dns-empty").when(F.col("dns_blocked"), "blocked-ip")
    return out.withColumns({"code": code, "local": fixture & (is4 | is6)}).drop("dns_some", "dns_blocked", "range", "__bad")


def resolved_target(url: Column, origin: str) -> Column:
    """The address that a request names: a path is one of the local origin."""
    return F.when(url.startswith("/"), F.concat(F.lit(origin.rstrip("/")), url)).otherwise(url)


def status_of(code: Column) -> Column:
    """The HTTP status that an analysis with this refusal ends with; 200 without one."""
    refused = code.isin("malformed-url", "unsupported-protocol", "url-credentials", "unallowlisted-host", "blocked-ip", "fixture-origin-not-literal")
    return F.when(code.isNull(), 200).when(refused, 403).otherwise(500)


def probe_permission(targets: DataFrame, probes_allowed: str | list[str]) -> DataFrame:
    """Adds probe and probe_reason: crawler agents may be sent to local fixtures and to hosts that are listed for it."""
    hosts = parse_hosts(probes_allowed)
    listed = F.col("host").isin(*hosts) if hosts else F.lit(False)
    may = F.col("local") | listed
    return targets.withColumns({"probe": may, "probe_reason": F.when(F.col("local"), "fixture").when(listed, "allowlisted").otherwise("skipped")})


def follow_redirects(starts: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """url, final, hops, code of each start after at most `hops` redirects (from, to)."""
    r = redirects.select(F.col("from").alias("f"), F.col("to").alias("t"))
    now = starts.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"))
    for _ in range(hops + 1):
        step = now.join(r, now["final"] == r["f"], "left")
        now = step.select("url", F.coalesce("t", "final").alias("final"), (F.col("hops") + F.col("t").isNotNull().cast("int")).alias("hops"))
    return now.withColumn("code", F.when(F.col("hops") > hops, "too-many-redirects"))


def crawler_token(agent: Column) -> Column:
    """The first crawler token of the inventory that a user agent holds, as written."""
    return F.coalesce(*[F.when(F.contains(agent, F.lit(t)), F.lit(t)) for t, _, _ in rules.CRAWLERS])


def probe_plan(pages: DataFrame) -> DataFrame:
    """A row for each page and crawler of the inventory."""
    entries = [F.struct(F.lit(k).alias("inventory_ord"), F.lit(t).alias("token"), F.lit(v).alias("vendor"), F.lit(c).alias("category")) for k, (t, v, c) in enumerate(rules.CRAWLERS)]
    return pages.withColumn("c", F.explode(F.array(*entries))).select(*pages.columns, "c.*")
