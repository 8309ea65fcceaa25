"""Checks that need code beside expressions: addresses in any spelling, robots rules, masking of injections."""

from __future__ import annotations

import ipaddress
import json
import re
import socket
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import detect, urls
from webstrata.functions import text as tx


def private_address(host: str | None) -> bool:
    """Whether a host is a literal address that isn't public: decimal, octal, hex and short forms count, names don't."""
    if not host:
        return False
    h = host.strip("[]").split("%")[0].rstrip(".")
    try:
        ip = ipaddress.ip_address(h)
    except ValueError:
        if not re.fullmatch(r"(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+)){0,3}", h, re.I):
            return False
        try:
            ip = ipaddress.ip_address(socket.inet_aton(h))
        except OSError:
            return False
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    return not ip.is_global or ip.is_multicast


def is_private(host: Column) -> Column:
    """Native tests first; of other hosts only unusual literals reach the Python function, the rest go as null."""

    @F.arrow_udf("boolean")
    def odd(hosts: pa.Array) -> pa.Array:
        return pa.array([h is not None and private_address(h) for h in hosts.to_pylist()], pa.bool_())

    return urls.is_private_literal(host) | odd(F.when(host.rlike(r"^[0-9.]+$|^0x|\.0x|:") & ~urls.is_private_literal(host), host))


def robots_allowed(rows: DataFrame, robots: DataFrame, url: str = "url", agent: str = "*") -> DataFrame:
    """`allowed` by the host's robots text; hosts without one allow all. robots: (host, robots_txt)."""

    @F.arrow_udf("boolean")
    def test(texts: pa.Array, links: pa.Array) -> pa.Array:
        seen: dict[str, RobotFileParser] = {}
        out = []
        for text, link in zip(texts.to_pylist(), links.to_pylist(), strict=True):
            if text is None or link is None:
                out.append(True)
                continue
            if text not in seen:
                seen[text] = RobotFileParser()
                seen[text].parse(text.splitlines())
            out.append(seen[text].can_fetch(agent, link))
        return pa.array(out, pa.bool_())

    met = rows.withColumn("__h", urls.host(F.col(url))).join(robots.select(F.col("host").alias("__h"), F.col("robots_txt").alias("__r")), "__h", "left")
    return met.withColumn("allowed", test(F.col("__r"), F.col(url))).drop("__h", "__r")


_MASKED = [re.compile(p, re.I) for _, p, _ in detect.STRONG] + [re.compile(detect.BLOB)]


def masked(text: str, mask: str = "[redacted]") -> tuple[str, int]:
    """A text with all matches of strong patterns masked; matches that touch are one."""
    spans = sorted((m.start(), m.end()) for p in _MASKED for m in p.finditer(text) if m.end() > m.start())
    runs: list[list[int]] = []
    for a, b in spans:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    out, at = [], 0
    for a, b in runs:
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:], len(runs)


def redacted(text: Column, mask: str = "[redacted]") -> Column:
    """struct(text, count)."""

    @F.arrow_udf("struct<text:string,count:int>")
    def run(texts: pa.Array) -> pa.Array:
        got = [(None, 0) if t is None else masked(t, mask) for t in texts.to_pylist()]
        return pa.array([{"text": t, "count": n} for t, n in got], pa.struct([("text", pa.string()), ("count", pa.int32())]))

    return run(text)


def canonical_host(host: Column) -> Column:
    """Version 6 addresses in their shortest form; all other hosts as they are. Only hosts with a colon reach Python."""

    @F.arrow_udf("string")
    def short(hosts: pa.Array) -> pa.Array:
        out = []
        for h in hosts.to_pylist():
            try:
                out.append(None if h is None else ipaddress.ip_address(h).compressed)
            except ValueError:
                out.append(h)
        return pa.array(out, pa.string())

    return F.when(host.contains(":"), short(F.when(host.contains(":"), host))).otherwise(host)


def encodable(host: Column) -> Column:
    """Whether a host can be a name at all: labels of 1 to 63 characters; others than ASCII are tried by Python."""

    @F.arrow_udf("boolean")
    def odd(hosts: pa.Array) -> pa.Array:
        out = []
        for h in hosts.to_pylist():
            try:
                out.append(h is not None and bool(h.encode("idna")))
            except UnicodeError:
                out.append(False)
        return pa.array(out, pa.bool_())

    ascii_ = host.rlike(r"^\p{ASCII}*$")
    plain = host.rlike(r"^[^.]{1,63}(?:\.[^.]{1,63})*\.?$")
    return F.coalesce(F.when(ascii_, plain).otherwise(odd(F.when(~ascii_, host))), F.lit(False))


_SECRET = re.compile(tx.SECRET)


def _masked_value(key: str, value: object) -> object:
    if _SECRET.search(key):
        return tx.REDACTED
    if isinstance(value, dict):
        return {k: _masked_value(k, v) for k, v in value.items()}
    return [_masked_value(key, v) for v in value] if isinstance(value, list) else value


def redact_json(text: Column) -> Column:
    """A JSON object with the values of secret keys masked at any depth; null and what is no object give `{}`."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                data = json.loads(t or "{}")
                out.append(json.dumps({k: _masked_value(k, v) for k, v in data.items()} if isinstance(data, dict) else {}, ensure_ascii=False))
            except (ValueError, RecursionError, MemoryError):
                out.append("{}")
        return pa.array(out, pa.string())

    return run(text)
