"""Special-purpose address ranges, as expressions and for single addresses. The first range of a table that holds an address decides."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges and their reasons.
V4 = [
    ("0.0.0.0/8", "this-network"), ("10.0.0.0/8", "private"), ("172.16.0.0/12", "private"), ("100.64.0.0/10", "shared-address-space"),
    ("127.0.0.0/8", "loopback"), ("169.254.0.0/16", "link-local"), ("192.0.0.0/24", "special-purpose"), ("192.0.2.0/24", "documentation"),
    ("192.31.196.0/24", "as112"), ("192.52.193.0/24", "as112"), ("192.88.99.0/24", "deprecated-6to4-relay"), ("192.168.0.0/16", "private"),
    ("192.175.48.0/24", "as112"), ("198.18.0.0/15", "benchmarking"), ("198.51.100.0/24", "documentation"), ("203.0.113.0/24", "documentation"),
    ("224.0.0.0/4", "multicast"), ("240.0.0.0/4", "reserved"),
]
V6 = [
    ("::/128", "unspecified"), ("0:0:0:1::/128", "loopback"), ("100::/64", "discard-only"), ("2001::/32", "teredo"),
    ("2001:1::/32", "special-purpose"), ("2001:2::/48", "benchmarking"), ("2001:4:112::/48", "as112"), ("2001:10::/28", "orchid"),
    ("2001:20::/28", "orchid"), ("2001:db8::/32", "documentation"), ("2002::/16", "6to4"), ("3ffe::/16", "6bone"), ("3fff::/20", "documentation"),
    ("64:ff9b::/96", "nat64"), ("fc00::/7", "unique-local"), ("fec0::/10", "site-local"), ("fe80::/10", "link-local"), ("ff00::/8", "multicast"),
]


def _bounds(net: str) -> tuple[int, int]:
    n = ipaddress.ip_network(net, strict=False)
    return int(n.network_address), int(n.broadcast_address)


def v4_number(address: Column) -> Column:
    """A dotted address as a bigint; null if it is none."""
    part = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    p = F.split(address, r"\.")
    number = sum((p[i].cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)), p[0].cast("bigint") * F.lit(256**3))
    return F.when(address.rlike(rf"^{part}(?:\.{part}){{3}}$"), number)


def classify_v4(address: Column) -> Column:
    """The reason that a dotted address is special, 'public' if it isn't; null if it is no address."""
    number = v4_number(address)
    out = F.when(number.isNull(), F.lit(None).cast("string"))
    for net, reason in V4:
        lo, hi = _bounds(net)
        out = out.when(number.between(lo, hi), F.lit(reason))
    return out.otherwise("public")


def classify_v6_hex(digits: Column) -> Column:
    """The reason of an address given as 32 lower-case hex digits; embedded v4 addresses (compatible or mapped) go by the v4 table."""
    embedded = digits.rlike("^0{24}") | digits.rlike("^0{20}f{4}")
    low = F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint")
    out = F.when(~digits.rlike("^[0-9a-f]{32}$"), F.lit(None).cast("string"))
    for net, reason in V4:
        lo, hi = _bounds(net)
        out = out.when(embedded & low.between(lo, hi), F.lit(reason))
    out = out.when(embedded, F.lit("public"))
    for net, reason in V6:
        lo, hi = _bounds(net)
        out = out.when(digits.between(f"{lo:032x}", f"{hi:032x}"), F.lit(reason))
    return out.otherwise("public")


def classify(address: str) -> str | None:
    """The same for one address as text: a reason, or None if it is public."""
    ip = ipaddress.ip_address(address)
    number, table = int(ip), V4
    if ip.version == 6:
        high = number >> 32
        if high in (0, 0xFFFF):
            number &= 0xFFFFFFFF
        else:
            table = V6
    for net, reason in table:
        lo, hi = _bounds(net)
        if lo <= number <= hi:
            return reason
    return None


def is_safe(address: str) -> bool:
    return classify(address) is None


def special_hostname(host: str) -> str | None:
    """Why a name stands for this machine or its own network."""
    for name, reason in (("localhost", "localhost name"), ("local", "mDNS local name")):
        if host == name or host.endswith("." + name):
            return reason
    return None


def special_hostname_column(host: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, reason in (("localhost", "localhost name"), ("local", "mDNS local name")):
        out = out.when((host == name) | host.endswith("." + name), F.lit(reason))
    return out
