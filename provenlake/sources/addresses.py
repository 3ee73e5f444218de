"""Internet addresses of hosts as 128-bit numbers, and the class of network that they lie in.

An address is 32 hex digits, so that texts compare as numbers do; IPv4 lies where IPv6 maps it (::ffff:0:0/96), however it is written: four
numbers or fewer, decimal, octal or hexadecimal, alone or at the end of an IPv6 address. Networks are intervals; laid over each
other, the longest prefix on top, they part all addresses into disjoint intervals, and an address looks up the last one that
begins at or before it.

Nulls stay null; a name is no address (null); a host in brackets, or one whose last label is a number, that is no address is "bad".
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenlake.functions.text import once

# Special networks of the public registries and their classes.
NETWORKS = [
    ("::/0", "reserved"),
    ("2000::/3", "public"),
    ("::ffff:0:0/96", "public"),
    ("::/128", "unspecified"),
    ("::1/128", "loopback"),
    ("2001::/23", "private"),
    ("2001:1::1/128", "public"),
    ("2001:1::2/128", "public"),
    ("2001:3::/32", "public"),
    ("2001:4:112::/48", "public"),
    ("2001:20::/28", "public"),
    ("2001:30::/28", "public"),
    ("2001:db8::/32", "private"),
    ("2002::/16", "private"),
    ("3fff::/20", "private"),
    ("fc00::/7", "private"),
    ("fe80::/10", "link_local"),
    ("fec0::/10", "private"),
    ("ff00::/8", "multicast"),
    ("0.0.0.0/8", "private"),
    ("0.0.0.0/32", "unspecified"),
    ("10.0.0.0/8", "private"),
    ("100.64.0.0/10", "private"),
    ("127.0.0.0/8", "loopback"),
    ("169.254.0.0/16", "link_local"),
    ("172.16.0.0/12", "private"),
    ("192.0.0.0/24", "private"),
    ("192.0.0.9/32", "public"),
    ("192.0.0.10/32", "public"),
    ("192.0.2.0/24", "private"),
    ("192.168.0.0/16", "private"),
    ("198.18.0.0/15", "private"),
    ("198.51.100.0/24", "private"),
    ("203.0.113.0/24", "private"),
    ("224.0.0.0/4", "multicast"),
    ("240.0.0.0/4", "reserved"),
]
MAPPED = 0xFFFF << 32


def ranges(networks: list[tuple[str, str]] = NETWORKS) -> list[tuple[int, int, int, str]]:
    """(first, last, prefix length of 128, class) of networks."""
    out = []
    for text, kind in networks:
        net = ipaddress.ip_network(text)
        base, more = (MAPPED, 96) if net.version == 4 else (0, 0)
        out.append((base + int(net.network_address), base + int(net.broadcast_address), more + net.prefixlen, kind))
    return out


def intervals(networks: list[tuple[str, str]] = NETWORKS) -> list[tuple[int, str]]:
    """(first address, class) of the disjoint intervals that the networks part all addresses into."""
    own = ranges(networks)
    cuts = sorted({x for a, b, _, _ in own for x in (a, b + 1)} - {1 << 128})
    out: list[tuple[int, str]] = []
    for cut in cuts:
        kind = max((length, kind) for a, b, length, kind in own if a <= cut <= b)[1]
        if not out or out[-1][1] != kind:
            out.append((cut, kind))
    return out


def _number(part: Column) -> Column:
    """A decimal, octal (0...) or hexadecimal (0x...) number; null where it is none or over 11 digits long."""
    value = (
        F.when(part.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(part, 3, 8), 16, 10))
        .when(part.rlike("^0[0-7]{1,11}$"), F.conv(part, 8, 10))
        .when(part.rlike("^(0|[1-9][0-9]{0,9})$"), part)
    )
    return value.cast("long")


def _ipv4(host: Column) -> Column:
    """An IPv4 address of one to four numbers as a number: all but the last are bytes, the last one fills what is left."""

    def of(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        bytes_ = F.slice(parts, 1, n - 1)
        room = F.element_at(F.array(*(F.lit(1 << 8 * (4 - k)) for k in range(4))), F.least(n, F.lit(4)))
        good = (n <= 4) & F.forall(parts, lambda p: p.isNotNull()) & F.forall(bytes_, lambda p: p < 256) & (last < room)
        return F.when(F.coalesce(good, F.lit(False)), F.aggregate(bytes_, F.lit(0).cast("long"), lambda s, p: s * 256 + p) * room + last)

    return once(F.transform(F.split(host, r"\."), _number), of)


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def _groups(text: Column) -> Column:
    """An IPv6 address's end in hexadecimal, where it is an IPv4 address; without a zone. Null where that is none."""
    plain = F.regexp_replace(text, "%.*$", "")
    tail = r"(?:^|:)(\d+\.\d+\.\d+\.\d+)$"
    as_hex = lambda v4: F.concat(_hex(F.shiftright(v4, 16), 4), F.lit(":"), _hex(v4.bitwiseAND(0xFFFF), 4))
    ended = once(F.regexp_extract(plain, tail, 1), lambda t: F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(t)), once(_ipv4(t), as_hex)))
    return F.when(plain.contains("."), F.when(plain.rlike(tail), ended)).otherwise(plain)


def _ipv6(text: Column) -> Column:
    """An IPv6 address without brackets as 32 hex digits."""
    none = F.array().cast("array<string>")
    groups = lambda side: F.when(side == "", none).otherwise(F.split(side, ":"))

    def whole(s: Column) -> Column:
        n = F.size(s["left"]) + F.size(s["right"])
        every = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - n)), s["right"])
        return once(every, lambda g: F.when(((s["sides"] == 1) & (n == 8) | (s["sides"] == 2) & (n < 8)) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))

    def of(sides: Column) -> Column:
        right = F.when(F.size(sides) == 2, groups(F.get(sides, F.lit(1)))).otherwise(none)
        return once(F.struct(F.size(sides).alias("sides"), groups(F.get(sides, F.lit(0))).alias("left"), right.alias("right")), whole)

    return once(F.split(_groups(text), "::"), lambda sides: F.when(sides.isNotNull(), of(sides)))


def address(host: Column) -> Column:
    """A host (in lower case) as an address of 32 hex digits; null for a name, "bad" for what looks like an address and is none."""

    def of(h: Column) -> Column:
        plain = F.regexp_replace(h, r"\.$", "")
        numeric = plain.rlike(r"(^|\.)(\d+|0x[0-9a-f]*)$")
        inner = F.when(h.endswith("]"), F.substring(h, F.lit(2), F.length(h) - 2))
        return F.when(h.startswith("["), F.coalesce(_ipv6(inner), F.lit("bad"))).when(numeric, F.coalesce(F.concat(F.lit(f"{MAPPED >> 32:024x}"), _hex(_ipv4(plain), 8)), F.lit("bad")))

    return once(host, of)


def network_class(address_: Column, networks: list[tuple[str, str]] = NETWORKS) -> Column:
    """The class of the network that an address (32 hex digits) lies in."""
    own = intervals(networks)
    begins, kinds = F.array(*(F.lit(f"{a:032x}") for a, _ in own)), F.array(*(F.lit(k) for _, k in own))
    return once(address_, lambda a: F.when(a.rlike("^[0-9a-f]{32}$"), F.element_at(kinds, F.size(F.filter(begins, lambda b: b <= a)))))
