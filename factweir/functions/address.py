"""Internet addresses as 32 hexadecimal digits, and whether they are public. All expressions, inside the JVM.

An IPv4 address is the IPv6 address that maps it, so one sorted array of ranges holds both kinds and a value is
looked up by halving it.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks that aren't public by the registries of special addresses, with multicast, and what is public
#: within them.
CLOSED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8",
)
OPEN_WITHIN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")

_MAPPED = 0xFFFF << 32
_V4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_V4}[.]{_V4}[.]{_V4}[.]{_V4}"


@lru_cache(maxsize=8)
def ranges(closed: tuple[str, ...] = CLOSED, within: tuple[str, ...] = OPEN_WITHIN) -> tuple[tuple[str, str], ...]:
    """First and last of the disjoint ranges that the blocks leave, sorted, as hexadecimal digits."""

    def bounds(block: str) -> tuple[int, int]:
        net = ipaddress.ip_network(block)
        shift = _MAPPED if net.version == 4 else 0
        return int(net.network_address) + shift, int(net.broadcast_address) + shift

    holes = sorted(map(bounds, within))
    merged: list[list[int]] = []
    for low, high in sorted(map(bounds, closed)):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    out = []
    for low, high in merged:
        for a, b in holes:
            if low <= a <= high:
                if low < a:
                    out.append((low, a - 1))
                low = b + 1
        if low <= high:
            out.append((low, high))
    return tuple((f"{a:032x}", f"{b:032x}") for a, b in out)


def _octets(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")), "")


def _loose_v4(host: Column) -> Column:
    """One to four numbers, decimal, octal or hexadecimal, the last of which fills the bytes that are left."""
    fits = F.regexp_like(host, F.lit(r"^(?:0x[0-9a-f]*|[0-9]+)(?:[.](?:0x[0-9a-f]*|[0-9]+)){0,3}$")) & ~F.regexp_like(host, F.lit(r"(?:^|[.])0[0-9]*[89]|[.]0x[.]|^0x[.]|0x$|[0-9a-f]{12}"))
    number = lambda x: F.when(x.startswith("0x"), F.conv(F.substring(x, F.lit(3), F.length(x)), 16, 10)).when(x.startswith("0"), F.conv(x, 8, 10)).otherwise(x).cast("long")
    parts = F.transform(F.split(F.when(fits, host), "[.]"), number)
    n = F.size(parts)
    first = F.slice(parts, 1, n - 1)
    last = F.element_at(parts, -1)
    room = F.pow(F.lit(256.0), 5 - n)
    ok = F.forall(first, lambda x: x < 256) & (last < room)
    hexed = F.concat(F.array_join(F.transform(first, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""), F.lpad(F.lower(F.hex(last)), 2 * (5 - n), "0"))
    return F.when(fits & ok, hexed)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address_value(host: Column, loose: bool = False) -> Column:
    """32 hexadecimal digits of an address as text, with or without brackets and zone; null if it isn't one.

    loose: also what resolvers read as an IPv4 address, such as 127.1 or 0x7f000001.
    """
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim(host), r"^\[|\]$", ""), r"%[^:]*$", ""))
    return _let(plain, lambda h: _value(h, loose))


def _value(h: Column, loose: bool) -> Column:
    v4 = F.when(F.regexp_like(h, F.lit(f"^{_QUAD}$")), _octets(F.split(h, "[.]")))
    if loose:
        v4 = F.coalesce(v4, _loose_v4(h))
    tail = F.regexp_extract(h, rf":({_QUAD})$", 1)
    bytes_ = _octets(F.split(tail, "[.]"))
    full = F.when(tail == "", h).otherwise(F.concat(F.substring(h, F.lit(1), F.length(h) - F.length(tail)), F.substring(bytes_, 1, 4), F.lit(":"), F.substring(bytes_, 5, 4)))
    return F.coalesce(F.concat(F.lit("0" * 20 + "ffff"), v4), F.when(F.contains(h, F.lit(":")), _let(full, _v6)))


def _v6(full: Column) -> Column:
    """32 digits of an address without a dotted end; null if it isn't one."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    pad = lambda xs: F.array_join(F.transform(xs, lambda x: F.lpad(x, 4, "0")), "")
    gap = F.instr(full, "::")
    plain = F.regexp_like(full, F.lit("^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$"))
    short = F.regexp_like(full, F.lit("^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"))
    left, right = groups(F.substring(full, F.lit(1), gap - 1)), groups(F.substring(full, gap + 2, F.length(full)))
    missing = 8 - F.size(left) - F.size(right)
    return F.when(plain, pad(groups(full))).when(short & (missing >= 1), F.concat(pad(left), F.repeat(F.lit("0000"), missing), pad(right)))


def within(value: Column, spans: tuple[tuple[str, str], ...]) -> Column:
    """Whether a value lies in one of the sorted disjoint spans: the last that starts at or below it is found by
    halving, whatever their number."""
    if not spans:
        return F.lit(False)
    starts, ends = (F.array(*[F.lit(s[k]) for s in spans]) for k in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(spans).bit_length()))])
    last = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.coalesce(F.get(starts, at + step) <= value, F.lit(False)), at + step).otherwise(at))
    return F.coalesce(F.get(ends, last) >= value, F.lit(False))


def is_public(host: Column, loose: bool = False) -> Column:
    """Whether an address is public; null if the text isn't an address."""
    return _let(address_value(host, loose), lambda value: F.when(value.isNotNull(), ~within(value, ranges())))
