"""URL expressions: parts, and whether a URL may be fetched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are never fetched, and the IPv4 blocks that are not public (first address, bits).
BLOCKED_NAMES = ("localhost", "metadata", "metadata.google.internal", "ip6-localhost", "ip6-loopback")
PRIVATE_BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """The host in lower case, without user, port and a last dot; IPv6 ones without brackets."""
    name = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^\[|\]$", ""), r"\.$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)  # a fragment may have a question mark too


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def parameter(url: Column, name: str) -> Column:
    """Value of a query parameter; null where it is missing."""
    found = F.regexp_extract(F.concat(F.lit("&"), query(url)), rf"&{name}=([^&]*)", 0)
    return F.when(found != "", F.substring(found, F.lit(len(name) + 3), F.length(found)))


def _part(text: Column) -> Column:
    """A number as addresses write it: decimal, 0x for sixteen, a leading 0 for eight; null for no number."""
    return (
        F.when(text.rlike("^0[xX][0-9A-Fa-f]{1,8}$"), F.conv(F.substring(text, 3, 8), 16, 10).cast("long"))
        .when(text.rlike("^0[0-7]{1,11}$"), F.conv(text, 8, 10).cast("long"))
        .when(text.rlike("^(0|[1-9][0-9]{0,9})$"), text.cast("long"))
    )


def ipv4(name: Column) -> Column:
    """The number of an IPv4 address in any of its spellings (1 to 4 parts); null for other hosts."""
    parts = F.transform(F.split(name, r"\."), _part)
    n = F.size(parts)
    ok = n.between(1, 4) & F.forall(parts, lambda p: p.isNotNull())
    front, last = F.slice(parts, 1, n - 1), F.element_at(parts, -1)
    room = F.pow(F.lit(256.0), (5 - n).cast("double")).cast("long")
    high = F.aggregate(front, F.lit(0).cast("long"), lambda a, p: a * 256 + p) * room
    return F.when(ok & F.forall(front, lambda p: p <= 255) & (last < room), high + last)


def _number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def private_ipv4(number: Column) -> Column:
    hit = F.lit(False)
    for address, bits in PRIVATE_BLOCKS:
        low = _number(address)
        hit = hit | number.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(hit, F.lit(False))


# The IPv6 blocks that are not public (first groups, bits).
PRIVATE_BLOCKS_V6 = (("::", 128), ("::1", 128), ("64:ff9b:1::", 48), ("100::", 64), ("2001::", 23), ("2001:db8::", 32), ("2002::", 16), ("fc00::", 7), ("fe80::", 10), ("fec0::", 10), ("ff00::", 8))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used; plans would repeat it otherwise."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv6(name: Column) -> Column:
    """An IPv6 address in any of its spellings as 32 hexadecimal digits; null for other hosts. A zone after a percent sign is left out."""

    def grouped(bare: Column) -> Column:
        """A dotted end as the two groups that it stands for; as it is where it is no address."""
        dotted = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})$"
        hexed = lambda n: F.concat(F.regexp_replace(bare, dotted, ""), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        return F.when(~F.contains(bare, F.lit(".")), bare).otherwise(_let(ipv4(F.regexp_extract(bare, dotted, 1)), hexed))

    def digits(halves: Column) -> Column:
        groups = F.transform(halves, lambda h: F.filter(F.split(h, ":"), lambda g: g != ""))

        def joined(g: Column) -> Column:
            front, back = F.get(g, F.lit(0)), F.coalesce(F.get(g, F.lit(1)), F.array().cast("array<string>"))
            missing = F.lit(8) - F.size(front) - F.size(back)
            fits = F.when(F.size(g) == 2, missing >= 1).otherwise((F.size(g) == 1) & (missing == 0)) & F.forall(F.flatten(g), lambda x: F.length(x) <= 4)
            whole = F.concat(front, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), back)
            return F.when(fits, F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ""))

        return _let(groups, joined)

    clean = lambda t: F.when(t.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~t.rlike(":::|^:[^:]|[^:]:$"), _let(F.split(t, "::"), digits))
    return _let(F.lower(F.regexp_replace(name, "%.*$", "")), lambda bare: _let(grouped(bare), clean))


def _bits(block: str, n: int) -> str:
    """The first ``n`` bits of a block's address."""
    front, _, back = block.partition("::")
    front, back = [g for g in front.split(":") if g], [g for g in back.split(":") if g]
    groups = front + ["0"] * (8 - len(front) - len(back)) + back
    return "".join(f"{int(g, 16):016b}" for g in groups)[:n]


def private_ipv6(digits: Column) -> Column:
    """Whether an address of ``ipv6`` is not public: in one of the blocks, or an IPv4 address that is not, in the last 32 bits of a mapped, translated or compatible one."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(digits, i, 8), 16, 2), 32, "0") for i in (1, 9, 17, 25)))
    blocks = F.array(*(F.lit(_bits(block, n)) for block, n in PRIVATE_BLOCKS_V6))
    hit = _let(bits, lambda b: F.exists(blocks, lambda block: F.startswith(b, block)))
    inner = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
    holders = F.array(*map(F.lit, ("0" * 20 + "ffff", "0" * 24, "0064ff9b" + "0" * 16, "0" * 16 + "ffff0000")))
    return F.coalesce(hit | (F.exists(holders, lambda h: F.startswith(digits, h)) & _let(inner, private_ipv4)), F.lit(False))


def violation(url: Column) -> Column:
    """Why a URL must not be fetched (scheme, missing host, blocked name, private address), or null. Names are judged as they are written and not looked up; what has a colon and is no address is no host."""

    def judged(name: Column) -> Column:
        blocked = name.isin(*BLOCKED_NAMES) | F.endswith(name, F.lit(".localhost")) | F.endswith(name, F.lit(".internal"))
        four = lambda: F.when(_let(ipv4(name), private_ipv4), "private address")
        six = lambda digits: F.when(digits.isNull(), "no host").when(private_ipv6(digits), "private address")
        return F.when(name == "", "no host").when(blocked, "blocked name").when(F.contains(name, F.lit(":")), _let(ipv6(name), six)).otherwise(four())

    return F.when(~scheme(url).isin("http", "https"), "scheme").otherwise(_let(host(url), judged))
