"""IPv4 arithmetic as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"0*(25[0-5]|2[0-4]\d|1?\d?\d)"
_STRICT = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DOTTED = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
DOTTED_STRICT = rf"^{_STRICT}(\.{_STRICT}){{3}}$"
ALL_ONES = 4294967295


def looks_like_ip(ip: Column) -> Column:
    return F.coalesce(F.trim(ip).rlike(DOTTED), F.lit(False))


def probable_ip(ip: Column) -> Column:
    """Strict dotted quad that is neither multicast nor unspecified."""
    first = F.split(ip, r"\.").getItem(0).try_cast("int")
    return F.coalesce(ip.rlike(DOTTED_STRICT) & ~first.between(224, 239) & (ip != "0.0.0.0"), F.lit(False))


def ip_to_long(ip: Column) -> Column:
    parts = F.split(F.trim(ip), r"\.")
    number = sum((parts.getItem(i).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
                 parts.getItem(0).try_cast("bigint") * F.lit(256 ** 3))
    return F.when(looks_like_ip(ip), number)


def long_to_ip(number: Column) -> Column:
    octets = [F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(number.isNotNull(), F.concat_ws(".", *octets))


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times; keeps the expression small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_mask(prefix: Column) -> Column:
    """Prefix length to the 32-bit netmask as BIGINT."""
    return F.call_function("shiftleft", F.lit(ALL_ONES), F.lit(32) - prefix).bitwiseAND(F.lit(ALL_ONES))


def mask_to_prefix(mask: Column) -> Column:
    """Netmask, host mask or plain prefix length to INT; null when invalid."""
    digits = F.regexp_extract(mask, r"^(\d{1,2})$", 1).try_cast("int")

    def dotted(m: Column) -> Column:
        inverse = F.lit(ALL_ONES) - m
        return F.when(inverse.bitwiseAND(inverse + 1) == 0, F.bit_count(m)).when(m.bitwiseAND(m + 1) == 0, F.lit(32) - F.bit_count(m))

    return F.coalesce(F.when(digits <= 32, digits), _let(ip_to_long(mask), dotted)).cast("int")


def _cidr_text(net: Column, prefix: Column) -> Column:
    return F.when(net.isNotNull(), F.concat(long_to_ip(net), F.lit("/"), prefix.cast("string")))


def network_cidr(ip: Column, mask: Column) -> Column:
    """Network of an address and mask as text; null when either is invalid."""
    address = F.when(ip.rlike(DOTTED_STRICT), ip_to_long(ip))
    pair = F.struct(address.alias("ip"), mask_to_prefix(mask).alias("prefix"))
    return _let(pair, lambda p: _let(p["ip"].bitwiseAND(prefix_mask(p["prefix"])), lambda net: _cidr_text(net, p["prefix"])))


def cidr_prefix(cidr: Column) -> Column:
    """Prefix length of `a.b.c.d/n`; an address alone is a /32."""
    n = F.regexp_extract(cidr, r"/(\d{1,2})$", 1).try_cast("int")
    return F.when(~cidr.contains("/"), F.lit(32)).when(n <= 32, n)


def cidr_base(cidr: Column) -> Column:
    base = F.split(cidr, "/").getItem(0)
    return F.when(base.rlike(DOTTED_STRICT), ip_to_long(base)).bitwiseAND(prefix_mask(cidr_prefix(cidr)))


def ip_in_cidr(ip: Column, cidr: Column) -> Column:
    address = F.when(ip.rlike(DOTTED_STRICT), ip_to_long(ip))
    return F.coalesce(address.bitwiseAND(prefix_mask(cidr_prefix(cidr))) == cidr_base(cidr), F.lit(False))


def nth_host(cidr: Column, offset: Column) -> Column:
    """Usable host number `offset`, kept inside the subnet; empty text when the subnet is invalid."""
    def host(p: Column) -> Column:
        last = F.lit(ALL_ONES) - prefix_mask(p["prefix"]) - 2
        return F.when(p["prefix"] >= 31, p["base"]).otherwise(p["base"] + 1 + F.least(p["offset"], last))

    parts = F.struct(cidr_prefix(cidr).alias("prefix"), cidr_base(cidr).alias("base"), offset.cast("bigint").alias("offset"))
    return F.coalesce(_let(parts, lambda p: _let(host(p), long_to_ip)), F.lit(""))
