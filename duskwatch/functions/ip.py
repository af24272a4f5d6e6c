"""IP parsing and network membership as JVM-side expressions (no UDF).

Every valid address becomes 32 hex digits; v4 lives in the v4-mapped range, so one
prefix comparison serves both families.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"(?:{OCTET}\.){{3}}{OCTET}"
MAPPED = "0" * 20 + "ffff"


def _bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def is_v4(ip: Column) -> Column:
    return ip.rlike(rf"\A{DOTTED}\z")


def _octets(ip: Column) -> list[Column]:
    return [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]


def v4_long(ip: Column) -> Column:
    """The address as a number, null unless it is a dotted quad (leading zeros rejected)."""
    a, b, c, d = _octets(ip)
    return F.when(is_v4(ip), a * 16777216 + b * 65536 + c * 256 + d)


def _expand(text: Column, groups: int) -> Column:
    """``groups`` colon-separated groups as padded hex digits, null if malformed."""
    edged = F.concat(F.when(text.startswith("::"), "0").otherwise(""), text,
                     F.when(text.endswith("::"), "0").otherwise(""))
    # An inner "::" stands for at least one group; at an edge the added "0" is that group.
    least = F.when(text.startswith("::") | text.endswith("::"), 0).otherwise(1)
    fill = lambda t: F.replace(t, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.greatest(
        F.lit(groups) - F.regexp_count(t, F.lit(":")), least))))
    padded = F.concat(F.lit(":"), _bind(edged, fill))
    for _ in range(3):
        padded = F.regexp_replace(padded, ":(?=[0-9a-f]{1,3}(:|$))", ":0")
    # At most one "::"; exactly ``groups`` groups once it is filled.
    digits = F.replace(F.regexp_extract(padded, rf"\A(:[0-9a-f]{{4}}){{{groups}}}\z", 0), F.lit(":"), F.lit(""))
    return F.when(text.rlike(r"\A(?!.*::.*::)(?!.*:::)[0-9a-f:]+\z"), F.nullif(digits, F.lit("")))


def _v6_hex(ip: Column) -> Column:
    """Expand a textual v6 address (``::`` and a dotted tail allowed) to 32 hex digits."""
    def mixed(text: Column) -> Column:
        low = F.lpad(F.lower(F.hex(_bind(F.substring_index(text, ":", -1), v4_long))), 8, "0")
        head = F.regexp_replace(text, r"(?<=::)[0-9.]+\z|(?<!:):[0-9.]+\z", "")
        return F.concat(_bind(head, lambda h: _expand(h, 6)), low)

    return F.when(ip.contains("."), _bind(F.lower(ip), mixed)).otherwise(_bind(F.lower(ip), lambda t: _expand(t, 8)))


def ip_hex(ip: Column) -> Column:
    """32 hex digits of a v4 or v6 address, null when it does not parse."""
    v4 = F.concat(F.lit(MAPPED), F.lpad(F.lower(F.hex(v4_long(ip))), 8, "0"))
    return F.when(ip.contains(":"), _v6_hex(ip)).otherwise(v4)


def ip_family(hex_ip: Column) -> Column:
    """4 for v4 and v4-mapped addresses, else 6."""
    return F.when(hex_ip.startswith(MAPPED), 4).when(hex_ip.isNotNull(), 6)


def ip_prefix(hex_ip: Column, bits: Column) -> Column:
    """The first ``bits`` bits of 32 hex digits: whole nibbles plus one masked nibble."""
    whole = F.floor(bits / 4).cast("int")
    left = (bits % 4).cast("int")
    nibble = F.conv(F.substring(hex_ip, whole + 1, F.lit(1)), 16, 10).cast("int")
    mask = F.when(left == 1, 8).when(left == 2, 12).otherwise(14)
    part = F.when(left == 0, F.lit("")).otherwise(F.lower(F.hex(nibble.bitwiseAND(mask))))
    return F.concat(F.substring(hex_ip, F.lit(1), whole), part)


def parse_network(text: str) -> tuple[int, int, str]:
    """(family, bits in the 128-bit space, 32 hex digits) of a CIDR literal."""
    if "/" not in text:
        raise ValueError(f"invalid cidr {text!r}")
    try:
        net = ipaddress.ip_network(text, strict=False)
    except ValueError as error:
        raise ValueError(f"invalid cidr {text!r}") from error
    if net.version == 4:
        return 4, 96 + net.prefixlen, MAPPED + f"{int(net.network_address):08x}"
    digits = f"{int(net.network_address):032x}"
    mapped = digits.startswith(MAPPED) and net.prefixlen >= 96
    return (4 if mapped else 6), net.prefixlen, digits


def in_network(ip: Column, cidr: str) -> Column:
    """Whether an address column lies in a literal network; null ip -> null."""
    family, bits, digits = parse_network(cidr)
    wide, prefix = ip_hex(ip), _prefix(digits, bits)
    same = lambda w: w.startswith(prefix) if bits % 4 == 0 else ip_prefix(w, F.lit(bits)) == F.lit(prefix)
    if family == 6 and MAPPED.startswith(prefix[:26]):
        generic = _bind(wide, lambda w: same(w) & ~w.startswith(MAPPED))
    else:
        generic = _bind(wide, same)
    if family == 6:
        return F.when(ip.contains(":"), generic).otherwise(F.lit(False))
    shift = 128 - bits
    base = int(digits[24:], 16) >> shift
    return F.when(ip.contains(":"), generic).otherwise(F.shiftright(v4_long(ip), shift) == base)


def _prefix(digits: str, bits: int) -> str:
    whole, left = divmod(bits, 4)
    tail = f"{int(digits[whole], 16) & (0xF << (4 - left)) & 0xF:x}" if left else ""
    return digits[:whole] + tail


def parse_cidr(cidr: Column) -> Column:
    """(family, bits, prefix) struct of a CIDR text column, null when it does not parse."""
    def parts(wide: Column) -> Column:
        length = F.split_part(cidr, F.lit("/"), F.lit(2))
        plen = F.when(length.rlike(r"\A(0|[1-9][0-9]{0,2})\z"), length.cast("int"))
        dotted = ~cidr.contains(":")
        bits = F.when(dotted & (plen <= 32), plen + 96).when(~dotted & (plen <= 128), plen)
        family = F.when(wide.startswith(MAPPED) & (bits >= 96), 4).otherwise(6)
        return F.when(wide.isNotNull() & bits.isNotNull(), F.struct(
            family.alias("net_family"), bits.alias("net_bits"), ip_prefix(wide, bits).alias("net_prefix")))

    return _bind(ip_hex(F.split_part(cidr, F.lit("/"), F.lit(1))), parts)
