"""Column expressions over packet fields (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP flag names in the order the feature slots use them, and
# their bits in the TCP header flags byte.
FLAG_NAMES = ("FIN", "SYN", "RST", "PSH", "ACK", "URG")
FLAG_MASKS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}

# Fixed value: the octet pattern of a dotted-quad IPv4 address (0-255 each).
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_bit(name: str, flags_col: str = "tcp_flags", protocol_col: str = "protocol") -> Column:
    """1 if the TCP flag is set on a TCP packet, else 0 (non-TCP -> 0)."""
    mask = FLAG_MASKS[name]
    is_tcp = F.col(protocol_col) == 6
    set_ = (F.col(flags_col).bitwiseAND(F.lit(mask)) != 0)
    return F.when(is_tcp & set_, 1).otherwise(0)


def last_octet(ip) -> Column:
    """Text after the last '.' as INT; NULL, IPv6 or junk -> 0."""
    return F.coalesce(F.expr(f"try_cast(element_at(split({ip}, '[.]'), -1) AS INT)")
                      if isinstance(ip, str) else
                      F.element_at(F.split(ip, r"[.]"), -1).try_cast("int"), F.lit(0))


def int_or_zero(c) -> Column:
    return F.coalesce(_c(c).cast("int"), F.lit(0))


def is_valid_ipv4(ip) -> Column:
    return F.coalesce(_c(ip).rlike(IPV4_PATTERN), F.lit(False))


# Fixed value: one or more groups of up to four hex digits.
_GROUPS = "^[0-9a-f]{1,4}(:[0-9a-f]{1,4})*$"


def canonical_ipv6(ip) -> Column:
    """The canonical text of an IPv6 address (lower case, no leading
    zeros, the longest run of two or more zero groups as ``::``, the leftmost
    of equal ones; a dotted-quad tail as two groups; a zone after ``%`` as it
    is), NULL when invalid."""
    zone = F.regexp_extract(_c(ip), "(%.*)$", 1)
    text = F.lower(F.regexp_replace(_c(ip), "%.*$", ""))
    # a dotted-quad tail becomes two groups
    tail = F.regexp_extract(text, r"([^:]*)$", 1)
    octets = F.transform(F.split(tail, r"\."), lambda x: x.try_cast("int"))
    pair = [F.lower(F.hex((octets[i] * 256 + octets[i + 1]).cast("long"))) for i in (0, 2)]
    text = F.when(tail.rlike(IPV4_PATTERN),
                  F.concat(F.regexp_replace(text, "[^:]*$", ""), pair[0], F.lit(":"), pair[1])).otherwise(text)
    halves = F.split(text, "::", -1)
    lists = [F.when(h == "", F.array().cast("array<string>")).when(h.rlike(_GROUPS), F.split(h, ":"))
             for h in (halves[0], F.get(halves, F.lit(1)))]
    n = F.size(lists[0]) + F.size(lists[1])
    groups = F.when((F.size(halves) == 1) & (F.size(lists[0]) == 8), lists[0]) \
        .when((F.size(halves) == 2) & lists[0].isNotNull() & lists[1].isNotNull() & (n <= 7),
              F.concat(lists[0], F.array_repeat(F.lit("0"), 8 - n), lists[1]))
    full = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
    out = full
    for run in range(2, 9):  # the longest run that occurs is tried first
        pattern = rf"^(?:(.*?):)??0(?::0){{{run - 1}}}(?::(.*))?$"
        out = F.when(full.rlike(pattern), F.regexp_replace(full, pattern, "$1::$2")).otherwise(out)
    return F.when((zone == "") | zone.rlike("^%[^%]+$"), F.concat(out, zone))


def is_valid_ipv6(ip) -> Column:
    return canonical_ipv6(ip).isNotNull()


def canonical_ip(df, ip_col: str, out: str = "ip_canonical"):
    """P18 (v4 and v6): ``df`` with the canonical address text, NULL when
    invalid."""
    return df.withColumn(out, F.when(is_valid_ipv4(ip_col), F.col(ip_col)).otherwise(canonical_ipv6(ip_col)))


def port_of(tcp_col: str, udp_col: str, default: int | None = 0) -> Column:
    """Port from the TCP field, else the UDP field, else ``default``."""
    cols = [F.col(tcp_col), F.col(udp_col)]
    if default is not None:
        cols.append(F.lit(default))
    return F.coalesce(*cols)


def protocol_tcp_or_udp(proto_col: str = "protocol") -> Column:
    """Offline flow rows: protocol 6 stays 6, anything else becomes 17."""
    return F.when(F.col(proto_col) == 6, F.lit(6)).otherwise(F.lit(17))
