"""Address predicates as native column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Address space that counts as internal
INTERNAL_V4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16")
INTERNAL_V6 = ("fc00::/7", "fe80::/10", "::1/128")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4_PATTERN = rf"^(?:{_OCTET}[.]){{3}}{_OCTET}$"


def v4_range(cidr: str) -> tuple[int, int]:
    """First and last address of a network as numbers."""
    network = ipaddress.ip_network(cidr)
    return int(network.network_address), int(network.broadcast_address)


def _v4_start(cidr: str) -> str:
    """How an address of a v4 network begins as text, which is cheaper per row than range tests on numbers."""
    network = ipaddress.ip_network(cidr)
    whole, rest = divmod(network.prefixlen, 8)
    octets = str(network.network_address).split(".")
    start = "".join(f"{octet}[.]" for octet in octets[:whole])
    if rest:
        first = int(octets[whole])
        start += "(?:" + "|".join(str(first + k) for k in range(1 << (8 - rest))) + ")[.]"
    return start


def _v6_start(cidr: str) -> str:
    """How an address of a v6 network shorter than 13 bits begins as text; a whole address is matched with any zeros."""
    network = ipaddress.ip_network(cidr)
    if network.prefixlen == 128:
        return r"(?:(?:0{1,4}:){1,7}:?|::(?:0{1,4}:){0,6})0{0,3}1$"
    first = int(network.network_address) >> 116
    return "(?:" + "|".join(f"{first + k:03x}" for k in range(1 << (12 - network.prefixlen))) + ")[0-9a-f]:"


# Both come from the lists above
V4_INTERNAL_PATTERN = "^(?:" + "|".join(map(_v4_start, INTERNAL_V4)) + ")"
V6_INTERNAL_PATTERN = "(?i)^(?:" + "|".join(map(_v6_start, INTERNAL_V6)) + ")"
# A zone after the address, and a v4 address at the end of a v6 one
ZONE_PATTERN = "%[^%]+$"
V4_TAIL_PATTERN = rf"(?<=:)(?:{_OCTET}[.]){{3}}{_OCTET}$"
#: What well-formed v6 text must match and must not match, besides its number of groups.
V6_LETTERS = "^[0-9a-fA-F:]+$"
V6_FAULTS = "[0-9a-fA-F]{5,}|:::|::.*::|^:[^:]|[^:]:$"


def is_v4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(V4_PATTERN), F.lit(False))


def _plain_v6(ip: Column) -> Column:
    """v6 text without its zone and with an embedded v4 address as two groups."""
    return F.regexp_replace(F.regexp_replace(ip, ZONE_PATTERN, ""), V4_TAIL_PATTERN, "1:1")


def is_v6(ip: Column) -> Column:
    """Well-formed IPv6 text: eight groups of up to four hex digits, one run of which may be ``::``. The last two may
    be written as an IPv4 address, and a zone may follow."""
    plain = _plain_v6(ip)
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    shape = ip.contains(":") & plain.rlike(V6_LETTERS) & ~plain.rlike(V6_FAULTS)
    return F.coalesce(shape & F.when(plain.contains("::"), groups <= 7).otherwise(groups == 8), F.lit(False))


def is_ip(ip: Column) -> Column:
    return is_v4(ip) | is_v6(ip)


def v4_to_long(ip: Column) -> Column:
    """Dotted quad as a number; null when it is not a valid IPv4 address."""
    octet = F.split(ip, r"\.")
    value = sum((octet[i].cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(is_v4(ip), value)


def is_internal(ip: Column) -> Column:
    """Inside one of the internal networks; text that is no address is not internal."""
    v4 = ip.rlike(V4_INTERNAL_PATTERN) & is_v4(ip)
    return F.coalesce(F.when(ip.contains(":"), is_v6(ip) & _plain_v6(ip).rlike(V6_INTERNAL_PATTERN)).otherwise(v4), F.lit(False))


#: The same test as the body of an SQL function of ``ip``.
IS_INTERNAL_SQL = f"""
    case when ip is null then false
         when contains(ip, ':') then exists(array(regexp_replace(regexp_replace(ip, '{ZONE_PATTERN}', ''), '{V4_TAIL_PATTERN}', '1:1')), p ->
           p rlike '{V6_LETTERS}' and not p rlike '{V6_FAULTS}' and p rlike '{V6_INTERNAL_PATTERN}'
           and if(contains(p, '::'), size(filter(split(p, ':'), g -> g <> '')) <= 7, size(filter(split(p, ':'), g -> g <> '')) = 8))
         else ip rlike '{V4_PATTERN}' and ip rlike '{V4_INTERNAL_PATTERN}' end"""


@F.pandas_udf(T.StringType())
def _canonical(addresses: pd.Series) -> pd.Series:
    def text(value):
        try:
            return str(ipaddress.ip_address(value))
        except ValueError:
            return None
    return addresses.map(text)


def canonical(ip: Column) -> Column:
    """The address in its shortest usual form, null for text that is none. Only v6 texts have several forms."""
    return F.when(is_v4(ip), ip).when(is_v6(ip), _canonical(F.when(is_v6(ip), ip)))


def is_broadcast_or_multicast(ip: Column) -> Column:
    """Multicast, or an IPv4 address whose text ends in ``.255``."""
    first = F.split(ip, r"\.")[0].try_cast("int")
    v4 = is_v4(ip) & (first.between(224, 239) | ip.endswith(".255"))
    v6 = is_v6(ip) & ip.rlike(r"(?i)^ff[0-9a-f]{2}:")
    return F.coalesce(F.when(ip.contains(":"), v6).otherwise(v4), F.lit(False))


@F.pandas_udf(T.StringType())
def _bits(addresses: pd.Series) -> pd.Series:
    """The version of an address and its bits, as text; null for text that is no address."""
    def text(value):
        try:
            address = ipaddress.ip_address(value)
        except ValueError:
            return None
        return f"{address.version}{int(address):0{address.max_prefixlen}b}"
    return addresses.map(text)


def cidr_join(addresses: DataFrame, networks: DataFrame, ip: str = "ip", cidr: str = "cidr") -> DataFrame:
    """Mark addresses that fall into any network of a table, v4 and v6.

    The range test is an equi-join: each address is cut to every prefix length present in the networks of its version
    and matched on what is left. Addresses are reduced to distinct ones first.
    """
    parts = F.split(F.col(cidr), "/")
    nets = (networks.select(_bits(parts[0]).alias("bits"), parts[1].try_cast("int").alias("length")).filter("bits is not null and length is not null")
            .select(F.substring("bits", F.lit(1), F.col("length") + 1).alias("prefix")).distinct())
    # At most 33 and 129 lengths exist, so this array is bounded whatever the size of the table
    sizes = nets.agg(F.coalesce(F.collect_set(F.struct(F.substring("prefix", 1, 1).alias("version"), F.length("prefix").alias("n"))))
                     .alias("l")).scalar()
    probes = (addresses.select(ip).distinct().withColumn("bits", _bits(F.col(ip))).filter("bits is not null")
              .withColumn("size", F.explode(sizes)).filter(F.col("size.version") == F.substring("bits", 1, 1))
              .withColumn("prefix", F.substring("bits", F.lit(1), F.col("size.n"))))
    inside = probes.join(nets, "prefix", "left_semi").select(ip).distinct().withColumn("inside", F.lit(True))
    return addresses.join(inside, ip, "left").fillna({"inside": False})
