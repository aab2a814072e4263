"""URL and IP address functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def top_level_domain(url: Column) -> Column:
    return F.element_at(F.split(host(url), r"\."), -1)


def domain_without_www(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def ipv4_to_number(ip: Column) -> Column:
    """Null where the text is no dotted quad of 0..255."""
    part = F.split(ip, r"\.")
    number = sum(
        (F.try_element_at(part, F.lit(i + 1)).try_cast("long") * 256 ** (3 - i) for i in range(1, 4)),
        F.try_element_at(part, F.lit(1)).try_cast("long") * 256**3)
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$"), number)


def number_to_ipv4(n: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.shiftright(n.cast("long"), s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def cidr_range(cidr: Column) -> Column:
    """struct(lo, hi) of the addresses of ``a.b.c.d/n``."""
    bits = F.try_element_at(F.split(cidr, "/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    base = ipv4_to_number(F.element_at(F.split(cidr, "/"), 1))
    lo = base - F.pmod(base, size)
    return F.struct(lo.alias("lo"), (lo + size - 1).alias("hi"))


def ipv4_in_range(ip: Column, cidr: Column) -> Column:
    r = cidr_range(cidr)
    return ipv4_to_number(ip).between(r["lo"], r["hi"])


def is_private(ip: Column) -> Column:
    nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
    out = F.lit(False)
    for n in nets:
        out = out | ipv4_in_range(ip, F.lit(n))
    return out


def ip_version(ip: Column) -> Column:
    return F.when(ipv4_to_number(ip).isNotNull(), 4).when(ip.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), 6)
