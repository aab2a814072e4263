"""Integer and address functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; a pair of 64-bit numbers needs at most 93."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(93)), start,
        lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.pmod(s.a, F.when(s.b == 0, 1).otherwise(s.b)).alias("b"))), lambda s: s.a)


def fibonacci(n: Column) -> Column:
    """The n-th number, n from 0 to 92."""
    first = F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    steps = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, lambda s, _: F.struct(s.b.alias("a"), F.try_add(s.a, s.b).alias("b")), lambda s: s.a)


def ipv6_digits(ip: Column) -> Column:
    """The 128 bits of an IPv6 address as 32 hex digits."""
    sides = F.split(F.lower(ip), "::")
    left, right = (F.array_remove(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), "") for i in (0, 1))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    return F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")


def macaddr(c: Column) -> Column:
    """Any usual way to write a hardware address as aa:bb:cc:dd:ee:ff; null if it has not twelve digits."""
    digits = F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits) == 12, F.array_join(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), ":"))
