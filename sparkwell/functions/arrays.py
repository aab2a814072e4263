"""Array and map functions with the duplicate and index rules of the engine."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(a: Column, i: Column) -> Column:
    """1-based, negative from the end; null outside and at 0."""
    return F.when(i != 0, F.try_element_at(a, i))


def has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def count_equal(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def intersect_keeping(a: Column, b: Column) -> Column:
    """Elements of ``a`` that ``b`` has, duplicates kept."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def difference_keeping(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def map_update(a: Column, b: Column) -> Column:
    """Entries of both; ``b`` wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def map_get(m: Column, key: Column, default: Column | None = None) -> Column:
    got = F.try_element_at(m, key)
    return got if default is None else F.coalesce(got, default)
