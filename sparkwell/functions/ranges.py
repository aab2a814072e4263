"""Range values as struct(lo, hi, lo_inc, hi_inc); a null bound is unbounded."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lo: Column, hi: Column, lo_inc: bool = True, hi_inc: bool = False) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(lo_inc).alias("lo_inc"), F.lit(hi_inc).alias("hi_inc"))


def is_empty(r: Column) -> Column:
    return F.coalesce((r.lo > r.hi) | ((r.lo == r.hi) & ~(r.lo_inc & r.hi_inc)), F.lit(False))


def contains(r: Column, x: Column) -> Column:
    above = r.lo.isNull() | (x > r.lo) | (r.lo_inc & (x == r.lo))
    below = r.hi.isNull() | (x < r.hi) | (r.hi_inc & (x == r.hi))
    return ~is_empty(r) & above & below


def _starts_by(a: Column, b: Column) -> Column:
    """The start of a is not past the end of b."""
    return a.lo.isNull() | b.hi.isNull() | (a.lo < b.hi) | ((a.lo == b.hi) & a.lo_inc & b.hi_inc)


def overlaps(a: Column, b: Column) -> Column:
    return ~is_empty(a) & ~is_empty(b) & _starts_by(a, b) & _starts_by(b, a)


def adjacent(a: Column, b: Column) -> Column:
    def touch(x: Column, y: Column) -> Column:
        return F.coalesce((x.hi == y.lo) & (x.hi_inc != y.lo_inc), F.lit(False))

    return touch(a, b) | touch(b, a)


def intersection(a: Column, b: Column) -> Column:
    """Null where they don't overlap."""
    lo_a = a.lo.isNotNull() & (b.lo.isNull() | (a.lo > b.lo) | ((a.lo == b.lo) & ~a.lo_inc))
    hi_a = a.hi.isNotNull() & (b.hi.isNull() | (a.hi < b.hi) | ((a.hi == b.hi) & ~a.hi_inc))
    lo, hi = F.when(lo_a, F.struct(a.lo.alias("v"), a.lo_inc.alias("i"))).otherwise(F.struct(b.lo.alias("v"), b.lo_inc.alias("i"))), F.when(
        hi_a, F.struct(a.hi.alias("v"), a.hi_inc.alias("i"))).otherwise(F.struct(b.hi.alias("v"), b.hi_inc.alias("i")))
    return F.when(overlaps(a, b), F.struct(lo.v.alias("lo"), hi.v.alias("hi"), lo.i.alias("lo_inc"), hi.i.alias("hi_inc")))
