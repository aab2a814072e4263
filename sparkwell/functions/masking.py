"""Column masking."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def full(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("****"))


def partial(c: Column, first: int = 1, last: int = 1) -> Column:
    hidden = F.greatest(F.length(c) - first - last, F.lit(0))
    return F.when(F.length(c) <= first + last, F.repeat(F.lit("*"), F.length(c))).otherwise(
        F.concat(F.left(c, F.lit(first)), F.repeat(F.lit("*"), hidden), F.right(c, F.lit(last))))


def email(c: Column) -> Column:
    return F.concat(F.left(c, F.lit(1)), F.lit("***"), F.regexp_extract(c, "@.*$", 0))


def last_four(c: Column) -> Column:
    """Card and phone numbers: all digits but the last four hidden."""
    return F.regexp_replace(c, r"\d(?=(?:\D*\d){4})", "*")


def hashed(c: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def date_year(c: Column) -> Column:
    return F.trunc(c, "year")


def rounded(c: Column, to: float) -> Column:
    return F.round(c / to) * to
