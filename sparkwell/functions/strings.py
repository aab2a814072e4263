"""Text normalisation, phonetic keys and hashed embeddings."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD, in Arrow batches: Spark has no function for it."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return run(text)


def phonetic(text: Column) -> Column:
    return F.soundex(text)


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """Signed token counts in ``size`` buckets, scaled to unit length."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    signs = F.transform(tokens, lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    pairs = F.arrays_zip(places.alias("p"), signs.alias("s"))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.aggregate(F.filter(pairs, lambda x: x["p"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    return F.transform(F.array(raw), lambda v: _unit(v))[0]


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def time_features(ts: Column) -> list[Column]:
    """Hour, weekday (0 = Sunday), weekend flag and the hour on the circle."""
    angle = F.hour(ts) * (2 * 3.141592653589793 / 24)
    return [
        F.hour(ts).alias("hour"), (F.dayofweek(ts) - 1).alias("weekday"), F.dayofweek(ts).isin(1, 7).alias("weekend"),
        _round_signed(F.sin(angle)).alias("hour_sin"), _round_signed(F.cos(angle)).alias("hour_cos")]


def _round_signed(x: Column) -> Column:
    """Six places; what rounds to zero from below is -0.0, of which Spark's round drops the sign."""
    return F.when(x < 0, -F.round(-x, 6)).otherwise(F.round(x, 6))
