"""Column helpers whose meaning does not depend on any table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column | str) -> Column:
    """The value, with NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part, F.when(whole != 0, whole))


def clip(c: Column, low: Column, high: Column) -> Column:
    """c within [low, high]; a null value or bound stays as it is."""
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def hash_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that follows from the keys alone, so a rerun task draws the same."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)


def digest_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the MD5 digest of the keys and the seed as text, joined by "|"; other engines draw the same."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def exact_mean(c: Column) -> Column:
    """The mean of a group of doubles, the same for any order and partitioning of its rows: values of up to 9 decimals are added as decimals. A group with others gets avg."""
    short = c.try_cast("decimal(28,9)")
    short = F.when(short.cast("double") == c, short)
    return F.when(F.count(short) == F.count(c), F.sum(short).cast("double") / F.nullif(F.count(c), F.lit(0))).otherwise(F.avg(c))
