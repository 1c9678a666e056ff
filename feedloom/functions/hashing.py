"""Rolling hashes and pseudonyms as column expressions. Text hashes run over code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295


def _points(c: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))


def hash33(c: Column) -> Column:
    """h = h * 33 xor code, from 5381, in 32 bits."""
    return F.aggregate(_points(c), F.lit(5381).cast("bigint"), lambda h, x: (h * 33).bitwiseXOR(x).bitwiseAND(F.lit(MASK)))


def short_id(c: Column) -> Column:
    """hash33 in base 36."""
    return F.lower(F.conv(hash33(c).cast("string"), 10, 36))


def hash31(c: Column, modulus: int | None = None) -> Column:
    """h = h * 31 + code in 32 bits, reduced if a modulus is given."""
    h = F.aggregate(_points(c), F.lit(0).cast("bigint"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(MASK)))
    return h % modulus if modulus else h


def hue(c: Column) -> Column:
    return hash31(c, 360)


def alias_number(c: Column) -> Column:
    """First 32 bits of the md5 of the lower-cased id, modulo 10000, four digits."""
    n = F.conv(F.substring(F.md5(F.lower(c)), 1, 8), 16, 10).cast("bigint") % 10000
    return F.lpad(n.cast("string"), 4, "0")


def alias(c: Column, prefix: str = "Reader") -> Column:
    return F.concat(F.lit(prefix + " "), alias_number(c))


def opaque_id(c: Column) -> Column:
    return F.md5(F.lower(c))


def pick(count: Column, seed: Column) -> Column:
    """A stable choice of 0 .. count - 1; null for an empty pool."""
    return F.when(count > 0, hash31(seed) % count)
