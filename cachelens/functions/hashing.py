"""32-bit string hashes as expressions over BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M = 4294967296
# Fixed values of the hash definitions.
FNV_OFFSET, FNV_PRIME, DJB_SEED, FOLD, AVALANCHE = 2166136261, 16777619, 5381, 2654435761, 2246822507


def _codes(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(s: Column, seed: Column | int = 0) -> Column:
    start = (seed if isinstance(seed, Column) else F.lit(seed)).cast("long").bitwiseXOR(F.lit(FNV_OFFSET).cast("long"))
    return F.aggregate(_codes(s), start, lambda h, c: h.bitwiseXOR(c) * FNV_PRIME % M)


def djb2(s: Column) -> Column:
    return F.aggregate(_codes(s), F.lit(DJB_SEED).cast("long"), lambda h, c: (h * 33 + c) % M)


def multiply(x: Column, k: int) -> Column:
    """x * k modulo 2**32, by halves of k so that no product leaves BIGINT."""
    return (x * (k & 0xFFFF) + (x * (k >> 16)) % 65536 * 65536) % M


def ring_hash(s: Column) -> Column:
    def let(v: Column, f):
        return F.element_at(F.transform(F.array(v), f), 1)

    first = fnv1a(s).bitwiseXOR(multiply(djb2(s), FOLD))
    return let(first, lambda a: let(multiply(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), AVALANCHE), lambda b: b.bitwiseXOR(F.shiftrightunsigned(b, 13))))
