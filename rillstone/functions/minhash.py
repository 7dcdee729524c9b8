"""Linear MinHash family, signatures and LSH bands as integer expressions.

The family is kept because its values decide which pairs become candidates. Every function of it depends on a member only
through one number, `member_base`, which is computed once per member.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HashFamily:
    """Parameters of h(x, i) = ((i * t(x) + i^2) mod p) mod m with t(x) = (ax+b) mod m + ((ax+b) mod p) mod m."""

    m: int = 27351
    a: int = 9679
    b: int = 23143
    p: int = 502687

    def member_base(self, x: Column) -> Column:
        line = x * F.lit(self.a) + F.lit(self.b)
        return line % self.m + line % self.p % self.m

    def value(self, base: Column, i: Column) -> Column:
        return (i * base + i * i) % self.p % self.m

    def least(self, base: str, i: int) -> Column:
        """The smallest value of hash `i` over a group, from the column named `base`; one expression, as there are many."""
        return F.expr(f"min(({i}L * {base} + {i * i}L) % {self.p} % {self.m})")


# The parameter sets in use, as (family, hashes, bands, first index).
SUBMITTED = (HashFamily(), 50, 50, 1)
SHORT_PRIME = (HashFamily(p=23197), 25, 25, 0)
BUCKETS = (HashFamily(), 12, 12, 0)
TWO_ROWS = (HashFamily(m=28000, a=677), 100, 50, 1)
MERGED = (HashFamily(), 200, 100, 1)


def signature(members: Column, family: HashFamily, hashes: int, first: int = 1) -> Column:
    """Array of `hashes` minima over an array of member numbers; index 0 makes every minimum 0."""
    bases = F.transform(members, family.member_base)
    return F.transform(
        F.sequence(F.lit(first), F.lit(first + hashes - 1)),
        lambda i: F.array_min(F.transform(bases, lambda t: family.value(t, i.cast("long")))),
    )


def bands(sig: Column, count: int, rows: int) -> Column:
    """Array of (band, slice) structs; the exact slice is the key, so there are no accidental collisions."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.struct(i.alias("band"), F.slice(sig, i * rows + 1, F.lit(rows)).alias("rows")),
    )


def bands_for(similarity: float, recall: float, hashes: int) -> int:
    """The fewest bands (the longest slices) of `hashes` hashes by which a pair of this similarity meets with chance `recall`.

    A pair of Jaccard s agrees in a slice of r hashes with chance s^r and meets in one of b bands with 1 - (1 - s^r)^b.
    Shorter slices only add candidates. If even single hashes are too few, there is no such number.
    """
    for rows in range(hashes, 0, -1):
        if hashes % rows == 0 and 1 - (1 - similarity**rows) ** (hashes // rows) >= recall:
            return hashes // rows
    raise ValueError(f"{hashes} hashes can't reach a recall of {recall} at similarity {similarity}")
