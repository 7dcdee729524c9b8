"""Similarity kernels on columns. Divisions by zero give 0, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(common: Column, size1: Column, size2: Column) -> Column:
    """Common members over members of either set, from counts."""
    return F.coalesce(F.try_divide(common.cast("double"), (size1 + size2 - common).cast("double")), F.lit(0.0))


def binary_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets given as arrays without repeats."""
    top = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(top, F.sqrt(F.size(a)) * F.sqrt(F.size(b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the first set's members that the second holds."""
    top = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(top, F.size(F.array_distinct(a)).cast("double")), F.lit(0.0))


def positional_cosine(u: Column, v: Column) -> Column:
    """Cosine of two number arrays, the shorter one padded with zeros."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    dot = total(F.zip_with(u, v, lambda x, y: number(x) * number(y)))
    norm = lambda xs: F.sqrt(total(F.transform(xs, lambda x: number(x) * number(x))))
    return F.coalesce(F.try_divide(dot, norm(u) * norm(v)), F.lit(0.0))


CONSTANT = 1e-9


def pearson_of_sums(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson correlation from sums over the shared members, with 1e-10 in the denominator.

    A side whose n-fold sum of squares is within `CONSTANT` of the squared sum is constant, and the result 0: what is left
    there is rounding.
    """
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    constant = (va < F.lit(CONSTANT)) | (vb < F.lit(CONSTANT))
    under = F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0))) + n * F.lit(1e-10)
    return F.when(constant, F.lit(0.0)).otherwise((n * sab - sa * sb) / under)
