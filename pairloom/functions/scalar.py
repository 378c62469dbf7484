"""Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Op codes of an alignment that use up the reference: M, D, N, =, X.
REFERENCE_OPS = (0, 2, 3, 7, 8)
#: Bases from which on the contact density is constant.
FAR_SEPARATION = 500_000
_IUPAC = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
_PAIRED = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def mean_of(name: str) -> Callable[[Column, Column], Column]:
    """The named mean of two columns."""
    if name == "geometric":
        return lambda x, y: F.sqrt(x * y)
    if name == "harmonic":
        return lambda x, y: F.lit(2.0) * x * y / F.nullif(x + y, F.lit(0))
    if name == "arithmetic":
        return lambda x, y: F.lit(0.5) * (x + y)
    raise RuntimeError(f"{name} is no known mean: geometric, harmonic or arithmetic is")


def aligned_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    covered = F.transform(cigar, lambda c: F.when(c["op"].isin(*REFERENCE_OPS), c["len"]).otherwise(F.lit(0)))
    return F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0))


def outer_op(cigar: Column, reverse: Column) -> Column:
    """The op at the read's 5' end; null if there is none."""
    return F.when(reverse, F.try_element_at(cigar, F.lit(-1))).otherwise(F.try_element_at(cigar, F.lit(1)))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _IUPAC, _PAIRED))


def gc_percent(seq: Column) -> Column:
    """Share of G, C and S in either case, over all letters; 0 for an empty sequence."""
    return F.when(F.length(seq) > 0, F.lit(100.0) * F.length(F.regexp_replace(seq, "[^GCSgcs]", "")) / F.length(seq)).otherwise(F.lit(0.0))


def coverage_from_name(name: Column, strict: bool = False) -> Column:
    """Coverage at the end of an assembler's sequence name; null where there is none (strict: an error).

    A fragment's ``.start_end`` suffix is ignored unless strict, which takes whatever follows the last underscore.
    """
    if strict:
        return F.element_at(F.split(name, "_"), -1).cast("double")
    return F.regexp_extract(name, r"_cov_([0-9.]+?)(\.\d+_\d+)?$", 1).try_cast("double")


def plogp(p: Column) -> Column:
    """p log2 p, 0 at 0."""
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def pareto_density(s: Column) -> Column:
    """Contact density at separation s: generalised Pareto below 500 kb, constant beyond."""
    # fixed values: shape, scale, location, far density
    a, lam, mu, far = 0.122123774414444, 13.675170758388262, 13.973247315647466, 2e-8
    return F.when(s < FAR_SEPARATION, a / lam * F.pow(1 + (s - mu) / lam, F.lit(-a - 1))).otherwise(F.lit(far))


def zero_padded(number: Column, width: Column) -> Column:
    """At least ``width`` digits; lpad alone would cut longer numbers."""
    s = number.cast("string")
    return F.lpad(s, F.greatest(width, F.length(s)), F.lit("0"))


def digits(count: Column) -> Column:
    """max(1, ceil(log10(count)))."""
    return F.greatest(F.lit(1), F.ceil(F.log10(count)).cast("int"))
