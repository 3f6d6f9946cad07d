"""Looking quotes up in their sources, and numbers in their evidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text as t


def quote_found(quote: Column | str, source: Column | str, probe: int = 12, least: int = 8) -> Column:
    """Does a quote stand in a source, white space and case aside: as a whole, or two thirds of its probes. False for null or empty sides."""
    q, s = t.squeeze(F.coalesce(t._c(quote), F.lit(""))), t.squeeze(F.coalesce(t._c(source), F.lit("")))
    step = F.greatest(F.floor(F.length(q) / 8), F.lit(probe)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.least(F.length(q), F.lit(240)) - 1, F.lit(0)), step)
    probes = F.filter(F.transform(starts, lambda i: F.substring(q, i + 1, F.lit(probe))), lambda p: F.length(p) >= least)
    hits = F.size(F.filter(probes, lambda p: F.contains(s, p)))
    return F.when((q == "") | (s == ""), False).when(F.contains(s, q), True).when(F.length(q) < least, False).otherwise((F.size(probes) > 0) & (hits * 3 >= F.size(probes) * 2))


def missing_numbers(claim: Column | str, evidence: Column | str) -> Column:
    """Numbers of a claim that its evidence does not have; 82 and 82 % are different."""
    return F.array_except(t.numbers(claim), t.numbers(evidence))
