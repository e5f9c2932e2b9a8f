"""Ratio aggregates that never take a missing value for zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_or_null(x: str | Column, given: str | Column | None = None) -> Column:
    """The sum, or null if any component is null. given: what is null where x is, so that sums of one source share a count."""
    return F.when(F.count(col(x if given is None else given)) == F.count(F.lit(1)), F.sum(col(x)))


def paired_sums(num: Column, den: Column, valid: Column | None = None) -> tuple[Column, Column, Column]:
    """Sums of numerator and denominator over rows where both are given and the denominator positive, and their number."""
    ok = num.isNotNull() & den.isNotNull() & (den > 0)
    ok = ok & valid if valid is not None else ok
    return F.sum(F.when(ok, num)), F.sum(F.when(ok, den)), F.count_if(ok)


def paired_ratio(num: Column, den: Column, scale: float = 1.0, valid: Column | None = None) -> Column:
    a, b, _ = paired_sums(num, den, valid)
    return a * F.lit(scale) / F.nullif(b, F.lit(0))


@dataclass(frozen=True)
class Shrunk:
    """A ratio pulled to its prior: (sum of num + prior * weight) / (sum of den + weight), times scale; complement gives 1 - ratio.
    Rows count where both are given, den is positive and, if bounded, num is at most den."""

    name: str
    num: str
    den: str
    prior: float
    weight: float
    scale: float = 1.0
    bounded: bool = False
    complement: bool = False

    def column(self) -> Column:
        num, den = F.col(self.num), F.col(self.den)
        a, b, _ = paired_sums(num, den, num <= den if self.bounded else None)
        value = (F.coalesce(a, F.lit(0.0)) + self.prior * self.weight / self.scale) / (F.coalesce(b, F.lit(0.0)) + self.weight) * self.scale
        return (1 - value if self.complement else value).alias(self.name)

    def of_sums(self, num: Column, den: Column) -> Column:
        """The same from sums already taken over valid rows."""
        value = (num + self.prior * self.weight / self.scale) / (den + self.weight) * self.scale
        return (1 - value if self.complement else value).alias(self.name)


def missing(fields: list[str]) -> Column:
    """(field, number of nulls) for each field, as an array to explode: one pass, no unpivoted copy of the rows."""
    return F.array(*[F.struct(F.lit(f).alias("field"), F.count_if(F.col(f).isNull()).alias("missing")) for f in fields])
