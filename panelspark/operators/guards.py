"""Point-in-time audits and equality gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.sources.bars import KEY


def pit_violations(frame: Callable[[DataFrame], DataFrame], bars: DataFrame, cut: str, names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows up to cut whose features change when later bars are taken away, or are perturbed."""
    date = F.lit(cut).cast("date")
    future = F.col("date") > date
    bent = bars.withColumns({c: F.when(future, F.col(c) * 3.0 + 1.0).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    base = frame(bars).where(~future)
    out = None
    for kind, other in (("truncated", bars.where(~future)), ("perturbed", bent)):
        changed = differences(base, frame(other).where(~future), [KEY, "date"], names, tolerance).withColumn("mutation", F.lit(kind))
        out = changed if out is None else out.unionByName(changed)
    return out


def same(a: Column, b: Column, tolerance: float) -> Column:
    """Both null, or within tolerance relatively."""
    close = F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return (a.isNull() & b.isNull()) | F.coalesce(close, F.lit(False))


def differences(left: DataFrame, right: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys and names of values in which two frames differ; a key that one side lacks differs in every value it has."""
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(n).alias(f"r_{n}") for n in names])
    both = left.select(*keys, *names).join(r, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys], "full")
    flags = F.array(*(F.when(~same(F.col(n).cast("double"), F.col(f"r_{n}").cast("double"), tolerance), F.lit(n)) for n in names))
    marked = both.select(*[F.coalesce(k, f"r_{k}").alias(k) for k in keys], F.explode(F.array_compact(flags)).alias("name"))
    return marked
