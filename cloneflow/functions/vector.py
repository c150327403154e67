"""Expressions on `array<float>` / `array<double>` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloneflow.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def finite(score: Column) -> Column:
    """NaN orders above every number in Spark; a threshold test must never see one."""
    return F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms; 0 when either vector is zero; null when either is missing."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(
        let(
            F.struct(dot(a, b).alias("d"), (norm(a) * norm(b)).alias("n")),
            lambda s: F.when(s["n"] > 0, s["d"] / s["n"]).otherwise(0.0),
        )
    )


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(
        F.struct(v.alias("v"), norm(v).alias("n")),
        lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double"))),
    )


def pad_truncate(v: Column, dim: int) -> Column:
    """Exactly `dim` entries: zeros appended or the tail cut."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)
