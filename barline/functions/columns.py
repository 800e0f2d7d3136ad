"""Scalar column builders: no state, no shuffle, all inside whole-stage codegen."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: ColumnOrName) -> Column:
    """NaN, infinities and unparsable text become NULL."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_symbol(c: ColumnOrName, caret: bool = True) -> Column:
    """File-safe symbol. ``caret=False`` keeps ``^`` (the cache-file variant)."""
    return F.translate(col(c), "=^/", "___") if caret else F.translate(col(c), "=/", "__")


def clip(c: ColumnOrName, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def lookup(c: ColumnOrName, table: dict) -> Column:
    """Small fixed code table as a literal map."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.create_map(*pairs)[col(c)]


def with_softmax(df: DataFrame, scores: list[Column], out: list[str], temperature: float = 1.0) -> DataFrame:
    """Adds the max-subtracted softmax of scalar columns.

    Scores, maximum and exponentials are columns of projections of their own: each is used more than once, so the
    optimizer keeps them apart and generated code stays small.
    """
    z, e = [f"_z_{i}" for i in range(len(scores))], [f"_e_{i}" for i in range(len(scores))]
    keep = [c for c in df.columns if c not in out]
    df = df.withColumns({a: s * F.lit(temperature) for a, s in zip(z, scores)}).withColumn("_top", F.greatest(*z))
    df = df.withColumns({b: F.exp(F.col(a) - F.col("_top")) for a, b in zip(z, e)})
    df = df.withColumn("_total", sum((F.col(b) for b in e[1:]), F.col(e[0])))
    return df.select(*keep, *[(F.col(b) / F.col("_total")).alias(n) for b, n in zip(e, out)])


def argmax(values: list[Column]) -> Column:
    """Index of the first maximum, skipping NULLs; NULL when all are NULL."""
    top = F.greatest(*values)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(values))):
        out = F.when(values[i] == top, F.lit(i)).otherwise(out)
    return out


def normal_cdf(x: ColumnOrName) -> Column:
    """Standard normal CDF from built-ins (Spark has no erf).

    Both branches are convergent expansions, accurate to about 1e-14: the odd power series of the
    density integral for |x| < 5 and the Mills-ratio continued fraction beyond.
    """
    v = col(x)
    a = F.abs(v)
    density = F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi))
    # phi(a) * (a + a^3/3 + a^5/15 + ...): positive terms, folded from the tail; a fold keeps the
    # expression shallow where 75 nested operators would not
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(75), F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * a * a / (k * 2.0 + 1.0))
    inner = F.lit(0.5) - density * a * series
    far = F.greatest(a, F.lit(1.0))
    frac = F.aggregate(down(30), far, lambda acc, k: far + k / acc)
    tail = F.when(a < 5, inner).otherwise(density / frac)
    return F.when(v > 0, 1.0 - tail).otherwise(tail)


def normal_quantile(p: float) -> float:
    """Quantile of a plan-time constant."""
    return NormalDist().inv_cdf(p)


def rounded(c: ColumnOrName, digits: int = 6) -> Column:
    """Round for output; negative zero becomes zero and non-finite becomes NULL."""
    return F.round(finite_or_null(c), digits) + F.lit(0.0)  # -0.0 + 0.0 is 0.0; a CASE would round twice
