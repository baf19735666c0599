"""Native Column expressions over ``array<float>`` embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Dot product in double precision (sum of element products)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    sq = F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def l2_normalize(a) -> Column:
    """Unit-length copy of the vector (zero vectors stay zero)."""
    n = l2_norm(a)
    return F.transform(
        _c(a), lambda x: F.when(n > 0, (x.cast("double") / n)).otherwise(F.lit(0.0)).cast("float")
    )
