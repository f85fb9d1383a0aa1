"""Two-sided p-value of Student's t, the one distribution Spark SQL has no function for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def two_sided_p(statistic: Column, degrees: Column) -> Column:
    """Arrow UDF over a handful of result rows; self-contained, so executors need no extra module."""

    def evaluate(t_values: pd.Series, degree_values: pd.Series) -> pd.Series:
        import math

        def beta_fraction(x, a, b):
            # Continued fraction of the incomplete beta function, by Lentz's method.
            tiny = 1e-300
            c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
            value = d
            for m in range(1, 1000):
                for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                             -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1.0 + term * d
                    d = 1.0 / (d if abs(d) > tiny else tiny)
                    c = 1.0 + term / c
                    c = c if abs(c) > tiny else tiny
                    value *= c * d
                if abs(c * d - 1.0) < 1e-15:
                    break
            return value

        def p_value(t, degrees):
            if pd.isna(t) or pd.isna(degrees) or degrees <= 0:
                return None
            if t == 0:
                return 1.0
            a, b, x = degrees / 2.0, 0.5, degrees / (degrees + t * t)
            scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                             + a * math.log(x) + b * math.log1p(-x))
            if x < (a + 1.0) / (a + b + 2.0):
                return scale * beta_fraction(x, a, b) / a
            return 1.0 - scale * beta_fraction(1.0 - x, b, a) / b

        return pd.Series([p_value(t, d) for t, d in zip(t_values, degree_values)], dtype="float64")

    return F.pandas_udf(evaluate, "double")(statistic, degrees)
