"""Regression metrics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("mae", "rmse", "mape", "r2")


def regression_metrics(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    """MAE, RMSE, MAPE over non-zero actuals (NULL without any) and R2 (0 for constant actuals)."""
    a, p = F.col(actual), F.col(predicted)
    squared = (a - p) * (a - p)
    spread = F.var_pop(a) * F.count(a)
    return [
        F.avg(F.abs(p - a)).alias("mae"),
        F.sqrt(F.avg(squared)).alias("rmse"),
        (F.avg(F.when(a != 0, F.abs((a - p) / F.nullif(a, F.lit(0.0))))) * 100).alias("mape"),
        F.when(F.min(a) < F.max(a), 1 - F.sum(squared) / F.nullif(spread, F.lit(0.0)))
        .otherwise(0.0)
        .alias("r2"),
        F.count(F.lit(1)).alias("sample_size"),
    ]
