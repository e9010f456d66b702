"""Weights: a row of weight w counts as w copies of itself; corrupt weights count as none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import FEATURES, WEIGHT


def sanitized(weight: Column) -> Column:
    """NULL, NaN, infinite, zero and negative weights become 0."""
    w = weight.cast("double")
    return F.when(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")), w).otherwise(F.lit(0.0))


def sanitize(weight: float | None) -> float:
    """The scalar twin of ``sanitized``."""
    return float(weight) if weight is not None and 0 < weight < float("inf") else 0.0


def weight_column(df: DataFrame) -> Column:
    return sanitized(F.col(WEIGHT)) if WEIGHT in df.columns else F.lit(1.0)


def feature_column(df: DataFrame, name: str = FEATURES) -> Column:
    """Features as array<double>: a numeric array is cast, a vector unpacked; anything else is a ``ValueError``."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.col(name) if kind.elementType == T.DoubleType() else F.transform(name, lambda x: x.cast("double"))
    if kind.typeName() == "vectorudt" or type(kind).__name__ == "VectorUDT":
        from pyspark.ml.functions import vector_to_array

        return vector_to_array(F.col(name))
    raise ValueError(f"unsupported feature-column type: {kind.simpleString()}")


def with_weights(df: DataFrame, *keep: str) -> DataFrame:
    """Exactly [features, weight] (and ``keep``); rows without features are left out."""
    return df.where(F.col(FEATURES).isNotNull()).select(*keep, feature_column(df).alias(FEATURES), weight_column(df).alias(WEIGHT))


def total_mass(df: DataFrame) -> float:
    return df.agg(F.coalesce(F.sum(weight_column(df)), F.lit(0.0))).first()[0]
