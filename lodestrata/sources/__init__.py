"""Sources of point sets: each has a name, loads to [features, weight?], and tells its parameters."""

from .parquet import ParquetSource
from .synthetic import SyntheticSource

__all__ = ["ParquetSource", "SyntheticSource"]
