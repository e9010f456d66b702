"""A mixture of five modes in three dimensions, in native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import FEATURES


@dataclass(frozen=True)
class SyntheticSource:
    num_points: int
    num_partitions: int = 8
    seed: int = 42
    type_name = "synthetic-5mix-3d"
    name = "synthetic-5mix-3d"

    @classmethod
    def create(cls, params) -> SyntheticSource:
        return cls(params.long("numPoints"), params.int_opt("numPartitions", 8), params.long_opt("seed", 42))

    def load(self, spark: SparkSession) -> DataFrame:
        rows = spark.range(0, self.num_points, 1, self.num_partitions)
        drawn = rows.select(F.rand(self.seed).alias("r"), *(F.rand(self.seed + 1 + i).alias(f"u{i}") for i in range(3)), *(F.randn(self.seed + 4 + i).alias(f"g{i}") for i in range(3)))
        return drawn.select(F.array(*(self._coordinate(i) for i in range(3))).alias(FEATURES))

    @staticmethod
    def _coordinate(i: int) -> Column:
        """Mode by r: wide uniform noise, two overlapping balls, a streak along the first axis, a tight ball."""
        g = F.col(f"g{i}")
        streak = g * 40 + 100 if i == 0 else g * 2 + 50
        return F.when(F.col("r") < 0.05, F.col(f"u{i}") * 2000 - 1000).when(F.col("r") < 0.30, g * 5).when(F.col("r") < 0.55, g * 5 + 5).when(F.col("r") < 0.70, streak).otherwise(g + 200)

    def metadata(self) -> dict[str, str]:
        return {"numPoints": str(self.num_points), "numPartitions": str(self.num_partitions), "seed": str(self.seed)}
