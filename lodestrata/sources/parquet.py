"""Point sets from Parquet: one feature column, maybe a weight; the scan reads those two only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import FEATURES, WEIGHT
from ..functions.uniform import keyed_uniform
from ..functions.weights import feature_column


def repartitioned(df: DataFrame, partitions: int | None) -> DataFrame:
    """Fewer partitions are merged without a shuffle, more need one, as many need nothing."""
    if not partitions:
        return df
    now = df.rdd.getNumPartitions()
    return df if partitions == now else df.coalesce(partitions) if partitions < now else df.repartition(partitions)


@dataclass(frozen=True)
class ParquetSource:
    path: str
    feature_column_name: str
    num_partitions: int | None = None
    weight_column: str | None = None
    sample_fraction: float | None = None
    seed: int = 42
    sample_key: str | None = None
    type_name = "parquet"

    @property
    def name(self) -> str:
        return f"parquet:{self.path}"

    @classmethod
    def create(cls, params) -> ParquetSource:
        return cls(params.string("path"), params.string("featureColumnName"), params.int_opt("numPartitions"), params.string_opt("weightColumn"), params.double_opt("sampleFraction"), params.long_opt("seed", 42), params.string_opt("sampleKey"))

    def load(self, spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(self.path)
        if self.sample_fraction is not None and self.sample_fraction < 1.0:
            # By a key the sample is the same at every partitioning; without one it follows the scan's.
            df = df.where(keyed_uniform(F.col(self.sample_key), self.seed) < self.sample_fraction) if self.sample_key else df.sample(False, self.sample_fraction, self.seed)
        columns = [feature_column(df, self.feature_column_name).alias(FEATURES)]
        if self.weight_column:
            columns.append(F.col(self.weight_column).cast("double").alias(WEIGHT))
        return repartitioned(df.select(*columns), self.num_partitions)

    def metadata(self) -> dict[str, str]:
        known = {"path": self.path, "featureColumnName": self.feature_column_name, "numPartitions": self.num_partitions, "weightColumn": self.weight_column, "sampleFraction": self.sample_fraction, "seed": self.seed, "sampleKey": self.sample_key}
        return {k: str(v) for k, v in known.items() if v is not None}
