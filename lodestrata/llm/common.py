"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset a local one, but only if all executors are in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends there and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives memory that a worker has freed back to the system: idle workers then hold little beside running ones."""
    pa.default_memory_pool().release_unused()
    trimmed = getattr(_LIBC, "malloc_trim", None)
    if trimmed:
        trimmed(0)


def without(docs: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose key isn't among ``ids``; rows with a null key stay. Up to a counted number of ids travel to the documents, beyond it both are shuffled."""
    ids = written(ids.select(key).distinct(), "ids")
    few = ids.count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, key, "left_anti").select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def is_held_out(key: Column) -> Column:
    return fold_of(key) == 1


def whole(text: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def sampled_texts(keys: DataFrame, group: str, rows: int, chars: int, docs: DataFrame | None = None) -> dict:
    """Texts by group: of the rows of (k, ``group``, t) those ``rows`` of each group with the least hash of k, the same at every partitioning.

    A count of each group bounds the hashes that can be among the least, so that one more scan ends with little more
    than the sample, ``chars`` code points of each text; what comes to the driver is bounded by the groups times ``rows``.
    ``docs``: (k, t), where the texts are in a table of their own.
    """
    spread = 1 << 30
    place = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(spread))
    counts = keys.groupBy(group).agg(F.count("*").alias("n"))
    # Twice the rows that are wanted, and 64 more: too few come with a chance of less than one in a million.
    limits = written(counts.select(F.col(group).alias("g"), (F.lit(float(spread)) * (2 * rows + 64) / F.col("n")).cast("long").alias("limit")), "limits")
    picked = keys.withColumn("__place", place).join(F.broadcast(limits), F.col(group) == F.col("g")).where(F.col("__place") < F.col("limit"))
    if docs is not None:
        picked = docs.join(F.broadcast(picked.select("k", group, "__place")), "k")
    picked = picked.where(F.col("t").isNotNull()).select("k", group, "__place", sample_window(F.col("t"), F.col("k"), chars).alias("t"))
    texts: dict = {}
    for row in sorted(picked.collect(), key=lambda r: (r["__place"], str(r.k), r.t)):
        texts.setdefault(row[group], []).append(row.t)
    return {name: own[:rows] for name, own in texts.items()}


def sample_window(text: Column, key: Column, chars: int) -> Column:
    """``chars`` code points of ``text`` from an offset that the key's hash picks."""
    spare = F.greatest(F.char_length(text) - chars, F.lit(0))
    return text.substr((F.pmod(F.xxhash64(key), spare + 1) + 1).cast("int"), F.lit(chars))
