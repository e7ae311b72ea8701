"""Binning by thresholds and histograms of gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.expr import bin_index, column
from quillspark.sources.features import numeric

BINS = 256


def discretize(df: DataFrame, name: str, thresholds: Sequence[float], output: str = "bin") -> DataFrame:
    return df.withColumn(output, bin_index(numeric(df, name, "keep"), thresholds))


def build_histogram(df: DataFrame, bin_col: str, gradient: str, counts: bool = False, bins: int = BINS) -> DataFrame:
    """bin, grad_sum (and n) for every bin; empty bins are zero. Partial sums before the shuffle; at most `bins` rows after."""
    if not 0 < bins <= BINS:
        raise ValueError(f"1 to {BINS} bins")
    found = df.groupBy(column(bin_col).cast("int").alias("bin")).agg(F.sum(numeric(df, gradient)).alias("s"), F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(found, "bin", "left").select("bin", F.coalesce("s", F.lit(0.0)).alias("grad_sum"), F.coalesce("c", F.lit(0)).cast("long").alias("n"))
    return out if counts else out.drop("n")
